"""What the operators of this package share: passes over texts and worker-wide caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.workspace import small_batches

Compute = Callable[[list], dict]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def release_memory() -> None:
    """Give back what Arrow and the C library keep for reuse. Workers outlive their tasks, and
    what one stage leaves with them adds to what the next one needs."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # only some C libraries have it
        trim(0)


def map_rows(
    df: DataFrame,
    read: str,
    fields: str,
    start: Callable[[], Compute],
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns of ``df`` (all, if None) and the ``fields`` worked out from column ``read``.

    ``start()`` runs once a task and gives a function from the list of a batch's values
    (texts as UTF-8 bytes, nulls as None) to a dict of equally long columns. A kept column
    whose name is that of a field is replaced. Rows and their order stay.
    """
    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(fields)
    names = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{read}`").alias("__read"))
    schema = T.StructType([*source.schema.fields[:-1], *new])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(len(kept))
            if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
                values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
            made = compute(values.to_pylist())
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array(made[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *arrow.names])
            del values, made, columns, batch
        release_memory()

    return source.mapInArrow(run, schema)


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """One object a Python worker, kept between tasks (code that travels with tasks has no
    module of its own to keep it in)."""
    home = sys.modules.setdefault("_codeloom_worker", types.ModuleType("_codeloom_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
