"""Structured Streaming over a growing corpus folder.

There is no event time in a corpus, so no watermark: the state of ``first_seen`` holds every
repository seen, by design, and is kept in RocksDB, beside the memory of the executors.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.firsts import first_per_key
from codeloom.sources import collection
from codeloom.sources.corpus import (
    CORRUPT,
    RECORD_SCHEMA,
    corpus_glob,
    good_records,
    reader_schema,
    with_path_columns,
)
from codeloom.workspace import materialize

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_STORES = "org.apache.spark.sql.execution.streaming.state"
ROCKSDB, DEFAULT_STORE = f"{_STORES}.RocksDBStateStoreProvider", f"{_STORES}.HDFSBackedStateStoreProvider"


def stream_corpus(
    spark: SparkSession,
    base_dir: str,
    languages=None,
    splits=None,
    record_schema: T.StructType = RECORD_SCHEMA,
    max_files_per_batch: int = 10,
    file_glob: str = "*.jsonl",
) -> DataFrame:
    """Good records of the corpus as a stream, a number of files at a time."""
    raw = (
        spark.readStream.schema(reader_schema(record_schema))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .json(corpus_glob(base_dir, languages, splits, file_glob))
    )
    return good_records(with_path_columns(raw))


def first_seen(stream: DataFrame, key: str = "repo", order: str | None = None) -> DataFrame:
    """The first record of each key by ``order``, as a stream of corrections: whenever a batch
    has a record that comes before all of its key so far, that record is given. ``resolve_firsts``
    reads the firsts from the table that holds them. Files may come in any order.

    The state of a key is the least order seen. Rows without an order are left out. Arrow batches
    keep only their own first of each key, so that a key with most of the records does not send
    them all to one state store. Without ``order`` any one record of a key is given, once.
    """

    def local_firsts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield (frame.sort_values(order) if order else frame).drop_duplicates(key)

    if order is None:
        return stream.mapInPandas(local_firsts, stream.schema).dropDuplicates([key])
    ordered = stream.where(F.col(order).isNotNull()).mapInPandas(local_firsts, stream.schema)

    def corrected(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        least = state.get[0] if state.exists else None
        best = None
        for frame in frames:
            first = frame.sort_values(order).head(1)
            value = first[order].iloc[0]
            if least is None or value < least:
                best, least = first, value.item() if hasattr(value, "item") else value
        if best is not None:
            state.update((least,))
            yield best

    held = T.StructType([T.StructField("least", stream.schema[order].dataType)])
    return ordered.groupBy(key).applyInPandasWithState(corrected, stream.schema, held, "append", "NoTimeout")


def resolve_firsts(corrections: DataFrame, key: str = "repo", order: str = "seq") -> DataFrame:
    """The first record of each key from a table of corrections. A key has a record a batch at
    most, and usually one. Rows equal in key and order count as one."""
    return first_per_key(corrections, key, order).dropDuplicates([key]).select(*corrections.columns)


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, unless the session has chosen a store."""
    before = spark.conf.get(STATE_STORE, None)
    if before in (None, DEFAULT_STORE):
        spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def drain_to_table(stream: DataFrame, table_path: str, checkpoint: str) -> DataFrame:
    """Run until the input is used up, appending to Parquet, and read it back."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with rocksdb_state(stream.sparkSession):
        query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table_path)


def into_collection(
    stream: DataFrame,
    name: str,
    checkpoint: str,
    store: Callable[[DataFrame, str], object],
    compact_after: int = 50,
) -> None:
    """Run a stream until its input is used up, and store every batch in a collection once.

    ``store(batch, tag)`` adds a batch under its tag, which the collection's manifest
    remembers in the same step. A batch that is run again finds its tag there and does nothing;
    one that was lost half way left files that no version names. The checkpoint folder names
    the run. Whenever ``compact_after`` files are small ones, they are put together.
    """
    spark = stream.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        tag = f"{run}:{batch_id}"
        if collection.has_batch(spark, name, tag):
            return
        store(batch, tag)
        if collection.small_files(spark, name) >= compact_after:
            collection.compact(spark, name)

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    with rocksdb_state(spark):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def index_stream(
    stream: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, compact_after: int = 50
) -> DataFrame:
    """Store the records that ``build`` makes of every batch in collection ``name``, and read it.

    Records are worked out once a batch. Those whose id the collection has already are left
    out, so a run started anew over the same files, in other batches, adds nothing.
    """

    def store(batch: DataFrame, tag: str) -> None:
        built = materialize(build(batch), "built")
        collection.append(collection.new_records(built, name), name, tag)

    into_collection(stream, name, checkpoint, store, compact_after)
    return collection.read(stream.sparkSession, name)
