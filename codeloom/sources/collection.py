"""Vector collections: typed tables whose versions are lists of Parquet files.

A collection has a catalog entry for its name, schema and place. Below the place ``data`` holds
files that are never changed, and ``manifests`` a small table a version: the files of the version,
how many rows they have, the range of repositories in them, and the batches that are committed. A write
adds files and then one manifest, so readers see all of it or none, and a lost job leaves
only files that no version names. One writer at a time: a second one fails on its manifest.

Files are clustered by repository and id, bounded in rows, and carry Bloom filters, so
questions to one repository read its files and row groups alone.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.workspace import folder_names, materialize, remove

VECTOR_DIM = 1024

# Widths in bytes of the text fields of a collection.
FIELD_WIDTHS = {
    "id": 36,
    "repo_name": 200,
    "language": 20,
    "chunk_file": 200,
    "chunk_lines": 50,
    "chunk_code": 10000,
    "summary": 2000,
}

COLLECTION_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in FIELD_WIDTHS]
    + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


#: Rows of a file, about.
ROWS_PER_FILE = 50_000
#: What files are clustered by, of the columns that a collection has.
CLUSTER = ("repo_name", "id")
CLUSTERED = "codeloom.cluster"
MANIFEST = "file string, rows long, bytes long, low string, high string, batch string"


def _base(spark: SparkSession, name: str) -> str:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'")
    return described.first()["data_type"].rstrip("/").removesuffix("/schema")


def create_collection(
    spark: SparkSession,
    name: str,
    path: str,
    schema: T.StructType = COLLECTION_SCHEMA,
    cluster: tuple[str, ...] = CLUSTER,
) -> None:
    """Create the collection if it is missing. The catalog entry has the schema and the place;
    rows are read with ``read``. Files are clustered by those columns of ``cluster`` that it has."""
    if spark.catalog.tableExists(name):
        return
    by = ",".join(c for c in cluster if c in schema.names)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING PARQUET LOCATION '{path.rstrip('/')}/schema' "
        f"COMMENT 'files of the current version are listed in manifests' TBLPROPERTIES ('{CLUSTERED}' = '{by}')"
    )


def drop_collection(spark: SparkSession, name: str, files: bool = False) -> None:
    """Forget the collection; with ``files`` all its versions go as well."""
    base = _base(spark, name) if files and spark.catalog.tableExists(name) else None
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if base:
        remove(spark, base)


def versions(spark: SparkSession, name: str) -> list[int]:
    """Numbers of the versions whose manifests are complete."""
    base = f"{_base(spark, name)}/manifests"
    return [int(v[1:]) for v in folder_names(spark, base) if "_SUCCESS" in folder_names(spark, f"{base}/{v}")]


def manifest(spark: SparkSession, name: str, version: int | None = None) -> DataFrame:
    """(file, rows, bytes, low, high, batch) of a version, the last one if none is named."""
    known = versions(spark, name)
    if version is None:
        version = known[-1] if known else None
    elif version not in known:
        raise ValueError(f"{name} has no version {version}")
    if version is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{_base(spark, name)}/manifests/v{version:09d}")


def read(spark: SparkSession, name: str, repo_name: str | None = None, version: int | None = None) -> DataFrame:
    """The rows of a collection, or of one repository, in its last or a named version.

    The files of a version, a row a file, are listed by the driver as Spark lists the files of
    any table. Those whose range leaves ``repo_name`` out are not opened; of the others row groups
    are pruned by their statistics and Bloom filters.
    """
    listed = manifest(spark, name, version).where("file IS NOT NULL")
    if repo_name is not None:
        listed = listed.where(F.col("low").isNull() | F.lit(repo_name).between(F.col("low"), F.col("high")))
    files = [r["file"] for r in listed.select("file").distinct().collect()]
    rows = _rows(spark, name, files)
    return rows if repo_name is None else rows.where(F.col("repo_name") == repo_name)


def _rows(spark: SparkSession, name: str, files: list[str]) -> DataFrame:
    schema = spark.table(name).schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _written(rows: DataFrame, name: str, n_rows: int, rows_per_file: int, batch: str | None) -> DataFrame:
    """Write rows as new files, and their lines of a manifest."""
    spark = rows.sparkSession
    place = f"{_base(spark, name)}/data/{uuid.uuid4().hex}"
    by = [c for c in spark.sql(f"SHOW TBLPROPERTIES {name} ('{CLUSTERED}')").first()["value"].split(",") if c]
    parts = max(1, math.ceil(n_rows / rows_per_file))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by) if by else rows.repartition(parts)
    writer = dealt.write
    for column in by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(place)
    stored = spark.read.schema(rows.schema).parquet(place)
    ends = [F.min("repo_name"), F.max("repo_name")] if "repo_name" in by[:1] else [F.lit(None).cast("string")] * 2
    of = stored.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    listed = of.agg(F.count("*").alias("rows"), ends[0].alias("low"), ends[1].alias("high"))
    return listed.withColumn("batch", F.lit(batch).cast("string")).select("file", "rows", "bytes", "low", "high", "batch")


def _commit(spark: SparkSession, name: str, lines: DataFrame) -> None:
    """Write the manifest of the next version; fails if there is one."""
    known = versions(spark, name)
    following = known[-1] + 1 if known else 0
    lines.coalesce(1).write.parquet(f"{_base(spark, name)}/manifests/v{following:09d}")


def fault(dim: int = VECTOR_DIM) -> Column:
    """Why a record can't be stored at all, or null."""
    bad_dim = F.col("embedding").isNull() | (F.size("embedding") != dim)
    return F.when(F.col("id").isNull(), F.lit("id is missing")).when(bad_dim, F.lit("embedding has the wrong dimension"))


def too_wide(widths: dict[str, int] = FIELD_WIDTHS) -> Column:
    """The first field beyond its declared width, or null. Such a record can be stored."""
    reason = F.lit(None).cast("string")
    for field, width in reversed(widths.items()):
        reason = F.when(F.octet_length(field) > width, F.lit(f"{field} is too long")).otherwise(reason)
    return reason


def reject_reason(widths: dict[str, int] = FIELD_WIDTHS, dim: int = VECTOR_DIM) -> Column:
    """First constraint a record breaks, or null. Only a missing id is null-checked."""
    missing = F.when(F.col("id").isNull(), F.lit("id is missing"))
    return F.coalesce(missing, too_wide(widths), fault(dim))


def validate(
    records: DataFrame, widths: dict[str, int] = FIELD_WIDTHS, dim: int = VECTOR_DIM
) -> tuple[DataFrame, DataFrame]:
    """Records a collection takes, and rejected ones with a ``reason``.

    Records are worked out and checked once and written, so that what is costly in them, as
    summaries and vectors, is neither computed again for the filter nor for the other part.
    """
    checked = materialize(records.withColumn("reason", reject_reason(widths, dim)), "checked")
    return (
        checked.where(F.col("reason").isNull()).drop("reason"),
        checked.where(F.col("reason").isNotNull()),
    )


def has_batch(spark: SparkSession, name: str, batch: str) -> bool:
    return not manifest(spark, name).where(F.col("batch") == batch).isEmpty()


def append(
    records: DataFrame, name: str, batch: str | None = None, staged: bool = False, rows_per_file: int = ROWS_PER_FILE
) -> bool:
    """Add records as a new version. Whether they were added: a ``batch`` that is committed
    already is not added again, an empty one is remembered.

    Records are worked out once and staged before they are counted and clustered, unless
    the caller says that they are ``staged``, that is read from where they were written.
    """
    spark = records.sparkSession
    if batch is not None and has_batch(spark, name, batch):
        return False
    rows = records.select(*spark.table(name).columns)
    rows = rows if staged else materialize(rows, "staged")
    n_rows = rows.count()
    if not n_rows and batch is None:
        return True
    known = manifest(spark, name)
    if n_rows:
        lines = _written(rows, name, n_rows, rows_per_file, batch)
    else:
        lines = spark.createDataFrame([(None, 0, 0, None, None, batch)], MANIFEST)
    _commit(spark, name, known.unionByName(lines))
    return True


def new_records(records: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Records whose key the collection does not have, each key once. Only keys are compared:
    those that are there already, as few as the records at most, are left out."""
    known = read(records.sparkSession, name).select(key)
    there = known.join(records.select(key), key, "left_semi").distinct()
    return records.join(there, key, "left_anti").dropDuplicates([key])


def _replaced(spark: SparkSession, name: str, files: list[str], rows: DataFrame, rows_per_file: int) -> None:
    """A version in which ``rows`` stand for what was in ``files``. Committed batches stay known."""
    known = manifest(spark, name)
    kept = known.where(F.col("file").isNull() | ~F.col("file").isin(files))
    ledger = known.where(F.col("file").isin(files) & F.col("batch").isNotNull()).select("batch").distinct()
    blank = {"file": "string", "rows": "long", "bytes": "long", "low": "string", "high": "string"}
    remembered = ledger.select(*[F.lit(None).cast(t).alias(n) for n, t in blank.items()], "batch")
    lines = kept.unionByName(remembered)
    n_rows = rows.count()
    if n_rows:
        lines = lines.unionByName(_written(rows, name, n_rows, rows_per_file, None))
    _commit(spark, name, lines)


def delete_where(spark: SparkSession, name: str, condition: Column, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Leave the rows that meet the condition out of a new version, and how many files were
    written anew for it: those that hold such rows. All other files are the same ones."""
    hit = F.coalesce(condition, F.lit(False))
    found = read(spark, name).where(hit).select(F.col("_metadata.file_path").alias("file")).distinct()
    files = [r["file"] for r in found.collect()]
    if files:
        _replaced(spark, name, files, _rows(spark, name, files).where(~hit), rows_per_file)
    return len(files)


def small_files(spark: SparkSession, name: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Files of less than half of ``rows_per_file`` rows."""
    return manifest(spark, name).where((F.col("rows") * 2 < rows_per_file) & F.col("file").isNotNull()).count()


def compact(spark: SparkSession, name: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Put files of less than half of ``rows_per_file`` rows together, and how many there were."""
    small = manifest(spark, name).where(F.col("rows") * 2 < rows_per_file).where("file IS NOT NULL")
    files = [r["file"] for r in small.select("file").collect()]
    if len(files) < 2:
        return 0
    _replaced(spark, name, files, _rows(spark, name, files), rows_per_file)
    return len(files)


def vacuum(spark: SparkSession, name: str, keep: int = 1) -> int:
    """Forget all but the last ``keep`` versions, and remove files that none of them names; how
    many. Only when no job reads or writes an older version."""
    known = versions(spark, name)
    lines = None
    for version in known[-keep:]:
        one = manifest(spark, name, version).select("file")
        lines = one if lines is None else lines.unionByName(one)
    if lines is None:
        return 0
    named = {r["file"].rsplit("/", 2)[1] + "/" + r["file"].rsplit("/", 1)[1] for r in lines.where("file IS NOT NULL").distinct().collect()}
    base = _base(spark, name)
    gone = 0
    for folder in folder_names(spark, f"{base}/data"):
        files = [f for f in folder_names(spark, f"{base}/data/{folder}") if f.endswith(".parquet")]
        dead = [f for f in files if f"{folder}/{f}" not in named]
        gone += len(dead)
        if len(dead) == len(files):
            remove(spark, f"{base}/data/{folder}")
        else:
            for file in dead:
                remove(spark, f"{base}/data/{folder}/{file}")
    for version in known[:-keep]:
        remove(spark, f"{base}/manifests/v{version:09d}")
    return gone


def with_batch_number(records: DataFrame, order_col: str, batch_size: int = 10) -> DataFrame:
    """Number the batches of ``batch_size`` records in the order of a unique column.

    Records are dealt to ranges of the column by sampled bounds and kept so. Only the
    count of each range, a row for each partition whatever the values, is summed up in
    one place; the numbering itself runs per range.
    """
    ranged = records.repartitionByRange(order_col).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    in_range = F.row_number().over(Window.partitionBy("_range").orderBy(order_col))
    position = F.col("_before") + in_range - 1
    return (
        ranged.join(before, "_range")
        .withColumn("batch_no", F.floor(position / batch_size).cast("bigint"))
        .drop("_range", "_before")
    )
