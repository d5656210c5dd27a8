"""A user table stored in buckets by key, changed by batches that touch only their own buckets.

``data/version=n/bucket=b`` holds the rows of bucket b as batch n left them, and
``log/batch=n`` one row per bucket that batch n wrote. The log is written last: a batch
counts from then on, and until then its folders are read by nobody and are overwritten
when it is run again. The current version of a bucket is the last batch in the log that wrote it, so a
batch reads the buckets of its changes as earlier batches left them, rewrites these, and
leaves all others alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewloom.operators.keyed import from_history, history
from reviewloom.schemas import USERS
from reviewloom.session import stored
from reviewloom.sources.folders import numbered_folders

BUCKETS = 1024
_ROWS = USERS.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", ") + ", bucket int"
_LOG = "bucket int, buckets int, rows long"
_OUTCOME = "seq long, op string, email string, outcome string, status string, code int, message string, username string"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, number: int, touched: list[int], buckets: int) -> None:
    """Write the touched buckets as batch ``number`` leaves them, then the log."""
    spark, folder = rows.sparkSession, f"{path}/data/version={number}"
    placed = rows.select(*USERS.fieldNames(), _bucket(F.col("email"), buckets).alias("bucket"))
    placed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(folder)
    counts = spark.read.schema(_ROWS).parquet(folder).groupBy("bucket").count()
    log = (spark.createDataFrame([(b,) for b in touched], "bucket int").join(counts, "bucket", "left")
           .select("bucket", F.lit(buckets).alias("buckets"), F.coalesce("count", F.lit(0)).alias("rows")))
    log.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch={number}")


def create(table: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store a table as batch 0. All buckets are logged, so that an empty one is known to be empty."""
    _write(table, path, 0, list(range(buckets)), buckets)


def versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """bucket, buckets, version, rows of the current versions, or of those that batch ``before`` starts from."""
    numbers = [n for n in numbered_folders(spark, f"{path}/log", "batch") if before is None or n < before]
    if not numbers:
        raise ValueError(f"no stored table at {path}")
    log = spark.read.schema(_LOG + ", batch int").option("basePath", f"{path}/log").parquet(
        *(f"{path}/log/batch={n}" for n in numbers))
    return log.groupBy("bucket").agg(F.max("buckets").alias("buckets"), F.max("batch").alias("version"),
                                     F.max_by("rows", "batch").alias("rows"))


def _read(spark: SparkSession, path: str, current: dict[int, int]) -> DataFrame:
    """The rows of these versions of buckets, none of them empty."""
    if not current:
        return spark.createDataFrame([], USERS)
    return spark.read.schema(USERS).parquet(*(f"{path}/data/version={v}/bucket={b}" for b, v in sorted(current.items())))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table after all batches so far."""
    current = {r["bucket"]: r["version"] for r in versions(spark, path).where("rows > 0").collect()}  # one row per bucket
    return _read(spark, path, current)


def apply_batch(changes: DataFrame, path: str, number: int) -> DataFrame:
    """Apply a batch of changes in ``seq`` order; one outcome per change.

    Batches are numbered from 1. A batch that is in the log already is not applied again: its outcomes are read.
    """
    spark = changes.sparkSession
    outcomes = f"{path}/outcomes/batch={number}"
    if number in numbered_folders(spark, f"{path}/log", "batch"):
        return spark.read.schema(_OUTCOME).parquet(outcomes)
    current = {r["bucket"]: r for r in versions(spark, path, number).collect()}
    buckets = current[0]["buckets"]
    changes = stored(changes.withColumn("bucket", _bucket(F.col("email"), buckets)), "changes")
    touched = sorted(r["bucket"] for r in changes.select("bucket").distinct().collect())  # at most one row per bucket
    old = _read(spark, path, {b: current[b]["version"] for b in touched if current[b]["rows"]})
    after, judged = from_history(stored(history(old, changes.drop("bucket")), "history"))
    judged.write.mode("overwrite").parquet(outcomes)
    _write(after, path, number, touched, buckets)
    return spark.read.schema(_OUTCOME).parquet(outcomes)
