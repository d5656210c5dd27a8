"""Readers and writers for the driver tables, users, subjects, messages and the vector index."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.fixed_values import INDEX_REQUIRED
from reviewloom.schemas import INDEX, MESSAGES, SUBJECT, USERS
from reviewloom.session import stored
from reviewloom.sources.folders import remove_folder
from reviewloom.sources.records import read_json_lists
from reviewloom.sources.segments import add_segment, read_segments, segments


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    """Nested subject records with their position by file name and list place; one object or a list of them.

    One long list is read in many tasks. A missing path gives an empty table of the same schema.
    """
    try:
        return read_json_lists(spark, path, SUBJECT, "pos").drop("__file")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SUBJECT).withColumn("pos", F.lit(0).cast("long"))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USERS).parquet(path)


def read_users_jdbc(spark: SparkSession, url: str, table_name: str = "users", **options: str) -> DataFrame:
    """Users from a relational database; ``options`` carry driver, credentials and read partitioning."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table_name).options(**options).load()


def stream_messages(spark: SparkSession, path: str, bytes_per_batch: int = 512 * 1024 * 1024) -> DataFrame:
    """Message files as a stream; the size of a micro-batch bounds what one conversation can hold in it."""
    return spark.readStream.schema(MESSAGES).option("maxBytesPerTrigger", bytes_per_batch).parquet(path)


# --- vector index -----------------------------------------------------------
def write_index(index: DataFrame, path: str) -> bool:
    """Write vectors with their metadata as the first segment; an empty index writes nothing. Tells whether it wrote.

    The rows are stored before they are counted, so that a model sees each text once.
    """
    index = stored(index, "built")
    if index.isEmpty():
        return False
    remove_folder(index.sparkSession, path)
    add_segment(index, path, "build")
    return True


def missing_index_fields(index: DataFrame) -> list[str]:
    """Required fields that the index has neither as a column nor in ``meta``."""
    present = set(index.columns)
    if "meta" in present:
        present |= set(index.schema["meta"].dataType.fieldNames())
    return [name for name in INDEX_REQUIRED if name not in present]


def load_index(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the index; where there is none, build and write it first.

    A stored index without a required field gives a warning. An empty build is
    not written, and gives an empty index.
    """
    try:
        index = read_segments(spark, path)
        index = spark.read.parquet(path) if index is None else index
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        if not write_index(build(), path):
            return spark.createDataFrame([], INDEX)
        index = read_segments(spark, path)
    if lacking := missing_index_fields(index):
        warnings.warn(f"the index at {path} lacks {', '.join(lacking)}", stacklevel=2)
    return spread(index, "vec_id")


def append_index(index_path: str, existing: DataFrame, added: DataFrame, key: str | None = None) -> None:
    """Append numbered, normalised vectors under the ids that follow.

    With a ``key`` the same rows can be sent again: they are added once. An index
    that was not written by ``write_index`` is searched for its highest id.
    """
    if segments(existing.sparkSession, index_path):
        add_segment(added, index_path, key or uuid.uuid4().hex)
        return
    start = existing.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)).alias("start")).first()["start"]
    added.withColumn("vec_id", F.col("vec_id") + F.lit(start)).write.mode("append").parquet(index_path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over all cores when the files give fewer tasks than there are cores.

    Text work per row is heavy, so a table in a few large row groups would keep
    most cores idle. A table of many files already has enough tasks and stays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
