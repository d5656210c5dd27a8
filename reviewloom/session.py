"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "reviewloom", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time and adaptive execution.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    command and the cluster's own defaults decide.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # whole pages and documents travel to Python: limit batches by size as well
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once per Spark context.

    Needed where it was neither installed on the executors nor named in
    ``--py-files``; Spark's own file distribution carries it.
    """
    context = spark.sparkContext
    if any(name.startswith("reviewloom") for name in getattr(context, "_python_includes", [])):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="reviewloom-source-")) / "reviewloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    context.addPyFile(str(archive))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that every executor can reach.

    A cluster must name the folder. Only a session whose executors are threads of
    this process may leave it unset; it then gets a folder of its own for its
    lifetime, which is removed when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="reviewloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    Used where a result feeds several later steps: it is computed once, a lost
    executor does not bring its whole history back, and its size on disk lets
    later joins choose a broadcast only when it is small.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
