"""Numbered folders of a table, on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the folders ``name=n`` in ``path`` whose writing was completed."""
    files, where = _at(spark, path)
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    found = sorted(int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}="))
    return [n for n in found if files.exists(_at(spark, f"{path}/{name}={n}/_SUCCESS")[1])]


def remove_folder(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)
