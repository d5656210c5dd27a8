"""An index that grows by segments, each added once and under ids of its own.

``segment=n`` holds the rows of segment n. ``_log/n`` says where its ids begin, how many there are
and under which key it was added; it is created only if no other is there, so two writers
never get the same number or ids. ``_log/n.done`` follows when the rows are written: only such
segments are read. Adding under a key that is done adds nothing; a key that was claimed but broke off is
written again in its own place. The next id comes from the log, not from the rows.
"""

from __future__ import annotations

import json
import time
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F


class Segment(NamedTuple):
    number: int
    start: int
    count: int
    key: str
    done: bool


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file; tells whether it was not there before."""
    files, where = _file(spark, path)
    try:
        out = files.create(where, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName() or files.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _text(spark: SparkSession, path: str, tries: int = 100) -> str:
    """The content of a small file; its writer may have created it just now."""
    files, where = _file(spark, path)
    for _ in range(tries):
        source = files.open(where)
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        source.close()
        if text:
            return text
        time.sleep(0.05)
    raise ValueError(f"{path} was created but never written; remove it")


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """All segments in the log, by number."""
    files, where = _file(spark, f"{path}/_log")
    if not files.exists(where):
        return []
    names = {status.getPath().getName() for status in files.listStatus(where)}
    out = []
    for name in names:
        if name.isdigit():
            said = json.loads(_text(spark, f"{path}/_log/{name}"))
            out.append(Segment(int(name), said["start"], said["count"], said["key"], f"{name}.done" in names))
    return sorted(out)


def _claimed(spark: SparkSession, path: str, key: str, count: int) -> Segment:
    """The segment of a key: the one it had, or a new one after all others."""
    while True:
        known = segments(spark, path)
        for segment in known:
            if segment.key == key:
                if segment.count != count and not segment.done:
                    raise ValueError(f"{key!r} was claimed for {segment.count} rows, now there are {count}")
                return segment
        number = known[-1].number + 1 if known else 0
        start = known[-1].start + known[-1].count if known else 0
        if _create(spark, f"{path}/_log/{number}", json.dumps({"start": start, "count": count, "key": key})):
            return Segment(number, start, count, key, False)


def add_segment(rows: DataFrame, path: str, key: str, id_column: str = "vec_id") -> Segment:
    """Add rows numbered from 0 under the ids that follow those of all segments before."""
    spark = rows.sparkSession
    known = [s for s in segments(spark, path) if s.key == key]
    if known and known[0].done:
        return known[0]
    segment = _claimed(spark, path, key, rows.count())
    placed = rows.withColumn(id_column, F.col(id_column) + F.lit(segment.start).cast("long"))
    placed.write.mode("overwrite").parquet(f"{path}/segment={segment.number}")
    _create(spark, f"{path}/_log/{segment.number}.done", "")
    return segment._replace(done=True)


def read_segments(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all segments that are done, or None."""
    done = [s for s in segments(spark, path) if s.done]
    if not done:
        return None
    return spark.read.parquet(*(f"{path}/segment={s.number}" for s in done))
