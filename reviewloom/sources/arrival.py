"""The order in which rows stand in their files.

Spark packs files into tasks by size, so a plain row counter follows file sizes
and core counts. Here rows are numbered by file name, then place in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reviewloom.session import stored

_ROW_BITS = (1 << 33) - 1
_PLACE = ("__file", "__block", "__row")


def with_places(read: DataFrame) -> DataFrame:
    """A table just read from files, with where each row stands; call it before anything else."""
    return read.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().bitwiseAND(_ROW_BITS).alias("__row"))


def numbered(placed: DataFrame, name: str, skip: int = 0, keep: tuple[str, ...] | list[str] = (),
             settled: bool = False) -> DataFrame:
    """Consecutive numbers from 0 in order of file name and place.

    A block of a file is read by one task from beginning to end, so inside it the
    task's own row counter tells the order; blocks are put one after the other by
    running sums over one row per block. The counters of two scans need not agree, so
    the rows are stored once and both sides read them there, unless they are ``settled``:
    derived from rows that have been stored with their places.

    The first ``skip`` rows of a file are not numbered and marked ``__skipped``; ``keep`` names
    helper columns that stay.
    """
    placed = placed if settled else stored(placed, "arrivals")
    blocks = placed.groupBy("__file", "__block").agg(F.min("__row").alias("__low"), F.count(F.lit(1)).alias("__n"))
    files = blocks.groupBy("__file").agg(F.greatest(F.sum("__n") - skip, F.lit(0)).alias("__n"))
    earlier_files = Window.partitionBy(F.lit(0)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("__file", F.coalesce(F.sum("__n").over(earlier_files), F.lit(0)).alias("__start"))
    offsets = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).join(starts, "__file")
    joined = placed.hint("merge").join(offsets.drop("__n"), ["__file", "__block"])
    place = F.col("__before") + F.col("__row") - F.col("__low")
    return joined.withColumns({name: F.col("__start") + place - skip, "__skipped": place < skip}).drop(
        *(c for c in (*_PLACE, "__low", "__before", "__start", "__skipped") if c not in keep))
