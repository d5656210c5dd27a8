"""Ordered operators whose groups may be larger than any one task should hold.

A plain window over a key sends the whole key to one task. These helpers cut
each key into ranges of its order column, run the window inside a range, and
carry one summary row per range over to the ranges that follow. The result is
that of the plain window. Keys and order must not be NULL.

Ranges follow the rows, not the values: a key with few rows is one range however far
its values lie apart, and a key with many is cut by its own extent and count. Where a
part holds far more rows than the others, it is cut once more by its own extent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.session import stored

RANGE_WIDTH = 4096
_RANGE = "__range"


def _cut(df: DataFrame, parts: list[str], order: str, limit: int, width: int, name: str) -> DataFrame:
    """Number the parts' rows by steps of equal extent, as many as make ``width`` rows each on average.

    Only parts with more than ``limit`` rows are cut; the table of these is small, and is all that is joined.
    """
    large = (df.where(" AND ".join(f"{p} IS NOT NULL" for p in parts)).groupBy(*parts)
             .agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__low"), F.max(order).alias("__high"))
             .where(F.col("__n") > limit)
             .select(*(F.col(p).alias(f"__large_{p}") for p in parts), "__low",
                     F.greatest(F.lit(1), F.ceil((F.col("__high").cast("double") - F.col("__low").cast("double") + 1)
                                                 / F.ceil(F.col("__n") / width))).cast("long").alias("__step")))
    met = df.join(large, [F.col(p) == F.col(f"__large_{p}") for p in parts], "left")
    return met.withColumn(name, F.floor((F.col(order).cast("double") - F.col("__low").cast("double")) / F.col("__step"))).drop(
        "__low", "__step", *(f"__large_{p}" for p in parts))


def with_ranges(df: DataFrame, keys: list[str], order: str, width: int = RANGE_WIDTH, name: str = _RANGE) -> DataFrame:
    """Add the range of each row in its key: about ``width`` rows, in order of a whole number unique within the key."""
    first = _cut(df, keys, order, width, width, "__first")
    both = _cut(first, [*keys, "__first"], order, 4 * width, width, "__second")
    return both.withColumn(name, F.struct(F.coalesce("__first", F.lit(0)).alias("first"),
                                          F.coalesce("__second", F.lit(0)).alias("second"))).drop("__first", "__second")


def _with_range(df: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    return df if _RANGE in df.columns else with_ranges(df, keys, order, width)


def drop_range(df: DataFrame) -> DataFrame:
    return df.drop(_RANGE)


def carry_forward(df: DataFrame, keys: list[str], order: str, values: dict[str, Column],
                  width: int = RANGE_WIDTH) -> DataFrame:
    """Add, for each name, the last non-NULL value strictly before the row in its key.

    ``order`` is a number, unique within a key. The helper column of ranges
    stays in the result for the next ordered operator; ``drop_range`` ends it.
    """
    ranged = _with_range(df, keys, order, width)
    names = list(values)
    for name, value in values.items():
        ranged = ranged.withColumn(f"__v_{name}", value)

    inside = Window.partitionBy(*keys, _RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)

    ends = ranged.groupBy(*keys, _RANGE).agg(*[
        F.max_by(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))).alias(f"__c_{n}")
        for n in names
    ])
    carried = ends.select(*keys, _RANGE, *[
        F.last(F.col(f"__c_{n}"), ignorenulls=True).over(before).alias(f"__c_{n}") for n in names
    ])
    local = ranged.select("*", *[
        F.last(F.col(f"__v_{n}"), ignorenulls=True).over(inside).alias(f"__l_{n}") for n in names
    ])
    joined = local.join(carried, [*keys, _RANGE])
    for n in names:
        joined = joined.withColumn(n, F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}")))
    return joined.drop(*[f"__{p}_{n}" for p in "vcl" for n in names])


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str,
                width: int = RANGE_WIDTH) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key up to and including this one."""
    ranged = _with_range(df, keys, order, width).withColumn("__v", value)
    inside = Window.partitionBy(*keys, _RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)

    totals = ranged.groupBy(*keys, _RANGE).agg(F.sum("__v").alias("__t"))
    offsets = totals.select(*keys, _RANGE, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    local = ranged.withColumn("__l", F.sum("__v").over(inside))
    return (local.join(offsets, [*keys, _RANGE])
            .withColumn(name, F.col("__l") + F.col("__o")).drop("__v", "__l", "__o"))


def number_rows(df: DataFrame, group: str, order: str, name: str, groups: tuple[str, ...]) -> DataFrame:
    """Consecutive numbers from 0 over all rows, ordered by ``(group, order)``.

    Groups come in the order of ``groups``, then all others by name. Ranges are
    cut by sampled splitters, so they are even wherever the rows lie; they are
    written once with their number, and a running sum over one row per range
    gives each range its first number.
    """
    listed = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(group))
    place = F.when(listed > 0, listed).otherwise(len(groups) + 1)
    keys = ["__place", group, order]
    ranged = stored(df.withColumn("__place", place).repartitionByRange(*keys)
                    .withColumn(_RANGE, F.spark_partition_id()), "numbered")
    earlier = Window.partitionBy(F.lit(0)).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(_RANGE).agg(F.count("*").alias("__n")).select(
        _RANGE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(_RANGE).orderBy(*keys)
    return (ranged.withColumn("__at", F.row_number().over(inside)).join(starts, _RANGE)
            .withColumn(name, (F.col("__start") + F.col("__at") - 1).cast("long"))
            .drop("__place", _RANGE, "__at", "__start"))
