"""Exact duplicates by sorting contents (native).

Texts are equal when they are the same after white space is deleted. Splitters
that Spark samples cut the rows by the first characters of the normalised text
and its hash; every range is sorted externally, equal texts become neighbours,
and whole texts are compared there. The splitters are short keys, so the sample
on the driver does not hold texts.

A text with so many copies that its run would make one range too large never
enters the sort: such texts are counted first, and one aggregation, combined on
the map side, finds the copy that stays. A run in the sort is therefore bounded
by ``HEAVY_ROWS`` rows, or ``rows / MOST_HEAVY`` in a very large table, and there are at
most ``MOST_HEAVY`` heavy texts. Only their hashes, digests and ids are broadcast.

Defined cases: a null text counts as empty; empty texts are copies of each
other; a null id stays only where no copy has an id; of rows that repeat the
same id and text one stays. An empty table gives an empty table. Other columns
travel inside the struct ``row``, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.session import stored

#: The characters that are deleted before texts are compared: \x20 and \x09-\x0D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: A text with more copies is aggregated instead of sorted.
HEAVY_ROWS = 1000
#: Texts at most that are counted apart, in a table that is broadcast: a hash or a digest and an id each.
MOST_HEAVY = 100_000
#: Characters of the normalised text in a sort key that splitters are made of.
KEY_CHARS = 24


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                longest: bool = True) -> DataFrame:
    """One row per input row: ``row`` (its columns), keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points stays, then the one with the
    smallest id; with ``longest=False`` the smallest id alone decides.
    """
    text = F.col("row")[text_column]
    length = F.char_length(F.coalesce(text, F.lit(""))) if longest else F.lit(0)
    keyed = (
        docs.select(F.struct("*").alias("row"))
        .withColumn("content", normalised(text))
        .select("row", F.left("content", F.lit(KEY_CHARS)).alias("head"), F.xxhash64("content").alias("hash"))
    )
    limit = max(HEAVY_ROWS, docs.count() // MOST_HEAVY)
    heavy = F.broadcast(keyed.groupBy("hash").count().where(F.col("count") > limit).select("hash"))
    places = dict(id=F.col("row")[id_column], length=length, content=normalised(text))

    run = Window.partitionBy("head", "hash", "content").orderBy(
        F.desc("length"), F.col("id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    light = (
        keyed.join(heavy, "hash", "left_anti").repartitionByRange("head", "hash").withColumns(places)
        .select("row", "content", F.first("id").over(whole).alias("keep_id"),
                F.count(F.lit(1)).over(whole).alias("group_size"),
                (F.row_number().over(run) == 1).alias("kept"))
    )

    copies = stored(keyed.join(heavy, "hash", "left_semi").drop("head", "hash").withColumns(places)
                    .withColumn("place", F.struct((-F.col("length")).alias("short"), F.col("id").isNull().alias("absent"),
                                                  F.col("id").alias("id"), F.xxhash64("row").alias("row"))), "frequent")
    chosen = F.broadcast(copies.groupBy("content").agg(F.min("place").alias("best"), F.count(F.lit(1)).alias("group_size"))
                         .select(F.sha2("content", 256).alias("text_sha256"), "best", "group_size"))
    marked = (copies.withColumn("text_sha256", F.sha2("content", 256)).join(chosen, "text_sha256")
              .select("row", F.col("best.id").alias("keep_id"), "group_size", F.col("place").eqNullSafe(F.col("best")).alias("first"),
                      "text_sha256"))
    # rows alike in every column are one row with their number, of which one is kept
    alike = F.broadcast(marked.where("first").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("alike")))
    numbered = marked.join(alike, "text_sha256")
    several = F.col("first") & (F.col("alike") > 1)
    names = ["row", "keep_id", "group_size", "kept", "text_sha256"]
    counted = numbered.where(several).groupBy("row", "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    copies = numbered.where(~several).withColumnRenamed("first", "kept").select(names).unionByName(
        counted.withColumn("kept", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda k: k == 1))).select(names))
    return light.withColumn("text_sha256", F.sha2("content", 256)).drop("content").unionByName(copies)


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with their own columns."""
    return mark_copies(docs, id_column, text_column).where("kept").select("row.*")
