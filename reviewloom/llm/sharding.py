"""Contiguous shards of equal byte size by global prefix sums (native).

Only ids, sizes and check sums are moved. They are range-partitioned by id and
written once with the number of their range; totals per range become offsets,
a running sum inside each range completes the global prefix sum, and the shard
of a document is where the middle of its bytes falls among equal targets.

Law ``bytes``: shards are runs of consecutive ids with nearly equal sizes. The
groups (equal texts) have no say in it: copies lie wherever their ids lie.

Defined cases: a null text has no bytes and is stored like an empty one (8 bytes
of framing, check sum 0); null ids come first; rows that repeat an id keep one
place each; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reviewloom.session import stored

#: Bytes of framing that each document costs besides its text.
FRAMING = 8


def sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    data = F.encode(F.coalesce(F.col(text_column), F.lit("")), "utf-8")
    return docs.select(F.col(id_column).alias("doc_id"),
                       (F.octet_length(data) + FRAMING).cast("long").alias("size"),
                       F.crc32(data).alias("text_crc32"))


def assign_shards(docs: DataFrame, shards: int = 24, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard (null here)."""
    order = ["doc_id", "size", "text_crc32"]
    ranged = stored(
        sizes(docs, id_column, text_column).repartitionByRange(*order)
        .withColumn("part", F.spark_partition_id()), "shard-sizes")
    # one row per range: as many as there are partitions
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    doubled_middle = 2 * (F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))) + F.col("size")
    placed = (
        ranged.join(F.broadcast(offsets), "part")
        .select(*order, "total", (F.col("rows_before") + F.count(F.lit(1)).over(inside)).alias("rank"),
                doubled_middle.alias("doubled_middle"))
        .select(*order, "rank", F.expr(f"int((doubled_middle * {shards}) div (2 * total))").alias("shard"))
    )
    starts = placed.groupBy("shard").agg(F.min("rank").alias("start"))  # at most ``shards`` rows
    return placed.join(F.broadcast(starts), "shard").select(
        *order, F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write the documents below one folder per shard, in slot order; ids must be unique."""
    places = assigned.select(F.col("doc_id").alias(id_column), "shard", "slot")
    (docs.join(places, id_column).repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
