"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewloom.session import stored


def _least(links: DataFrame, strict: bool) -> DataFrame:
    """Each (u, v) with the smallest of u's neighbours and u; combined before it is shuffled."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    if not strict:
        least = least.withColumn("m", F.least("m", "u"))
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_least(both, strict=False).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down, strict=True)
    return (near.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v"))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that can be reached) of every node with links; ``links`` has u and v.

    Every round is written to the shared folder, so lineage stays short; the
    rounds end when a round changes no link.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "links")
    while True:
        after = stored(_small_star(_large_star(edges).distinct()).distinct(), "links")
        changed = not after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if not changed:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
