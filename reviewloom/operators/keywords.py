"""Top keywords per site and their comparison across sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reviewloom.fixed_values import SITES


def keyword_counts(clean: DataFrame, stopwords: DataFrame | list[str]) -> DataFrame:
    """Occurrences of each lower-cased token per site, without stop-words.

    ``stopwords`` is a list or a table ``word``; NULLs in it remove nothing. They
    are removed by an anti-join on the counted words, which are far fewer than
    the tokens.
    """
    words = clean.select("site", F.explode("tokenized_content").alias("word")).select(
        "site", F.lower("word").alias("word"))
    counts = words.groupBy("site", "word").agg(F.count("*").alias("n"))
    if isinstance(stopwords, list):
        stopwords = clean.sparkSession.createDataFrame([(w,) for w in stopwords], "word string")
    unwanted = stopwords.filter(F.col("word").isNotNull()).select("word").distinct()
    return counts.join(unwanted, "word", "left_anti").select("site", "word", "n")


def top_keywords(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent words of each site; equal counts in word order."""
    ranked = Window.partitionBy("site").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)


def compare_sites(counts: DataFrame, sites=SITES) -> DataFrame:
    """One row per word with its count and its weight (share of the site's top count) on each site."""
    peaks = counts.groupBy("site").agg(F.max("n").alias("peak"))
    weighted = counts.join(F.broadcast(peaks.filter(F.col("site").isin(*sites))), "site")
    per_site = []
    for s in sites:
        here = F.col("site") == s
        per_site.append(F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias(f"n_{s}"))
        per_site.append(F.coalesce(F.max(F.when(here, F.col("n") / F.col("peak"))), F.lit(0.0)).alias(f"weight_{s}"))
    return weighted.groupBy("word").agg(*per_site)
