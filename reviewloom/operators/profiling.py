"""Profiles of raw and cleaned reviews.

Every profile groups on a few small keys, so partial aggregation leaves a
handful of rows per task before anything is shuffled. Exact quantiles and
histograms work on counts per distinct length, never on the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reviewloom.fixed_values import OUTLIER_RULES, SITES, WEEKDAYS
from reviewloom.functions.dates import weekday_name

BINS = 30


def weekday_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, i + 1) for i, d in enumerate(WEEKDAYS)], "weekday string, ord int")


def site_weekday_dimension(spark: SparkSession, sites=SITES) -> DataFrame:
    rows = [(s, d, i + 1) for s in sites for i, d in enumerate(WEEKDAYS)]
    return spark.createDataFrame(rows, "site string, weekday string, ord int")


def in_weekday_order(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Sort Monday to Sunday."""
    return df.join(F.broadcast(weekday_dimension(spark)), "weekday").orderBy("ord")


def weekday_summary(clean: DataFrame) -> DataFrame:
    """Count, mean rating and mean length per weekday over all sites, Monday first."""
    summary = clean.filter(F.col("weekday").isNotNull()).groupBy("weekday").agg(
        F.count("content").alias("review_count"),
        F.avg("rating").alias("avg_rating"),
        F.avg("text_length").alias("avg_length"),
    )
    return in_weekday_order(summary, clean.sparkSession).select(
        "weekday", "review_count", "avg_rating", "avg_length")


def site_weekday_counts(clean: DataFrame, sites=SITES) -> DataFrame:
    """Reviews per site and weekday; a day without reviews counts 0."""
    counts = clean.filter(F.col("weekday").isNotNull()).groupBy("site", "weekday").agg(
        F.count("*").alias("n"))
    whole = site_weekday_dimension(clean.sparkSession, sites)
    return whole.join(counts, ["site", "weekday"], "left").select(
        "site", "weekday", F.coalesce("n", F.lit(0)).cast("long").alias("review_count"))


def site_weekday_means(clean: DataFrame, column: str, name: str) -> DataFrame:
    return (clean.filter(F.col("weekday").isNotNull()).groupBy("site", "weekday")
            .agg(F.avg(column).alias(name)))


def weekday_counts_in_order(dated: DataFrame) -> DataFrame:
    """Rows per weekday in fixed order; an absent day stays, with NULL."""
    counts = (dated.select(weekday_name(F.col("date")).alias("weekday"))
              .filter(F.col("weekday").isNotNull()).groupBy("weekday").agg(F.count("*").alias("review_count")))
    return (weekday_dimension(dated.sparkSession).join(counts, "weekday", "left")
            .orderBy("ord").select("weekday", "ord", "review_count"))


def rating_shares(df: DataFrame) -> DataFrame:
    """Rows per site and rating, and their share of the site."""
    counts = (df.filter(F.col("rating").isNotNull()).groupBy("site", "rating")
              .agg(F.count("*").alias("n")))
    site_total = F.sum("n").over(Window.partitionBy("site"))
    return counts.withColumn("share", F.col("n") / site_total)


def length_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per group and text length; the number of lengths is bounded by the longest text."""
    return (df.filter(F.col("content").isNotNull())
            .groupBy(*by, F.length("content").alias("len")).agg(F.count("*").alias("n")))


def length_histogram(df: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width bins between the shortest and the longest text of each site.

    The last bin includes its right edge and empty bins are kept. Where all
    lengths are equal the range widens by one half on both sides.
    """
    counts = length_counts(df, ["site"])
    site = Window.partitionBy("site")
    ranged = counts.select(
        "site", "len", "n", F.min("len").over(site).alias("lo"), F.max("len").over(site).alias("hi"))
    spread = F.col("hi") - F.col("lo")
    position = F.floor((F.col("len") - F.col("lo")).cast("long") * bins / spread) + 1
    bin_no = F.when(spread == 0, F.lit(bins // 2 + 1)).otherwise(F.least(position, F.lit(bins))).cast("int")
    filled = ranged.groupBy("site", bin_no.alias("bin")).agg(F.sum("n").alias("n"))
    edges = counts.groupBy("site").agg(
        F.min("len").cast("double").alias("lo"), F.max("len").cast("double").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(
        "site",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return edges.join(filled, ["site", "bin"], "left").select(
        "site", "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_from"),
        (F.col("lo") + F.col("bin") * width).alias("bin_to"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def length_box(df: DataFrame, by: list[str]) -> DataFrame:
    """Exact quartiles, whiskers at 1.5 interquartile ranges, rows outside them.

    ``by`` must hold no NULL. Quartiles interpolate linearly.
    """
    counts = length_counts(df, by)
    quartiles = counts.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.expr("percentile(len, array(0.25D, 0.5D, 0.75D), n)").alias("q"))
    quartiles = quartiles.select(
        *by, F.col("n").alias("total"),
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fenced = counts.join(quartiles, by).withColumn(
        "inside", F.col("len").between(F.col("q1") - reach, F.col("q3") + reach))
    return fenced.groupBy(*by, "total", "q1", "median", "q3").agg(
        F.min(F.when(F.col("inside"), F.col("len"))).alias("whisker_low"),
        F.max(F.when(F.col("inside"), F.col("len"))).alias("whisker_high"),
        F.sum(F.when(F.col("inside"), F.lit(0)).otherwise(F.col("n"))).cast("long").alias("outliers"))


def length_by_rating(df: DataFrame) -> DataFrame:
    """Mean length and box statistics per site and rating."""
    rated = df.filter(F.col("rating").isNotNull())
    means = rated.filter(F.col("content").isNotNull()).groupBy("site", "rating").agg(
        F.avg(F.length("content")).alias("avg_length"))
    return length_box(rated, ["site", "rating"]).join(means, ["site", "rating"])


def daily_counts(df: DataFrame) -> DataFrame:
    """Rows per site and day, in date order."""
    return (df.filter(F.col("date").isNotNull()).groupBy("site", F.to_date("date").alias("day"))
            .agg(F.count("*").alias("n")).orderBy("site", "day"))


def calendar_counts(df: DataFrame) -> DataFrame:
    """Rows per site by year, by month, by day of week and by day of month, in one pass."""
    parts = df.filter(F.col("date").isNotNull()).select(
        "site", F.year("date").alias("y"), F.month("date").alias("m"),
        F.weekday("date").alias("dow"), F.dayofmonth("date").alias("dom"))
    sets = parts.groupingSets(
        [[F.col("site"), F.col(c)] for c in ("y", "m", "dow", "dom")], "site", "y", "m", "dow", "dom")
    counts = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    unit = (F.when(F.col("gid") == 0b00111, "year").when(F.col("gid") == 0b01011, "month")
            .when(F.col("gid") == 0b01101, "weekday").otherwise("day"))
    return counts.select(
        "site", unit.alias("unit"), F.coalesce("y", "m", "dow", "dom").cast("long").alias("part"), "n")


# --- outliers ---------------------------------------------------------------
def flag_outliers(df: DataFrame, as_of: str | None = None, rules=OUTLIER_RULES) -> DataFrame:
    """Length and date flags by site rule; a site without a rule gets NULL flags."""
    limit = df.sparkSession.createDataFrame(list(rules), "site string, min_len int, max_len int, min_date string")
    now: Column = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    size = F.length("content")
    return (
        df.join(F.broadcast(limit), "site", "left")
        .withColumn("length_outlier", (size < F.col("min_len")) | (size > F.col("max_len")))
        .withColumn("date_outlier", (F.col("date") < F.col("min_date").cast("timestamp")) | (F.col("date") > now))
        .drop("min_len", "max_len", "min_date")
    )


def outlier_shares(df: DataFrame, as_of: str | None = None, rules=OUTLIER_RULES) -> DataFrame:
    flagged = flag_outliers(df, as_of, rules)
    return flagged.groupBy("site").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("length_outlier"), 1)).alias("length_outliers"),
        F.avg(F.col("length_outlier").cast("double")).alias("length_share"),
        F.count(F.when(F.col("date_outlier"), 1)).alias("date_outliers"),
        F.avg(F.col("date_outlier").cast("double")).alias("date_share"))


def site_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("site").agg(F.count("*").alias("n"))
