"""Readers and writers for review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from reviewloom.fixed_values import DEFAULT_PLACE, SITES
from reviewloom.schemas import CLEAN_REVIEW, RAW_REVIEW
from reviewloom.sources.arrival import numbered, with_places
from reviewloom.sources.records import read_csv

# a file of that name, or a folder of that name with part files
_RAW_FILE = r"/reviews_([^/.]+)\.csv(?:/[^/]*)?$"
_CLEAN_FILE = r"/preprocessed_reviews_([^/.]+)\.csv(?:/[^/]*)?$"


def read_raw_csv(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Raw reviews as ``site, ingest_seq, rating, date, content``.

    ``site`` names the site of every row; without it the site is taken from
    file names such as ``reviews_<site>.csv`` and files of unknown sites are
    skipped. ``ingest_seq`` grows with the file name and the row's place in the
    file, which is the arrival order that first-wins rules need. One large file is
    read in many tasks, also where bodies hold line feeds and quotes.
    """
    rows = read_csv(spark, path, RAW_REVIEW, "ingest_seq", check_header=True).withColumn(
        "site", F.lit(site) if site else F.regexp_extract(F.col("__file"), _RAW_FILE, 1))
    return rows.filter(F.col("site").isin(*SITES)).select(
        "site", "ingest_seq", F.col("rating").try_cast("double").alias("rating"), "date", "content")


def read_collection(spark: SparkSession, path: str, site: str) -> DataFrame:
    """A whole JSON-lines collection of one site without its ``_id``; empty is an error."""
    schema = T.StructType([T.StructField("_id", T.StringType()), *RAW_REVIEW.fields])
    read = spark.read.schema(schema).json(path)
    if read.isEmpty():
        raise ValueError(f"No data found in collection: {path}")
    return numbered(with_places(read).drop("_id"), "ingest_seq").select(
        F.lit(site).alias("site"), "ingest_seq",
        F.col("rating").try_cast("double").alias("rating"), "date", "content",
    )


def split_known_sites(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of supported sites, and the others with the reason they are refused."""
    known = F.col("site").isin(*SITES)
    refused = df.filter(~F.coalesce(known, F.lit(False))).withColumn(
        "reason",
        F.concat(F.lit("Unknown site_name: "), F.coalesce("site", F.lit("None")),
                 F.lit(f". Supported sites: {list(SITES)}")),
    )
    return df.filter(known), refused


def union_sites(frames: dict[str, DataFrame]) -> DataFrame:
    """One table from a frame per site, each tagged with its site."""
    tagged = [df.withColumn("site", F.lit(site)) for site, df in frames.items()]
    whole = tagged[0]
    for df in tagged[1:]:
        whole = whole.unionByName(df, allowMissingColumns=True)
    return whole


# --- cleaned tables ---------------------------------------------------------
def write_clean(df: DataFrame, path: str, mode: str = "replace_sites") -> None:
    """Write a cleaned table partitioned by site.

    ``replace_sites`` overwrites only the sites present in ``df``, so running a
    site again gives the same table; ``append`` adds the rows once more.
    """
    writer = df.write.partitionBy("site")
    if mode == "append":
        writer.mode("append").parquet(path)
    elif mode == "replace_sites":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        raise ValueError(f"unknown mode: {mode}")


def write_clean_with_summary(df: DataFrame, path: str, mode: str = "replace_sites") -> DataFrame:
    """Write, and return one summary row per site counted during the same pass."""
    seen = Observation()
    counts = [F.count(F.when(F.col("site") == s, 1)).alias(s) for s in SITES]
    write_clean(df.observe(seen, *counts), path, mode)
    rows = [
        (site, int(n), f"review_{site}", f"preprocessed_reviews_{site}",
         f"Review preprocessing completed successfully for {site}. Processed {n} records.")
        for site, n in seen.get.items() if n
    ]
    return df.sparkSession.createDataFrame(
        rows, "site_name string, processed_count long, source_collection string, target_collection string, message string"
    )


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLEAN_REVIEW).parquet(path)


def write_clean_csv(df: DataFrame, path: str) -> None:
    """CSV form, one folder per site; CSV has no arrays, so tokens are JSON text."""
    (df.withColumn("tokenized_content", F.to_json("tokenized_content"))
     .write.partitionBy("site").mode("overwrite").option("header", True).option("escape", '"').csv(path))


def read_preprocessed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records to index from ``preprocessed_reviews_<site>.csv`` files.

    Files that vanish or cannot be read are skipped. ``site`` and ``platform``
    are the site in the file name; subject and place are constants. ``meta``
    holds them as the index needs it, so the records can be indexed as they are.
    """
    schema = T.StructType([
        T.StructField("rating", T.StringType()), T.StructField("date", T.StringType()),
        T.StructField("content", T.StringType()), T.StructField("review_length", T.StringType()),
        T.StructField("tokenized_content", T.StringType()), T.StructField("weekday", T.StringType()),
        T.StructField("text_length", T.StringType()),
    ])
    rows = read_csv(spark, path, schema, "ingest_seq", ignoreMissingFiles=True, ignoreCorruptFiles=True)
    records = rows.withColumn("site", F.regexp_extract(F.col("__file"), _CLEAN_FILE, 1)).select(
        "site", "ingest_seq", "content", F.col("rating").try_cast("double").alias("rating"),
        F.coalesce("date", F.lit("")).alias("date"), F.col("site").alias("platform"),
        F.lit(DEFAULT_PLACE).alias("subject"), F.lit(DEFAULT_PLACE).alias("place"))
    return records.withColumn("meta", F.struct("platform", "subject", "place", "date", "rating", F.lit("").alias("url")))


def write_preprocessed_csv(df: DataFrame, path: str) -> None:
    """Cleaned reviews of one site in the published columns, in arrival order."""
    columns = ("rating", "date", "content", "review_length", "tokenized_content", "weekday", "text_length")
    (df.repartitionByRange("ingest_seq").sortWithinPartitions("ingest_seq")
     .withColumn("tokenized_content", F.to_json("tokenized_content"))
     .withColumn("date", F.date_format("date", "yyyy-MM-dd")).select(*columns)
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Scraped reviews, only the three published columns."""
    (df.select("rating", "date", "content").write.mode("overwrite")
     .option("header", True).option("escape", '"').csv(path))
