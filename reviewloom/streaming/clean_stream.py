"""Incremental cleaning: new raw reviews to the cleaned table, the first of equal contents, whatever arrives first.

A micro-batch writes its own folder of the sink and, beside the sink, one narrow row
per review it added: site, digest of the content, arrival number. These rows are the
state. A later copy of a content is found by its digest and compared with the text in the
sink; it is left out, unless its arrival number is smaller: then it is added, and its
row says which one it replaces. With ``keep_batches`` only the rows of that many
micro-batches are kept, so the state is bounded; a copy of an older content is added once
more, and reading takes the first one.

Each micro-batch overwrites its own folders and looks only at those of earlier ones, so a
batch that is run again after a failure leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.operators.cleaning import add_features, apply_rules, keep_first
from reviewloom.schemas import CLEAN_REVIEW
from reviewloom.session import stored
from reviewloom.sources.folders import numbered_folders, remove_folder
from reviewloom.sources.reviews import read_clean

_SEEN = "site string, digest long, ingest_seq long, replaces long"


def digest(content: Column) -> Column:
    return F.xxhash64(content)


def _earlier(spark: SparkSession, sink: str, batch_id: int, keep_batches: int | None) -> DataFrame | None:
    """The state rows that this micro-batch may look at."""
    seen = f"{sink}-seen"
    since = 0 if keep_batches is None else batch_id - keep_batches
    numbers = [n for n in numbered_folders(spark, seen, "batch") if since <= n < batch_id]
    if not numbers:
        return None
    return spark.read.schema(_SEEN).option("basePath", seen).parquet(*(f"{seen}/batch={n}" for n in numbers))


def add_batch(rows: DataFrame, batch_id: int, sink: str, keep_batches: int | None = None) -> None:
    """Add one micro-batch's rows, to which the rules have been applied."""
    spark = rows.sparkSession
    firsts = keep_first(rows, ["site", "content"], ["ingest_seq"])
    earlier = _earlier(spark, sink, batch_id, keep_batches)
    kept = firsts.withColumn("replaces", F.lit(None).cast("long"))
    if earlier is not None:
        firsts = stored(firsts, "firsts")
        texts = read_clean(spark, sink).select("site", F.col("ingest_seq").alias("old"), F.col("content").alias("old_content"))
        alike = firsts.select("site", digest(F.col("content")).alias("digest"), "content").join(
            earlier.select("site", "digest", F.col("ingest_seq").alias("old")), ["site", "digest"])
        copies = (alike.join(texts, ["site", "old"]).where(F.col("content") == F.col("old_content"))
                  .groupBy("site", "content").agg(F.min("old").alias("replaces")))
        kept = stored(firsts.join(copies, ["site", "content"], "left").where("replaces IS NULL OR ingest_seq < replaces"), "kept")
    columns, folder = [f.name for f in CLEAN_REVIEW.fields], f"{sink}/batch={batch_id}"
    add_features(kept).select(*columns).write.mode("overwrite").parquet(folder)
    added = kept if earlier is not None else read_clean(spark, folder).withColumn("replaces", F.lit(None).cast("long"))
    added.select("site", digest(F.col("content")).alias("digest"), "ingest_seq", "replaces").write.mode("overwrite").parquet(
        f"{sink}-seen/batch={batch_id}")
    if keep_batches is not None:
        for number in numbered_folders(spark, f"{sink}-seen", "batch"):
            if number < batch_id - keep_batches:
                remove_folder(spark, f"{sink}-seen/batch={number}")


def start_cleaning(raw: DataFrame, sink: str, checkpoint: str, as_of: str | None = None,
                   keep_batches: int | None = None) -> StreamingQuery:
    """Clean what has arrived, then stop. A later start goes on from the checkpoint."""
    return (apply_rules(raw, as_of).writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, batch_id: add_batch(batch, batch_id, sink, keep_batches))
            .trigger(availableNow=True).start())


def read_cleaned(spark: SparkSession, sink: str, keep_batches: int | None = None) -> DataFrame:
    """The first review of each site and content; ``keep_batches`` as the stream had it."""
    rows = read_clean(spark, sink)
    if keep_batches is not None:
        first = rows.groupBy("site", "content").agg(F.min("ingest_seq").alias("ingest_seq"))
        return rows.join(first, ["site", "content", "ingest_seq"], "left_semi")
    replaced = spark.read.schema(_SEEN).parquet(f"{sink}-seen").where("replaces IS NOT NULL").select(
        "site", F.col("replaces").alias("ingest_seq"))
    return rows.join(replaced, ["site", "ingest_seq"], "left_anti")
