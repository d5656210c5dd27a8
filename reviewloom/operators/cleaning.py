"""Cleaning rules: one lazy plan, one shuffle (first-wins de-duplication)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from reviewloom.fixed_values import (DATE_MIN, LENGTH_ABOVE, LENGTH_BELOW, RATING_MAX, RATING_MIN,
                                     SOURCE_CAP, TOKEN_LIMIT)
from reviewloom.functions.dates import parse_date, weekday_name
from reviewloom.functions.text import strip_specials, tokens, trim_space

_EMAIL = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]{1,64}@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"

_SLICES = 256
_FIXED = (T.NumericType, T.TimestampType, T.DateType, T.BooleanType)


def _as_of(as_of: str | None) -> Column:
    return F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()


def _dated(df: DataFrame) -> DataFrame:
    if df.schema["date"].dataType.typeName() == "string":
        return df.withColumn("date", parse_date(F.col("date")))
    return df.withColumn("date", F.col("date").cast("timestamp"))


def _within_length(size: Column) -> Column:
    # one mention of the length: the filter moves below the projection and takes
    # the pattern replacement with it, once per mention
    return F.width_bucket(size.cast("double"), F.lit(LENGTH_ABOVE + 1.0), F.lit(float(LENGTH_BELOW)), F.lit(1)) == 1


def apply_rules(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """All row rules but de-duplication; stateless, so it also runs on a stream.

    The length limits are taken after special characters go and before the trim.
    """
    valid = (
        _dated(df.select("site", "ingest_seq", "rating", "date", "content"))
        .dropna(subset=["rating", "date", "content"])
        .filter(F.col("rating").between(RATING_MIN, RATING_MAX))
        .filter(F.col("date").between(F.lit(DATE_MIN).cast("timestamp"), _as_of(as_of)))
        .withColumn("content", strip_specials(F.col("content")))
        .withColumn("review_length", F.length("content"))
        .filter(_within_length(F.col("review_length")))
    )
    return valid.withColumn("content", trim_space(F.col("content")))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``.

    An aggregation, not a window: each task sends at most one row per key, so
    copies that fill a third of the table cost no more than others. Where one
    column orders the rows and the others have a fixed size, each is carried by
    itself, and Spark hashes instead of sorting whole texts; the order is then
    unique within a key, or equal rows are taken for each other.
    """
    others = [c for c in df.columns if c not in keys]
    if len(order) == 1 and all(isinstance(df.schema[c].dataType, _FIXED) for c in others):
        return df.groupBy(*keys).agg(*[F.min_by(c, order[0]).alias(c) for c in others]).select(*df.columns)
    rest = F.struct(*[F.col(c) for c in others])
    first = df.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("__first"))
    return first.select(*keys, "__first.*").select(*df.columns)


def add_features(df: DataFrame, token_limit: int = TOKEN_LIMIT) -> DataFrame:
    return (
        df.withColumn("tokenized_content", tokens(F.col("content"), token_limit))
        .withColumn("weekday", weekday_name(F.col("date")))
        .withColumn("text_length", F.length("content"))
    )


def clean_reviews(df: DataFrame, as_of: str | None = None, token_limit: int = TOKEN_LIMIT) -> DataFrame:
    """Raw to cleaned reviews with derived features, of them the first ``token_limit`` tokens."""
    return add_features(keep_first(apply_rules(df, as_of), ["site", "content"], ["ingest_seq"]), token_limit)


def audit(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Rows per site and outcome: the first rule that removes a row, or ``kept``.

    Copies are counted from group sizes, so the table is read and shuffled once.
    """
    dated = df.select("site", "rating", "content", F.col("date").alias("raw_date"), "date")
    dated = _dated(dated).withColumn("bare", strip_specials(F.col("content")))
    size = F.length("bare")
    outcome = (
        F.when(F.col("rating").isNull() | F.col("raw_date").isNull() | F.col("content").isNull(), "missing")
        .when(~F.col("rating").between(RATING_MIN, RATING_MAX), "rating")
        .when(F.col("date").isNull(), "bad_date")
        .when(~F.col("date").between(F.lit(DATE_MIN).cast("timestamp"), _as_of(as_of)), "date")
        .when((size <= LENGTH_ABOVE) | (size >= LENGTH_BELOW), "length")
        .otherwise("kept")
    )
    groups = (
        dated.withColumn("reason", outcome)
        .withColumn("text", F.when(F.col("reason") == "kept", trim_space(F.col("bare"))))
        .groupBy("site", "reason", "text").agg(F.count("*").alias("copies"))
    )
    totals = groups.groupBy("site", "reason").agg(
        F.sum("copies").alias("n_rows"), F.count("*").alias("n_groups"))
    split = F.when(
        F.col("reason") == "kept",
        F.array(F.struct(F.lit("kept").alias("reason"), F.col("n_groups").alias("n")),
                F.struct(F.lit("duplicate").alias("reason"), (F.col("n_rows") - F.col("n_groups")).alias("n"))),
    ).otherwise(F.array(F.struct(F.col("reason").alias("reason"), F.col("n_rows").alias("n"))))
    return totals.select("site", F.inline(split)).filter("n > 0").select("site", "reason", "n")


# --- rules of the collecting step -------------------------------------------
def with_required_fields(df: DataFrame) -> DataFrame:
    """Collected items that have a rating, a date and a body."""
    return df.dropna(subset=["rating", "date", "content"])


def distinct_reviews(df: DataFrame) -> DataFrame:
    """First of equal ``(rating, date, content)`` within a site."""
    return keep_first(df, ["site", "rating", "date", "content"], ["ingest_seq"])


def distinct_contents(df: DataFrame) -> DataFrame:
    """First of equal contents within a site, across filter tabs in tab order."""
    return keep_first(df, ["site", "content"], ["filter_index", "ingest_seq"])


def cap_per_site(df: DataFrame, limit: int = SOURCE_CAP) -> DataFrame:
    """The first ``limit`` rows of each site in arrival order.

    Each of many slices of a site is cut to ``limit`` first, so the last step
    sees a bounded number of rows however many tasks read the site.
    """
    slices = Window.partitionBy("site", "__slice").orderBy("ingest_seq")
    near = (df.withColumn("__slice", F.pmod(F.xxhash64("ingest_seq"), F.lit(_SLICES)))
            .withColumn("arrival", F.row_number().over(slices)).filter(F.col("arrival") <= limit).drop("__slice"))
    whole = Window.partitionBy("site").orderBy("ingest_seq")
    return near.withColumn("arrival", F.row_number().over(whole)).filter(F.col("arrival") <= limit)


def split_valid_emails(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a well-formed address, and the rest.

    The pattern approximates a mail-address validator: one @, a dotted domain,
    no two dots in a row, no dot at either end of the local part.
    """
    ok = F.coalesce(is_email(F.col("email")), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def is_email(c: Column) -> Column:
    local_dots = c.startswith(".") | c.contains("..") | c.contains(".@")
    return c.rlike(_EMAIL) & ~local_dots
