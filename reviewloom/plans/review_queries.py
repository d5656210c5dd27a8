"""Cleaning, profiling and keyword queries over the lines of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.fixed_values import DATE_LABEL, OUTLIER_RULES, SITES
from reviewloom.functions.dates import normalise_labelled_date, parse_date
from reviewloom.functions.text import split_words
from reviewloom.operators import cleaning, keywords, profiling
from reviewloom.plans import derived
from reviewloom.plans.oracle_parts import CLEAN, REVIEWS, SITE_LIST, words
from reviewloom.sources.reviews import split_known_sites
from reviewloom.sources.tables import table

STOPWORDS = ["the", "of", "and", "to", "in", "de", "la", "der", "die"]


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def shown(clean: DataFrame) -> DataFrame:
    """A cleaned table with comparable types."""
    return clean.select(
        "site", "ingest_seq", "rating", _day("date").alias("day"), "content",
        F.col("review_length").cast("long").alias("review_length"), F.col("text_length").cast("long").alias("text_length"),
        "weekday", F.array_join("tokenized_content", " ").alias("token_text"),
        F.size("tokenized_content").cast("long").alias("n_tokens"))


def clean_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return shown(derived.cleaned(spark, folder))


def clean_audit(spark, folder):
    return cleaning.audit(derived.reviews(spark, folder), derived.AS_OF)


def distinct_reviews(spark, folder):
    return cleaning.distinct_reviews(derived.reviews(spark, folder)).select(
        "site", "ingest_seq", "rating", _day("date").alias("day"), "content")


def distinct_contents(spark, folder):
    tabs = derived.reviews(spark, folder).withColumn("filter_index", F.col("doc_id") % 4)
    return cleaning.distinct_contents(tabs).select("site", "filter_index", "ingest_seq", "content")


def dedup_first(spark, folder):
    return cleaning.keep_first(cleaning.apply_rules(derived.reviews(spark, folder), derived.AS_OF),
                               ["site", "content"], ["ingest_seq"]).select("site", "ingest_seq")


def weekday_feature(spark, folder):
    return cleaning.add_features(derived.reviews(spark, folder)).select("ingest_seq", "weekday")


def site_cap(spark, folder):
    return cleaning.cap_per_site(derived.reviews(spark, folder)).select(
        "site", "ingest_seq", F.col("arrival").cast("long").alias("arrival"))


def labelled_dates(spark, folder):
    raw = F.when(F.col("rating").isNull(), f"{DATE_LABEL}: x").when(
        F.col("rating") < 3, _day("date")).otherwise(F.date_format("date", f"'{DATE_LABEL}': yyyy년 M월 d일"))
    return derived.reviews(spark, folder).select("ingest_seq", raw.alias("raw_date")).withColumn(
        "date_text", normalise_labelled_date(F.col("raw_date")))


def parsed_dates(spark, folder):
    form = F.col("line_no") % 6
    raw = (F.when(form == 0, F.date_format("date", "yyyy.MM.dd")).when(form == 1, F.date_format("date", "yyyy.M.d."))
           .when(form == 2, F.date_format("date", "yyyy년 M월 d일")).when(form == 3, F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
           .when(form == 4, _day("date")).otherwise("no date"))
    return derived.reviews(spark, folder).select("ingest_seq", raw.alias("raw_date")).withColumn(
        "day", F.date_format(parse_date(F.col("raw_date")), "yyyy-MM-dd"))


def known_sites(spark, folder):
    known, refused = split_known_sites(derived.unknown_sites(spark, folder))
    return known.withColumn("reason", F.lit(None).cast("string")).unionByName(refused)


def valid_emails(spark, folder):
    shape = F.col("c_mktsegment")
    name = F.lower("c_name")
    email = (F.when(shape == "AUTOMOBILE", F.concat(F.replace(name, F.lit("#"), F.lit(".")), F.lit("@example.com")))
             .when(shape == "BUILDING", F.concat(name, F.lit("@mail.example.co.kr")))
             .when(shape == "FURNITURE", F.concat(name, F.lit("@localhost")))
             .when(shape == "MACHINERY", F.concat(F.replace(name, F.lit("#"), F.lit("..")), F.lit("@example.com")))
             .otherwise(name))
    ok, bad = cleaning.split_valid_emails(table(spark, folder, "customer").select("c_custkey", email.alias("email")))
    return ok.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


def raw_site_counts(spark, folder):
    return profiling.site_counts(derived.reviews(spark, folder))


# --- profiles ---------------------------------------------------------------
def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def weekday_summary(spark, folder):
    return _rounded(profiling.weekday_summary(derived.cleaned(spark, folder)), "avg_rating", "avg_length")


def site_weekday_count(spark, folder):
    return profiling.site_weekday_counts(derived.cleaned(spark, folder))


def site_weekday_avg_rating(spark, folder):
    return _rounded(profiling.site_weekday_means(derived.cleaned(spark, folder), "rating", "avg_rating"), "avg_rating")


def site_weekday_avg_length(spark, folder):
    return _rounded(profiling.site_weekday_means(derived.cleaned(spark, folder), "text_length", "avg_length"), "avg_length")


def weekday_counts_in_order(spark, folder):
    counts = profiling.weekday_counts_in_order(derived.reviews(spark, folder))
    return counts.withColumn("ord", F.col("ord").cast("long"))


def rating_share(spark, folder):
    return _rounded(profiling.rating_shares(derived.reviews(spark, folder)), "share")


def length_histogram30(spark, folder):
    bins = profiling.length_histogram(derived.reviews(spark, folder))
    return _rounded(bins.withColumn("bin", F.col("bin").cast("long")), "bin_from", "bin_to")


def _box(df: DataFrame) -> DataFrame:
    for c in ("total", "whisker_low", "whisker_high", "outliers"):
        df = df.withColumn(c, F.col(c).cast("long"))
    return _rounded(df, "q1", "median", "q3")


def length_boxplot(spark, folder):
    return _box(profiling.length_box(derived.reviews(spark, folder), ["site"]))


def length_by_rating(spark, folder):
    return _rounded(_box(profiling.length_by_rating(derived.reviews(spark, folder))), "avg_length")


def daily_counts(spark, folder):
    return profiling.daily_counts(derived.reviews(spark, folder)).withColumn("day", F.col("day").cast("string"))


def calendar_grouping_sets(spark, folder):
    return profiling.calendar_counts(derived.reviews(spark, folder))


def outlier_share(spark, folder):
    return _rounded(profiling.outlier_shares(derived.reviews(spark, folder), derived.AS_OF), "length_share", "date_share")


# --- keywords ---------------------------------------------------------------
def top_keywords_by_site(spark, folder):
    counts = keywords.keyword_counts(derived.cleaned(spark, folder), STOPWORDS)
    return keywords.top_keywords(counts, 20).withColumn("rank", F.col("rank").cast("long"))


def keyword_pivot(spark, folder):
    stops = table(spark, folder, "benchmark").select(F.explode(split_words(F.lower("text"))).alias("word"))
    pivoted = keywords.compare_sites(keywords.keyword_counts(derived.cleaned(spark, folder), stops))
    return _rounded(pivoted, *[f"weight_{s}" for s in SITES])


QUERIES = {f.__name__: f for f in (
    clean_reviews, clean_audit, dedup_first, weekday_feature, distinct_reviews, distinct_contents, site_cap,
    labelled_dates, parsed_dates, known_sites, valid_emails, raw_site_counts, weekday_summary, site_weekday_count,
    site_weekday_avg_rating, site_weekday_avg_length, weekday_counts_in_order, rating_share, length_histogram30,
    length_boxplot, length_by_rating, daily_counts, calendar_grouping_sets, outlier_share, top_keywords_by_site,
    keyword_pivot)}

_DAYS = "(VALUES ('Monday',1),('Tuesday',2),('Wednesday',3),('Thursday',4),('Friday',5),('Saturday',6),('Sunday',7)) d(weekday, ord)"
_SITES = f"(SELECT unnest({SITE_LIST}) AS site) s"
_RULES = "(VALUES " + ", ".join(f"('{s}', {a}, {b}, TIMESTAMP '{d}')" for s, a, b, d in OUTLIER_RULES) + ") r(site, min_len, max_len, min_date)"
_BOX = """fenced AS (SELECT *, len BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM lens JOIN q USING ({by}))
SELECT {by}, count(*) AS total, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  min(len) FILTER (inside) AS whisker_low, max(len) FILTER (inside) AS whisker_high,
  count(*) FILTER (NOT inside) AS outliers{more} FROM fenced GROUP BY {by}"""


def _box_sql(by: str, condition: str, more: str = "") -> str:
    return f"""WITH {REVIEWS}, lens AS (SELECT *, length(content) AS len FROM reviews_v WHERE content IS NOT NULL AND {condition}),
q AS (SELECT {by}, quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.5) AS median, quantile_cont(len, 0.75) AS q3
  FROM lens GROUP BY {by}), """ + _BOX.format(by=by, more=more)


SQL = {
    "clean_reviews": f"""WITH {CLEAN} SELECT site, ingest_seq, rating, strftime(date, '%Y-%m-%d') AS day, content,
        review_length, text_length, weekday, array_to_string(tokens, ' ') AS token_text, len(tokens) AS n_tokens FROM clean""",
    "clean_audit": f"""WITH {CLEAN}, judged AS (SELECT site, CASE
          WHEN rating IS NULL OR date IS NULL OR content IS NULL THEN 'missing'
          WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating'
          WHEN date NOT BETWEEN TIMESTAMP '2022-01-01' AND TIMESTAMP '2025-01-01' THEN 'date'
          WHEN s.ingest_seq IS NULL THEN 'length' WHEN f.ingest_seq IS NULL THEN 'duplicate' ELSE 'kept' END AS reason
        FROM reviews_v v LEFT JOIN (SELECT ingest_seq FROM ruled) s USING (ingest_seq)
        LEFT JOIN (SELECT ingest_seq FROM first_rows) f USING (ingest_seq))
        SELECT site, reason, count(*) AS n FROM judged GROUP BY ALL""",
    "dedup_first": f"WITH {CLEAN} SELECT site, ingest_seq FROM first_rows",
    "weekday_feature": f"WITH {REVIEWS} SELECT ingest_seq, dayname(date) AS weekday FROM reviews_v",
    "distinct_reviews": f"""WITH {REVIEWS} SELECT site, min(ingest_seq) AS ingest_seq, rating, strftime(date, '%Y-%m-%d') AS day, content
        FROM reviews_v GROUP BY site, rating, date, content""",
    "distinct_contents": f"""WITH {REVIEWS} SELECT site, doc_id % 4 AS filter_index, ingest_seq, content FROM reviews_v
        QUALIFY row_number() OVER (PARTITION BY site, content ORDER BY doc_id % 4, ingest_seq) = 1""",
    "site_cap": f"""WITH {REVIEWS} SELECT site, ingest_seq, row_number() OVER (PARTITION BY site ORDER BY ingest_seq) AS arrival
        FROM reviews_v QUALIFY arrival <= 500""",
    "labelled_dates": f"""WITH {REVIEWS} SELECT ingest_seq,
        CASE WHEN rating IS NULL THEN '작성일: x' WHEN rating < 3 THEN strftime(date, '%Y-%m-%d')
          ELSE '작성일: ' || strftime(date, '%Y년 %-m월 %-d일') END AS raw_date,
        CASE WHEN rating IS NULL THEN '작성일: x' WHEN rating < 3 THEN strftime(date, '%Y-%m-%d')
          ELSE strftime(date, '%Y.%m.%d') END AS date_text FROM reviews_v""",
    "parsed_dates": f"""WITH {REVIEWS} SELECT ingest_seq,
        CASE line_no % 6 WHEN 0 THEN strftime(date, '%Y.%m.%d') WHEN 1 THEN strftime(date, '%Y.%-m.%-d.')
          WHEN 2 THEN strftime(date, '%Y년 %-m월 %-d일') WHEN 3 THEN strftime(date, '%Y-%m-%d %H:%M:%S')
          WHEN 4 THEN strftime(date, '%Y-%m-%d') ELSE 'no date' END AS raw_date,
        CASE WHEN line_no % 6 < 5 THEN strftime(date, '%Y-%m-%d') END AS day FROM reviews_v""",
    "known_sites": f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN source ELSE {SITE_LIST}[doc_id % 3 + 1] END AS site,
        CASE WHEN doc_id % 4 = 3 THEN 'Unknown site_name: ' || source ||
          '. Supported sites: [''kakaomap'', ''myrealtrip'', ''tripdotcom'']' END AS reason FROM documents""",
    "valid_emails": """WITH e AS (SELECT c_custkey, CASE c_mktsegment
          WHEN 'AUTOMOBILE' THEN replace(lower(c_name), '#', '.') || '@example.com'
          WHEN 'BUILDING' THEN lower(c_name) || '@mail.example.co.kr' WHEN 'FURNITURE' THEN lower(c_name) || '@localhost'
          WHEN 'MACHINERY' THEN replace(lower(c_name), '#', '..') || '@example.com' ELSE lower(c_name) END AS email FROM customer)
        SELECT c_custkey, email, regexp_matches(email, '^[a-z0-9#.]+@([a-z]+[.])+[a-z]{2,}$') AND NOT contains(email, '..') AS valid FROM e""",
    "raw_site_counts": f"WITH {REVIEWS} SELECT site, count(*) AS n FROM reviews_v GROUP BY site",
    "weekday_summary": f"""WITH {CLEAN} SELECT weekday, count(content) AS review_count, round(avg(rating), 6) AS avg_rating,
        round(avg(text_length), 6) AS avg_length FROM clean GROUP BY weekday""",
    "site_weekday_count": f"""WITH {CLEAN} SELECT s.site, d.weekday, count(c.ingest_seq) AS review_count
        FROM {_SITES} CROSS JOIN {_DAYS} LEFT JOIN clean c ON c.site = s.site AND c.weekday = d.weekday GROUP BY ALL""",
    "site_weekday_avg_rating": f"WITH {CLEAN} SELECT site, weekday, round(avg(rating), 6) AS avg_rating FROM clean GROUP BY ALL",
    "site_weekday_avg_length": f"WITH {CLEAN} SELECT site, weekday, round(avg(text_length), 6) AS avg_length FROM clean GROUP BY ALL",
    "weekday_counts_in_order": f"""WITH {REVIEWS}, n AS (SELECT dayname(date) AS weekday, count(*) AS n FROM reviews_v GROUP BY 1)
        SELECT d.weekday, CAST(d.ord AS BIGINT) AS ord, n.n AS review_count FROM {_DAYS} LEFT JOIN n USING (weekday)""",
    "rating_share": f"""WITH {REVIEWS} SELECT site, rating, count(*) AS n,
        round(count(*) / sum(count(*)) OVER (PARTITION BY site), 6) AS share
        FROM reviews_v WHERE rating IS NOT NULL GROUP BY site, rating""",
    "length_histogram30": f"""WITH {REVIEWS}, l AS (SELECT site, length(content) AS len FROM reviews_v),
        e AS (SELECT site, min(len) AS lo, max(len) AS hi FROM l GROUP BY site),
        b AS (SELECT site, least(((len - lo) * 30) // (hi - lo) + 1, 30) AS bin FROM l JOIN e USING (site)),
        f AS (SELECT site, lo, hi, unnest(range(1, 31)) AS bin FROM e)
        SELECT f.site, f.bin, round(lo + (f.bin - 1) * ((hi - lo) / 30.0::DOUBLE), 6) AS bin_from,
          round(lo + f.bin * ((hi - lo) / 30.0::DOUBLE), 6) AS bin_to, count(b.bin) AS n
        FROM f LEFT JOIN b ON b.site = f.site AND b.bin = f.bin GROUP BY f.site, f.bin, lo, hi""",
    "length_boxplot": _box_sql("site", "true"),
    "length_by_rating": _box_sql("site, rating", "rating IS NOT NULL", ", round(avg(len), 6) AS avg_length"),
    "daily_counts": f"WITH {REVIEWS} SELECT site, strftime(date, '%Y-%m-%d') AS day, count(*) AS n FROM reviews_v GROUP BY ALL",
    "calendar_grouping_sets": f"""WITH {REVIEWS}, p AS (SELECT site, unnest(['year', 'month', 'weekday', 'day']) AS unit,
          unnest([year(date), month(date), isodow(date) - 1, day(date)]) AS part FROM reviews_v)
        SELECT site, unit, part, count(*) AS n FROM p GROUP BY ALL""",
    "outlier_share": f"""WITH {REVIEWS}, f AS (SELECT v.site, length(content) < min_len OR length(content) > max_len AS a,
          date < min_date OR date > TIMESTAMP '2025-01-01' AS b FROM reviews_v v LEFT JOIN {_RULES} ON r.site = v.site)
        SELECT site, count(*) AS n, count(*) FILTER (a) AS length_outliers, round(avg(CAST(a AS DOUBLE)), 6) AS length_share,
          count(*) FILTER (b) AS date_outliers, round(avg(CAST(b AS DOUBLE)), 6) AS date_share FROM f GROUP BY site""",
    "top_keywords_by_site": f"""WITH {CLEAN}, w AS (SELECT site, lower(unnest(tokens)) AS word FROM clean),
        c AS (SELECT site, word, count(*) AS n FROM w WHERE word NOT IN ({', '.join(repr(w) for w in STOPWORDS)}) GROUP BY ALL)
        SELECT site, word, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, word) AS rank FROM c QUALIFY rank <= 20""",
    "keyword_pivot": f"""WITH {CLEAN}, w AS (SELECT site, lower(unnest(tokens)) AS word FROM clean),
        stops AS (SELECT DISTINCT unnest({words('lower(text)')}) AS word FROM benchmark),
        c AS (SELECT site, word, count(*) AS n FROM w WHERE word NOT IN (SELECT word FROM stops) GROUP BY ALL),
        p AS (SELECT site, word, n, n / max(n) OVER (PARTITION BY site) AS weight FROM c)
        SELECT word, """ + ", ".join(
        f"coalesce(max(n) FILTER (site = '{s}'), 0) AS n_{s}, coalesce(round(max(weight) FILTER (site = '{s}'), 6), 0) AS weight_{s}"
        for s in SITES) + " FROM p GROUP BY word",
}
