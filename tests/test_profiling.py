import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import keywords, profiling

CLEAN = "site string, weekday string, rating double, text_length int, content string"


@pytest.fixture()
def clean(spark):
    return spark.createDataFrame([
        ("kakaomap", "Friday", 5.0, 10, "a"), ("kakaomap", "Monday", 3.0, 20, "b"), ("tripdotcom", "Friday", None, 30, "c"),
        ("tripdotcom", None, 1.0, 40, "d")], CLEAN)


def test_weekday_summary_is_in_order_and_drops_null_days(clean):
    got = [tuple(r) for r in profiling.weekday_summary(clean).collect()]
    assert got == [("Monday", 1, 3.0, 20.0), ("Friday", 2, 5.0, 20.0)]


def test_missing_days_count_zero_or_null(spark, clean):
    got = {(r.site, r.weekday): r.review_count for r in profiling.site_weekday_counts(clean).collect()}
    assert len(got) == 21 and got["kakaomap", "Friday"] == 1 and got["myrealtrip", "Friday"] == 0
    dated = spark.sql("select timestamp'2024-05-03' as date union all select null")
    days = [(r.weekday, r.review_count) for r in profiling.weekday_counts_in_order(dated).collect()]
    assert [d for d, _ in days] == list(profiling.WEEKDAYS) and days[4] == ("Friday", 1) and days[0] == ("Monday", None)


def texts(spark, lengths, site="kakaomap"):
    return spark.createDataFrame([(site, 1.0, "x" * n) for n in lengths], "site string, rating double, content string")


@pytest.mark.parametrize("lengths", [[1, 2, 3, 10], [1, 31], list(range(0, 61)), [7, 7, 7], [0, 1, 1, 2, 3, 29, 30, 90]])
def test_histogram_equals_numpy(spark, lengths):
    got = profiling.length_histogram(texts(spark, lengths)).orderBy("bin").collect()
    counts, edges = np.histogram(lengths, bins=30)
    assert [r.n for r in got] == counts.tolist()
    assert np.allclose([r.bin_from for r in got] + [got[-1].bin_to], edges)


@pytest.mark.parametrize("lengths", [[1, 2, 3, 10], [5, 5, 5], [1, 2, 3, 4, 5, 100], [2]])
def test_box_equals_numpy(spark, lengths):
    got = profiling.length_box(texts(spark, lengths), ["site"]).first()
    q1, median, q3 = np.percentile(lengths, [25, 50, 75])
    reach = 1.5 * (q3 - q1)
    inside = [n for n in lengths if q1 - reach <= n <= q3 + reach]
    assert (got.q1, got["median"], got.q3) == (q1, median, q3)
    assert (got.whisker_low, got.whisker_high, got.outliers, got.total) == (
        min(inside), max(inside), len(lengths) - len(inside), len(lengths))


def test_outlier_rules(spark):
    rows = spark.createDataFrame([
        ("kakaomap", "ab", "2023-01-01"), ("kakaomap", "x" * 126, "2022-06-30"), ("kakaomap", "x" * 125, "2025-02-01"),
        ("myrealtrip", "x" * 59, "2022-01-01"), ("nowhere", "x", "2020-01-01")],
        "site string, content string, date string").withColumn("date", F.col("date").cast("timestamp"))
    got = {r.site: (r.n, r.length_outliers, r.date_outliers) for r in profiling.outlier_shares(rows, "2025-01-01").collect()}
    assert got == {"kakaomap": (3, 2, 2), "myrealtrip": (1, 1, 0), "nowhere": (1, 0, 0)}


def test_rating_shares_skip_null(spark):
    rows = spark.createDataFrame([("s", 5.0), ("s", 5.0), ("s", 1.0), ("s", None)], "site string, rating double")
    assert {r.rating: (r.n, round(r.share, 6)) for r in profiling.rating_shares(rows).collect()} == {
        5.0: (2, 0.666667), 1.0: (1, 0.333333)}


def test_keywords_by_list_and_by_table(spark):
    rows = spark.createDataFrame([
        ("kakaomap", ["Fun", "fun", "the", "park"]), ("tripdotcom", ["park", "the"])], "site string, tokenized_content array<string>")
    by_list = keywords.keyword_counts(rows, ["the"])
    by_table = keywords.keyword_counts(rows, spark.createDataFrame([("the",), ("the",)], "word string"))
    long_list = keywords.keyword_counts(rows, ["the"] + [f"w{i}" for i in range(2000)])
    expected = {("kakaomap", "fun", 2), ("kakaomap", "park", 1), ("tripdotcom", "park", 1)}
    for counts in (by_list, by_table, long_list):
        assert {tuple(r) for r in counts.select("site", "word", "n").collect()} == expected
    top = keywords.top_keywords(by_list, 1).collect()
    assert {(r.site, r.word) for r in top} == {("kakaomap", "fun"), ("tripdotcom", "park")}
    compared = {r.word: r for r in keywords.compare_sites(by_list).collect()}
    assert (compared["park"].n_kakaomap, compared["park"].weight_kakaomap, compared["park"].n_myrealtrip) == (1, 0.5, 0)
