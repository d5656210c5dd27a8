import datetime as dt
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.functions.dates import normalise_labelled_date, parse_date
from reviewloom.functions.text import fill_template, shorten, split_words, strip_specials, tokens, trim_space
from reviewloom.operators import cleaning

AS_OF = "2025-01-01 00:00:00"
COLUMNS = "site string, ingest_seq long, rating double, date string, content string"


def reviews(spark, rows):
    return spark.createDataFrame(
        [(r[0], i, *r[1:]) for i, r in enumerate(rows, 1)], COLUMNS)


def column(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


PROBES = ["좋아요!! 정말 최고👍", "a1\nb2c3d4", '"quoted" (text)', "²½Ⅳ ok", "é x‍y", "a‿b_c",
          " nbsp\u0085nel\x1cfs\x1f", "हिन्दी में", "tab\there", "　wide space", "", "_", "日本語、テスト。"]


def test_strip_specials_equals_python_pattern(spark):
    expected = [re.sub(r"[^\w\s]", "", t).replace("\n", "").replace('"', "") for t in PROBES]
    assert column(spark, PROBES, strip_specials(F.col("t"))) == expected


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn", "Co")), max_size=20), min_size=40, max_size=60))
def test_text_functions_equal_python_on_any_text(spark, texts):
    # The two runtimes know different Unicode versions; letters new to one are left out.
    texts = ["".join(c for c in t if ord(c) < 0x10000) for t in texts]
    assert column(spark, texts, trim_space(F.col("t"))) == [t.strip() for t in texts]
    assert column(spark, texts, split_words(F.col("t"))) == [t.split() for t in texts]
    assert column(spark, texts, F.length("t")) == [len(t) for t in texts]


def test_shorten_and_tokens(spark):
    long = "x" * 41
    assert column(spark, [" a\nb ", long, "y" * 40], shorten(F.col("t"))) == ["a b", "x" * 40 + "...", "y" * 40]
    many = " ".join(f"w{i}" for i in range(300))
    got = column(spark, [many, None, "  "], tokens(F.col("t"), 250))
    assert len(got[0]) == 250 and got[0][-1] == "w249" and got[1:] == [[], []]


def test_fill_template_substitutes_once(spark):
    got = column(spark, ["{b}"], fill_template("<{a}|{b}>", a=F.col("t"), b=F.lit("{a}")))
    assert got == ["<{b}|{a}>"]


def test_dates(spark):
    texts = ["2024.05.03", "2024.5.3.", "2024년 5월 3일", "2024-05-03", "2024-05-03 10:11:12", " 2024.5.3 ", "bad", "", None]
    day = dt.datetime(2024, 5, 3)
    assert column(spark, texts, parse_date(F.col("t"))) == [
        day, day, day, day, dt.datetime(2024, 5, 3, 10, 11, 12), day, None, None, None]
    labelled = ["작성일: 2024년 5월 3일", "작성일: x", "2024년 5월 3일", "작성일:2024년 12월 31일 "]
    assert column(spark, labelled, normalise_labelled_date(F.col("t"))) == [
        "2024.05.03", "작성일: x", "2024년 5월 3일", "2024.12.31"]


def kept(spark, rows):
    got = cleaning.clean_reviews(reviews(spark, rows), AS_OF).select("ingest_seq", "content").collect()
    return {r.ingest_seq: r.content for r in got}


def test_rating_and_date_edges(spark):
    rows = [("kakaomap", r, d, f"content number {i}") for i, (r, d) in enumerate([
        (0.0, "2024-01-01"), (1.0, "2024-01-01"), (5.0, "2024-01-01"), (6.0, "2024-01-01"), (None, "2024-01-01"),
        (3.0, "2021-12-31"), (3.0, "2022-01-01"), (3.0, AS_OF), (3.0, "2025-01-01 00:00:01"), (3.0, None), (3.0, "bad"),
        (3.0, "2024.5.3.")])]
    assert set(kept(spark, rows)) == {2, 3, 7, 8, 12}


def test_length_is_taken_before_the_trim(spark):
    texts = ["abcde", "abcdef", "x" * 249, "x" * 250, "  abc  ", "a!b!c!d!e!", "a1\nb2c3d4", None]
    got = kept(spark, [("kakaomap", 4.0, "2024-01-01", t) for t in texts])
    assert got == {2: "abcdef", 3: "x" * 249, 5: "abc", 7: "a1b2c3d4"}


def test_first_of_equal_contents_per_site(spark):
    rows = [("kakaomap", 1.0, "2024-01-02", "same text!"), ("kakaomap", 5.0, "2024-01-01", " same text"),
            ("tripdotcom", 2.0, "2024-01-03", "same text"), ("kakaomap", 3.0, "2024-01-01", "other text")]
    for parts in (1, 7):
        got = cleaning.clean_reviews(reviews(spark, rows).repartition(parts), AS_OF)
        assert sorted((r.site, r.ingest_seq, r.rating) for r in got.collect()) == [
            ("kakaomap", 1, 1.0), ("kakaomap", 4, 3.0), ("tripdotcom", 3, 2.0)]


def test_features(spark):
    got = cleaning.clean_reviews(reviews(spark, [("kakaomap", 5.0, "2024.05.03", " 좋아요!! 정말 최고👍")]), AS_OF).first()
    assert (got.content, got.review_length, got.text_length) == ("좋아요 정말 최고", 10, 9)
    assert (got.weekday, got.tokenized_content) == ("Friday", ["좋아요", "정말", "최고"])


def test_cleaning_again_changes_no_content(spark):
    rows = [("kakaomap", 4.0, "2024-01-01", t) for t in PROBES + ["  abc  ", "plain text here"]]
    once = cleaning.clean_reviews(reviews(spark, rows), AS_OF)
    twice = cleaning.clean_reviews(once, AS_OF)
    first = {r.ingest_seq: r.content for r in once.collect()}
    second = {r.ingest_seq: r.content for r in twice.collect()}
    assert second.items() <= first.items()
    assert all(len(first[s]) <= 5 for s in first.keys() - second.keys())


def test_audit_counts_the_first_failing_rule(spark):
    rows = [("kakaomap", None, "2024-01-01", "text one here"), ("kakaomap", 9.0, "bad", "text two here"),
            ("kakaomap", 4.0, "bad", "text three here"), ("kakaomap", 4.0, "2020-01-01", "tiny"),
            ("kakaomap", 4.0, "2024-01-01", "tiny"), ("kakaomap", 4.0, "2024-01-01", "kept text"),
            ("kakaomap", 4.0, "2024-01-02", "kept text!"), ("kakaomap", 4.0, "2024-01-02", " kept text")]
    got = {(r.site, r.reason): r.n for r in cleaning.audit(reviews(spark, rows), AS_OF).collect()}
    assert got == {("kakaomap", k): v for k, v in {
        "missing": 1, "rating": 1, "bad_date": 1, "date": 1, "length": 1, "kept": 1, "duplicate": 2}.items()}


def test_collecting_rules(spark):
    rows = reviews(spark, [("kakaomap", 1.0, "d", "a"), ("kakaomap", 1.0, "d", "a"), ("kakaomap", 2.0, "d", "a"),
                           ("kakaomap", 1.0, "d", None)])
    assert [r.ingest_seq for r in cleaning.distinct_reviews(rows).orderBy("ingest_seq").collect()] == [1, 3, 4]
    assert cleaning.with_required_fields(rows).count() == 3
    tabs = rows.withColumn("filter_index", F.when(F.col("ingest_seq") == 3, 0).otherwise(1))
    assert [r.ingest_seq for r in cleaning.distinct_contents(tabs).orderBy("ingest_seq").collect()] == [3, 4]


def test_cap_keeps_the_first_rows_of_each_site(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "kakaomap").otherwise("tripdotcom").alias("site"), F.col("id").alias("ingest_seq"))
    got = cleaning.cap_per_site(rows, 700)
    counts = {r.site: (r.n, r.last) for r in got.groupBy("site").agg(
        F.count("*").alias("n"), F.max("ingest_seq").alias("last")).collect()}
    assert counts == {"kakaomap": (700, 2097), "tripdotcom": (700, 1049)}


@pytest.mark.parametrize("address, valid", [
    ("a@example.com", True), ("a.b+c@mail.example.co.kr", True), ("a@localhost", False), ("a..b@example.com", False),
    (".a@example.com", False), ("a.@example.com", False), ("a@-example.com", False), ("a b@example.com", False),
    ("a@b@example.com", False), ("", False), (None, False)])
def test_email_pattern(spark, address, valid):
    rows = spark.createDataFrame([(address,)], "email string")
    ok, bad = cleaning.split_valid_emails(rows)
    assert (ok.count(), bad.count()) == ((1, 0) if valid else (0, 1))


def test_the_number_of_tokens_is_a_parameter(spark):
    rows = spark.createDataFrame([("kakaomap", 1, 5.0, "2024-01-01", "one two three four")],
                                 "site string, ingest_seq long, rating double, date string, content string")
    assert cleaning.clean_reviews(rows, "2025-01-01", token_limit=2).first().tokenized_content == ["one", "two"]
