"""One key holds a third of all rows: results stay whole and no task gets the key."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from reviewloom.operators import cleaning, conversations, keyed, ordered
from reviewloom.plans import catalog

ROWS = 60_000


@pytest.fixture(scope="module")
def messages(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(ROWS).select(
        F.when(hot, F.lit(-1)).otherwise(F.col("id") % 997).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).repartition(8)


def test_hot_conversation(spark, messages):
    pairs = conversations.pair_turns(messages)
    hot = pairs.filter("conv_id = -1").orderBy("pair_no").collect()
    # multiples of 3 alternate between even (user) and odd (assistant)
    assert len(hot) == ROWS // 6
    assert [(r.pair_no, r.user, r.assistant) for r in hot[:2]] == [(1, "t0", "t3"), (2, "t6", "t9")]
    assert hot[-1].pair_no == ROWS // 6
    last = conversations.last_turns(pairs).filter("conv_id = -1").agg(F.min("pair_no")).first()[0]
    assert last == ROWS // 6 - 4


def test_hot_content(spark):
    rows = spark.range(ROWS).select(
        F.lit("kakaomap").alias("site"), F.col("id").alias("ingest_seq"), F.lit(4.0).alias("rating"),
        F.lit("2024-01-01").alias("date"),
        F.when(F.col("id") % 3 != 1, F.concat(F.lit("unique text "), F.col("id").cast("string"))).otherwise("the same text")
        .alias("content")).repartition(8)
    kept = cleaning.clean_reviews(rows, "2025-01-01")
    assert kept.count() == ROWS - ROWS // 3 + 1
    assert kept.filter("content = 'the same text'").first().ingest_seq == 1


def test_hot_account(spark):
    users = spark.createDataFrame([("hot@example.com", "p", "n")], "email string, password string, username string")
    changes = spark.range(ROWS).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "delete").otherwise("register").alias("op"),
        F.when(F.col("id") % 3 == 0, "hot@example.com").otherwise(F.concat(F.col("id").cast("string"), F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("password"), F.lit("n").alias("username"))
    after, outcomes = keyed.apply_changes(users, changes)
    hot = outcomes.filter("email = 'hot@example.com'")
    # ids 0, 3, 6, ... delete and register in turn
    assert hot.filter("outcome <> 'ok'").count() == 0 and hot.count() == ROWS // 3
    last = max(i for i in range(0, ROWS, 3))
    expected = [] if last % 2 == 0 else [f"p{last}"]
    assert [r.password for r in after.filter("email = 'hot@example.com'").collect()] == expected
    assert outcomes.count() == ROWS


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith("stream_")))
def test_no_query_pairs_everything_with_everything(spark, sf, name):
    text = plan(entry_point.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # only running sums over one row per range or file may pass one task
    for block in text.split("\n\n"):
        if "SinglePartition" in block:
            columns = re.search(r"Input \[\d+\]: \[(.*)\]", block).group(1).split(", ")
            assert all(column.startswith("__") for column in columns), block


def test_scans_read_only_what_is_used(spark, sf):
    queries = entry_point.queries()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(queries["weekday_summary"](spark, sf))
    assert "PushedFilters: [EqualTo(role,user)" in plan(queries["route_messages"](spark, sf)).replace("IsNotNull(role), ", "")
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in plan(queries["turn_pairs"](spark, sf))


def test_rows_of_a_hot_key_are_dealt_by_range(spark, messages):
    """Every exchange that carries messages deals them by conversation and range, so no task gets a whole key."""
    numbered = conversations.number_messages(messages, width=1000)
    assert numbered.count() == ROWS
    text = plan(numbered)
    dealt = re.findall(r"hashpartitioning\((conv_id#\d+L?)(, range#\d+L?)?", text)
    assert dealt and any(with_range for _, with_range in dealt)
    # the exchange by conversation alone carries one summary row per range
    per_range = ordered.with_ranges(messages, ["conv_id"], "turn", 1000).groupBy("conv_id", "__range").count()
    assert per_range.agg(F.max("count")).first()[0] <= 1001
    assert per_range.filter("conv_id = -1").count() == ROWS // 3 // 1000


@pytest.mark.parametrize("place", ["id * 1000000000", "id * id * 1000", "CASE WHEN id % 2 = 0 THEN id ELSE 4000000000000000000 - id END",
                                   "pmod(xxhash64(id), 4000000000000000000)", "id"])
def test_ranges_follow_the_rows_however_far_apart_their_values_lie(spark, place):
    """A third of the rows has one key; no range holds many more rows than asked for, and few ranges hold few."""
    rows = spark.range(ROWS).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id % 997 END AS k", f"{place} AS o").repartition(8)
    ranges = ordered.with_ranges(rows, ["k"], "o", 500).groupBy("k", "__range").count()
    hot = ranges.filter("k = -1").agg(F.max("count"), F.count("*")).first()
    assert hot[0] <= 2000 and hot[1] <= 4 * ROWS // 3 // 500
    assert ranges.filter("k <> -1").agg(F.max("count"), F.count("*")).first()[1] == 997
    carried = ordered.carry_forward(rows, ["k"], "o", {"last": F.col("o")}, 500).filter("k = -1")
    plain = [r.o for r in rows.filter("k = -1").orderBy("o").collect()]
    got = carried.orderBy("o").select("o", "last").collect()
    assert [(r.o, r.last) for r in got] == list(zip(plain, [None, *plain]))


def test_a_hot_account_with_changes_far_apart(spark):
    users = spark.createDataFrame([], "email string, password string, username string")
    changes = spark.range(ROWS).selectExpr(
        "id * 1000000000 AS seq", "CASE WHEN id = 0 THEN 'register' WHEN id % 2 = 0 THEN 'update' ELSE 'login' END AS op",
        "'hot@example.com' AS email", "CAST(id DIV 2 AS STRING) AS password", "'n' AS username").repartition(8)
    after, outcomes = keyed.apply_changes(users, changes)
    assert [tuple(r) for r in after.collect()] == [("hot@example.com", str(ROWS // 2 - 1), "n")]
    assert outcomes.filter("outcome <> 'ok'").count() == 0 and outcomes.count() == ROWS


def jobs_while_building(spark, name, sf):
    group = f"build {name}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        entry_point.queries()[name](spark, sf)
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("name", ["resolve_messages", "subject_lookup", "subject_mentions", "subject_prompts",
                                  "top_keywords_by_site", "keyword_pivot", "wordpiece_reviews", "apply_changes",
                                  "apply_changes_outcomes", "clean_reviews", "turn_pairs"])
def test_building_a_plan_starts_no_work(spark, sf, name):
    """Reading a table's schema is a job; nothing else runs before an action."""
    assert jobs_while_building(spark, name, sf) <= 4
