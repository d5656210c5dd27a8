import random

import pytest
from pyspark.sql import functions as F

from reviewloom.fixed_values import (MSG_DELETED, MSG_EXISTS, MSG_LOGIN, MSG_MISMATCH, MSG_NOT_FOUND, MSG_REGISTERED,
                                     MSG_UPDATED)
from reviewloom.operators import keyed, ordered
from reviewloom.schemas import CHANGES, USERS
from reviewloom.sources import keyed_store


@pytest.fixture()
def users(spark):
    return spark.createDataFrame([("a@example.com", "secret", "ann"), ("b@example.com", "hidden", "bob")], USERS)


def changes(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], CHANGES)


def rows(df):
    return {r.email: (r.password, r.username) for r in df.collect()}


def statuses(df):
    return {r.seq: r.status for r in df.collect()}


def test_lookup(spark, users):
    wanted = spark.createDataFrame([("a@example.com",), ("x@example.com",)], "email string")
    assert {r.email: r.username for r in keyed.lookup(wanted, users).collect()} == {"a@example.com": "ann", "x@example.com": None}


def test_match_status(spark, users):
    asked = spark.createDataFrame([("a@example.com", "secret"), ("a@example.com", "wrong"), ("x@example.com", "secret")],
                                  "email string, password string")
    got = {(r.email, r.password): r.status for r in keyed.match_status(asked, users, "email", "password").collect()}
    assert got == {("a@example.com", "secret"): "ok", ("a@example.com", "wrong"): "mismatch", ("x@example.com", "secret"): "not_found"}


def test_insert_absent(spark, users):
    asked = changes(spark, ("register", "c@example.com", "p1", "cy"), ("register", "a@example.com", "p2", "x"),
                    ("register", "c@example.com", "p3", "late"))
    after, judged = keyed.insert_absent(users, asked)
    assert rows(after)["c@example.com"] == ("p1", "cy") and after.count() == 3
    assert statuses(judged) == {0: "ok", 1: "exists", 2: "exists"}


def test_upsert_takes_the_latest(spark, users):
    after = keyed.upsert(users, changes(spark, ("upsert", "a@example.com", "p1", "n1"), ("upsert", "a@example.com", "p2", "n2"),
                                        ("upsert", "c@example.com", "p3", "n3")))
    assert rows(after) == {"a@example.com": ("p2", "n2"), "b@example.com": ("hidden", "bob"), "c@example.com": ("p3", "n3")}


def test_update_present(spark, users):
    after, judged = keyed.update_present(users, changes(spark, ("update", "a@example.com", "p1", None),
                                                        ("update", "a@example.com", "p2", None), ("update", "x@example.com", "p", None)), "password")
    assert rows(after) == {"a@example.com": ("p2", "ann"), "b@example.com": ("hidden", "bob")}
    assert statuses(judged) == {0: "ok", 1: "ok", 2: "not_found"}


def test_delete_present(spark, users):
    kept, deleted, judged = keyed.delete_present(users, changes(
        spark, ("delete", "a@example.com", None, None), ("delete", "a@example.com", None, None), ("delete", "x@example.com", None, None)))
    assert rows(kept) == {"b@example.com": ("hidden", "bob")} and rows(deleted) == {"a@example.com": ("secret", "ann")}
    assert statuses(judged) == {0: "ok", 1: "not_found", 2: "not_found"}


def test_mixed_batch_and_envelopes(spark, users):
    batch = changes(
        spark, ("login", "a@example.com", "secret", None), ("login", "a@example.com", "no", None),
        ("login", "x@example.com", "no", None), ("register", "a@example.com", "p", "x"),
        ("register", "c@example.com", "p", "cy"), ("delete", "c@example.com", None, None),
        ("register", "c@example.com", "p9", "cy2"), ("update", "c@example.com", "p10", None),
        ("update", "x@example.com", "p", None), ("delete", "x@example.com", None, None), ("delete", "b@example.com", None, None))
    after, outcomes = keyed.apply_changes(users, batch)
    assert rows(after) == {"a@example.com": ("secret", "ann"), "c@example.com": ("p10", "cy2")}
    got = [(r.outcome, r.status, r.code, r.message, r.username) for r in outcomes.orderBy("seq").collect()]
    assert got == [
        ("ok", "success", 200, MSG_LOGIN, "ann"), ("mismatch", "error", 400, MSG_MISMATCH, None),
        ("not_found", "error", 400, MSG_NOT_FOUND, None), ("exists", "error", 400, MSG_EXISTS, None),
        ("ok", "success", 201, MSG_REGISTERED, "cy"), ("ok", "success", 200, MSG_DELETED, "cy"),
        ("ok", "success", 201, MSG_REGISTERED, "cy2"), ("ok", "success", 200, MSG_UPDATED, "cy2"),
        ("not_found", "error", 404, MSG_NOT_FOUND, None), ("not_found", "error", 404, MSG_NOT_FOUND, None),
        ("ok", "success", 200, MSG_DELETED, "bob")]
    assert "password" not in outcomes.columns


def test_empty_batch(spark, users):
    after, outcomes = keyed.apply_changes(users, spark.createDataFrame([], CHANGES))
    assert after.count() == 2 and outcomes.count() == 0


def replay(start, batch):
    """One change after the other."""
    state, outcomes = dict(start), []
    for op, email, password, username in batch:
        row = state.get(email)
        if op == "register":
            outcomes.append("exists" if row else "ok")
            state.setdefault(email, (password, username))
        elif op == "upsert":
            state[email] = (password, username)
            outcomes.append("ok")
        elif row is None:
            outcomes.append("not_found")
        elif op == "login":
            outcomes.append("ok" if row[0] == password else "mismatch")
        elif op == "update":
            state[email] = (password, row[1])
            outcomes.append("ok")
        else:
            del state[email]
            outcomes.append("ok")
    return state, outcomes


@pytest.mark.parametrize("width", [1, 3, 65536])
def test_any_batch_equals_one_change_at_a_time(spark, users, width, monkeypatch):
    monkeypatch.setattr(keyed, "_CHANGE_RANGE", width)
    rnd = random.Random(width)
    emails = ["a@example.com", "b@example.com", "hot@example.com", "hot@example.com"]
    batch = [(rnd.choice(keyed.OPS), rnd.choice(emails), rnd.choice(["secret", "p1", "p2", None]), f"n{i}") for i in range(300)]
    state, expected = replay({r.email: (r.password, r.username) for r in users.collect()}, batch)
    after, outcomes = keyed.apply_changes(users, changes(spark, *batch).repartition(5))
    assert rows(after) == state
    assert [r.outcome for r in outcomes.orderBy("seq").collect()] == expected


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_carry_and_running_sum(spark, width):
    rnd = random.Random(width)
    given = [(rnd.choice("ab"), i * 3, rnd.choice([None, None, i])) for i in range(60)]
    df = spark.createDataFrame(given, "k string, o long, v long").repartition(4)
    out = ordered.carry_forward(df, ["k"], "o", {"last": F.col("v")}, width)
    out = ordered.drop_range(ordered.running_sum(out, ["k"], "o", F.coalesce("v", F.lit(0)), "total", width))
    last, total, expected = {}, {}, {}
    for k, o, v in given:
        total[k] = total.get(k, 0) + (v or 0)
        expected[k, o] = (last.get(k), total[k])
        last[k] = v if v is not None else last.get(k)
    assert {(r.k, r.o): (r["last"], r.total) for r in out.collect()} == expected


# --- the stored table ---------------------------------------------------------
def change_rows(seed, n=300):
    rnd = random.Random(seed)
    return [(i, rnd.choice(keyed.OPS), f"u{rnd.randint(0, 40)}@example.com", rnd.choice("pqr"), rnd.choice("xyz")) for i in range(n)]


def test_batches_on_a_stored_table_equal_one_batch(spark, users, tmp_path):
    path, rows = str(tmp_path / "users"), change_rows(1)
    keyed_store.create(users, path, buckets=16)
    assert sorted(map(tuple, keyed_store.read(spark, path).collect())) == sorted(map(tuple, users.collect()))
    outcomes = []
    for number, at in enumerate(range(0, 300, 100), 1):
        batch = spark.createDataFrame(rows[at:at + 100], CHANGES)
        outcomes += keyed_store.apply_batch(batch, path, number).collect()
        assert keyed_store.apply_batch(batch, path, number).count() == 100  # sent again: read, not applied
    after, judged = keyed.apply_changes(users, spark.createDataFrame(rows, CHANGES))
    assert sorted(map(tuple, keyed_store.read(spark, path).collect())) == sorted(map(tuple, after.collect()))
    assert sorted(map(tuple, outcomes)) == sorted(map(tuple, judged.collect()))


def test_a_batch_rewrites_only_its_own_buckets(spark, users, tmp_path):
    path = str(tmp_path / "users")
    keyed_store.create(users, path, buckets=64)
    keyed_store.apply_batch(spark.createDataFrame([(0, "upsert", "new@example.com", "p", "n")], CHANGES), path, 1)
    held = {r.bucket: (r.version, r.rows) for r in keyed_store.versions(spark, path).collect()}
    assert len(held) == 64 and [v for v, _ in held.values()].count(1) == 1
    assert len(list((tmp_path / "users" / "data" / "version=1").glob("bucket=*"))) == 1
    keyed_store.apply_batch(spark.createDataFrame([(1, "delete", "new@example.com", None, None)], CHANGES), path, 2)
    assert sorted(map(tuple, keyed_store.read(spark, path).collect())) == sorted(map(tuple, users.collect()))


def test_a_batch_that_broke_off_is_done_again(spark, users, tmp_path):
    """Data without a log entry is not there; the batch starts from what earlier batches left."""
    path, rows = str(tmp_path / "users"), change_rows(2, 80)
    keyed_store.create(users, path, buckets=4)
    first, second = (spark.createDataFrame(r, CHANGES) for r in (rows[:40], rows[40:]))
    keyed_store.apply_batch(first, path, 1)
    before = sorted(map(tuple, keyed_store.read(spark, path).collect()))
    keyed_store.apply_batch(second, path, 2)
    after = sorted(map(tuple, keyed_store.read(spark, path).collect()))
    for file in (tmp_path / "users" / "log" / "batch=2").iterdir():
        file.unlink()
    assert sorted(map(tuple, keyed_store.read(spark, path).collect())) == before != after
    keyed_store.apply_batch(second, path, 2)
    assert sorted(map(tuple, keyed_store.read(spark, path).collect())) == after


def test_an_empty_batch_and_a_missing_table(spark, users, tmp_path):
    path = str(tmp_path / "users")
    with pytest.raises(ValueError, match="no stored table"):
        keyed_store.read(spark, path)
    keyed_store.create(users.limit(0), path, buckets=4)
    assert keyed_store.read(spark, path).count() == 0
    assert keyed_store.apply_batch(spark.createDataFrame([], CHANGES), path, 1).count() == 0
    assert keyed_store.read(spark, path).count() == 0
