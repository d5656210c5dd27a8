"""Keyed changes to a user table: lookup, insert, upsert, update, delete, mixed batches.

Changes are rows ``seq, op, email, password, username`` with a unique ``seq``
from 0 up. The password column is opaque: it is compared and stored, and never
part of an outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.fixed_values import (MSG_DELETED, MSG_EXISTS, MSG_LOGIN, MSG_MISMATCH, MSG_NOT_FOUND,
                                     MSG_REGISTERED, MSG_UPDATED)
from reviewloom.operators.ordered import carry_forward, drop_range

OPS = ("login", "register", "upsert", "update", "delete")
_CHANGE_RANGE = 65536


# --- single kinds of change -------------------------------------------------
def lookup(requests: DataFrame, table: DataFrame, key: str = "email") -> DataFrame:
    """Requests with the stored row of their key, NULL where there is none."""
    return requests.select(key).join(table, key, "left")


def match_status(requests: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Compare a supplied to a stored value: ``ok``, ``mismatch`` or ``not_found``."""
    stored = table.select(F.col(key), F.col(value).alias("__stored"), F.lit(True).alias("__known"))
    return requests.join(stored, key, "left").withColumn(
        "status",
        F.when(F.col("__known").isNull(), "not_found")
        .when(F.col(value).eqNullSafe(F.col("__stored")), "ok").otherwise("mismatch"),
    ).drop("__stored", "__known")


def insert_absent(table: DataFrame, requests: DataFrame, key: str = "email") -> tuple[DataFrame, DataFrame]:
    """New table, and a status per request: the first of a new key is ``ok``, others ``exists``."""
    known = table.select(key, F.lit(True).alias("__known"))
    first = requests.groupBy(key).agg(F.min("seq").alias("__first"))
    judged = requests.join(first.join(known, key, "left"), key).withColumn(
        "status", F.when(F.col("__known").isNull() & (F.col("seq") == F.col("__first")), "ok").otherwise("exists"))
    added = judged.filter("status = 'ok'").select(*table.columns)
    return table.unionByName(added), judged.select("seq", key, "status")


def upsert(table: DataFrame, requests: DataFrame, key: str = "email") -> DataFrame:
    """Replace or add the row of each requested key; the latest request wins."""
    others = [c for c in table.columns if c != key]
    newest = requests.groupBy(key).agg(F.max_by(F.struct(*others), "seq").alias("__new"))
    old = table.select(key, F.struct(*others).alias("__old"))
    merged = old.join(newest, key, "full").withColumn("__row", F.coalesce("__new", "__old"))
    return merged.select(key, *[F.col("__row")[c].alias(c) for c in others]).select(*table.columns)


def update_present(table: DataFrame, requests: DataFrame, column: str,
                   key: str = "email") -> tuple[DataFrame, DataFrame]:
    """Set one column of the rows that exist, and a status per request."""
    newest = requests.groupBy(key).agg(F.max_by(F.struct(column), "seq").alias("__new"))
    after = table.join(newest, key, "left").withColumn(
        column, F.when(F.col("__new").isNotNull(), F.col("__new")[column]).otherwise(F.col(column)))
    known = table.select(key, F.lit(True).alias("__known"))
    judged = requests.join(known, key, "left").select(
        "seq", key, F.when(F.col("__known").isNull(), "not_found").otherwise("ok").alias("status"))
    return after.select(*table.columns), judged


def delete_present(table: DataFrame, requests: DataFrame,
                   key: str = "email") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept rows, deleted rows, and a status per request (a repeated delete finds nothing)."""
    first = requests.groupBy(key).agg(F.min("seq").alias("__first"))
    kept = table.join(first, key, "left_anti")
    deleted = table.join(first, key, "left_semi")
    known = table.select(key, F.lit(True).alias("__known"))
    judged = requests.join(first.join(known, key, "left"), key).select(
        "seq", key,
        F.when(F.col("__known") & (F.col("seq") == F.col("__first")), "ok").otherwise("not_found").alias("status"))
    return kept, deleted, judged


# --- ordered batches of mixed changes ---------------------------------------
def history(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Every change with the state of its key before it.

    Stored rows take part as changes that come first. What a key holds depends
    only on the last earlier change that set it, so two carried values replace
    a fold over the key: first whether a row is present, then what it holds.
    """
    existing = table.select(F.lit(-1).cast("long").alias("seq"), F.lit("load").alias("op"),
                            "email", "password", "username")
    events = existing.unionByName(changes.select(*existing.columns))
    op = F.col("op")

    present = F.when(op.isin("load", "register", "upsert"), True).when(op == "delete", False)
    events = carry_forward(events, ["email"], "seq", {"was_present": present}, _CHANGE_RANGE)
    events = events.withColumn("was_present", F.coalesce("was_present", F.lit(False)))

    known = F.col("was_present")
    replaces = op.isin("load", "upsert") | ((op == "register") & ~known)
    nothing = F.lit(None).cast("string")
    password = (F.when(replaces | ((op == "update") & known), F.struct(F.col("password").alias("v")))
                .when(op == "delete", F.struct(nothing.alias("v"))))
    username = (F.when(replaces, F.struct(F.col("username").alias("v")))
                .when(op == "delete", F.struct(nothing.alias("v"))))
    events = events.withColumn("sets_present", present)
    events = events.withColumn("sets_password", password).withColumn("sets_username", username)
    carried = carry_forward(events, ["email"], "seq",
                            {"old_password": F.col("sets_password"), "old_username": F.col("sets_username")},
                            _CHANGE_RANGE)
    return drop_range(carried)


def _outcome(op: Column, known: Column, same: Column) -> Column:
    return (F.when((op == "register") & known, "exists")
            .when(op.isin("login", "update", "delete") & ~known, "not_found")
            .when((op == "login") & ~same, "mismatch").otherwise("ok"))


def _envelope(events: DataFrame) -> DataFrame:
    op, result = F.col("op"), F.col("outcome")
    message = (
        F.when(result == "exists", MSG_EXISTS).when(result == "not_found", MSG_NOT_FOUND)
        .when(result == "mismatch", MSG_MISMATCH)
        .when(op == "login", MSG_LOGIN).when(op == "register", MSG_REGISTERED)
        .when(op == "delete", MSG_DELETED).when(op == "update", MSG_UPDATED))
    code = (F.when((result == "ok") & (op == "register"), 201).when(result == "ok", 200)
            .when(op.isin("login", "register"), 400).otherwise(404))
    username = F.when(result == "ok", F.when(op.isin("register", "upsert"), F.col("username"))
                      .otherwise(F.col("old_username")["v"]))
    return events.select(
        "seq", "op", "email", "outcome",
        F.when(result == "ok", "success").otherwise("error").alias("status"),
        code.alias("code"), message.alias("message"), username.alias("username"))


def apply_changes(table: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply changes in ``seq`` order: the table after them and one outcome per change.

    Both results come from one plan and nothing is written; a caller who needs
    both can store the history first and read them from it.
    """
    return from_history(history(table, changes))


def from_history(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table after all changes of a history, and one outcome per change."""
    def last_set(column: str) -> Column:
        return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("seq")))

    after = (
        events.groupBy("email").agg(
            last_set("sets_present").alias("present"),
            last_set("sets_password").alias("p"), last_set("sets_username").alias("u"))
        .filter("present").select("email", F.col("p")["v"].alias("password"), F.col("u")["v"].alias("username"))
    )
    judged = events.filter(F.col("op") != "load").withColumn(
        "outcome", _outcome(F.col("op"), F.col("was_present"),
                            F.col("password").eqNullSafe(F.col("old_password")["v"])))
    return after, _envelope(judged)
