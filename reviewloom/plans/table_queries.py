"""Keyed changes, page extraction and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.fixed_values import SITES
from reviewloom.operators import extract, keyed
from reviewloom.plans import chat_queries, derived, review_queries
from reviewloom.plans.oracle_parts import HISTORY, USERS, trimmed
from reviewloom.session import shared_folder
from reviewloom.sources import keyed_store
from reviewloom.sources.tables import stream_messages, table
from reviewloom.streaming import clean_stream, turn_stream


# --- keyed changes ----------------------------------------------------------
def lookup_users(spark, folder):
    wanted = derived.requests(spark, folder, "login")
    return keyed.lookup(wanted, derived.users(spark, folder)).select("email", "username")


def match_status(spark, folder):
    logins = derived.requests(spark, folder, "login")
    return keyed.match_status(logins, derived.users(spark, folder), "email", "password").select("seq", "email", "status")


def insert_absent(spark, folder):
    after, _ = keyed.insert_absent(derived.users(spark, folder), derived.requests(spark, folder, "register"))
    return after


def insert_absent_status(spark, folder):
    _, judged = keyed.insert_absent(derived.users(spark, folder), derived.requests(spark, folder, "register"))
    return judged


def upsert_users(spark, folder):
    return keyed.upsert(derived.users(spark, folder), derived.requests(spark, folder, "upsert"))


def update_present(spark, folder):
    after, _ = keyed.update_present(derived.users(spark, folder), derived.requests(spark, folder, "update"), "password")
    return after


def update_present_status(spark, folder):
    _, judged = keyed.update_present(derived.users(spark, folder), derived.requests(spark, folder, "update"), "password")
    return judged


def delete_present(spark, folder):
    kept, deleted, _ = keyed.delete_present(derived.users(spark, folder), derived.requests(spark, folder, "delete"))
    return kept.withColumn("outcome", F.lit("kept")).unionByName(deleted.withColumn("outcome", F.lit("deleted")))


def delete_present_status(spark, folder):
    return keyed.delete_present(derived.users(spark, folder), derived.requests(spark, folder, "delete"))[2]


def apply_changes(spark, folder):
    return keyed.apply_changes(derived.users(spark, folder), derived.changes(spark, folder))[0]


def apply_changes_outcomes(spark, folder):
    outcomes = keyed.apply_changes(derived.users(spark, folder), derived.changes(spark, folder))[1]
    return outcomes.withColumn("code", F.col("code").cast("long"))


def _stored_users(spark: SparkSession, folder: str) -> tuple[str, list[DataFrame]]:
    """Users in buckets, changed by every order in three batches, the second one sent twice."""
    path, changes = shared_folder(spark, "users"), derived.changes(spark, folder)
    keyed_store.create(derived.users(spark, folder), path, buckets=32)
    last = changes.agg(F.max("seq")).first()[0] or 0
    part = F.floor(F.col("seq") * 3 / F.lit(last + 1))
    return path, [keyed_store.apply_batch(changes.where(part == n - 1), path, n) for n in (1, 2, 2, 3)]


def stored_users(spark, folder):
    path, _ = _stored_users(spark, folder)
    return keyed_store.read(spark, path)


def stored_users_outcomes(spark, folder):
    _, (first, second, again, third) = _stored_users(spark, folder)
    outcomes = first.unionByName(second).unionByName(third).unionByName(again.join(second, "seq", "left_anti"))
    return outcomes.withColumn("code", F.col("code").cast("long"))


# --- pages ------------------------------------------------------------------
def page_items(spark, folder):
    items = extract.extract_items(table(spark, folder, "pages"), extract.PAGE_RULES)
    return items.select("page_id", "title", "headline", F.col("paragraphs").cast("long").alias("paragraphs"),
                        F.col("links").cast("long").alias("links"))


def _extracted(site: str, spark: SparkSession, folder: str) -> DataFrame:
    pages = derived.review_pages(spark, folder, site)
    return extract.extract_reviews(pages, site, ("page_id", "filter_index"))


def extract_first_site(spark, folder):
    return _extracted(SITES[0], spark, folder).drop("filter_index", "site")


def extract_second_site(spark, folder):
    return _extracted(SITES[1], spark, folder).drop("filter_index", "site")


def extract_third_site(spark, folder):
    return _extracted(SITES[2], spark, folder).drop("site")


# --- streams ----------------------------------------------------------------
def stream_clean_incremental(spark, folder):
    """The stream job over the whole table, and what it leaves in its sink."""
    sink, checkpoint = shared_folder(spark, "clean-sink"), shared_folder(spark, "clean-progress")
    documents = table(spark, folder, "documents")
    stream = spark.readStream.schema(documents.schema).parquet(f"{folder}/documents*.parquet")
    clean_stream.start_cleaning(derived.lines(stream), sink, checkpoint, derived.AS_OF).awaitTermination()
    return review_queries.shown(clean_stream.read_cleaned(spark, sink))


def stream_clean_batches(spark, folder):
    """The same from files that arrive last ones first, with copies across them: earlier copies replace later ones."""
    sink, checkpoint = shared_folder(spark, "clean-sink"), shared_folder(spark, "clean-progress")
    arrived, documents = shared_folder(spark, "arrived"), table(spark, folder, "documents")
    for part in (2, 0, 1):  # what arrives between two starts is one micro-batch, in any number of files
        documents.where(F.pmod("doc_id", F.lit(3)) == part).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(documents.schema).parquet(arrived)
        clean_stream.start_cleaning(derived.lines(stream), sink, checkpoint, derived.AS_OF).awaitTermination()
    return review_queries.shown(clean_stream.read_cleaned(spark, sink))


def _streamed_pairs(start, spark: SparkSession, folder: str) -> DataFrame:
    """Messages in three files dealt by a hash, so that each micro-batch brings late turns."""
    sink, checkpoint = shared_folder(spark, "pair-sink"), shared_folder(spark, "pair-progress")
    arrived = shared_folder(spark, "arrived")
    table(spark, folder, "conversations").repartition(3, F.xxhash64("conv_id", "turn")).write.parquet(arrived)
    start(stream_messages(spark, arrived, bytes_per_batch=1), sink, checkpoint).awaitTermination()
    return turn_stream.read_pairs(spark, sink)


def stream_turn_state(spark, folder):
    return _streamed_pairs(turn_stream.start_pairing, spark, folder)


def stream_live_turns(spark, folder):
    return _streamed_pairs(turn_stream.start_live_pairing, spark, folder)


QUERIES = {f.__name__: f for f in (
    lookup_users, match_status, insert_absent, insert_absent_status, upsert_users, update_present,
    update_present_status, delete_present, delete_present_status, apply_changes, apply_changes_outcomes, stored_users,
    stored_users_outcomes, page_items,
    extract_first_site, extract_second_site, extract_third_site, stream_clean_incremental,
    stream_clean_batches, stream_turn_state, stream_live_turns)}

_DAY = "DATE '2021-06-01' + CAST(doc_id % 1600 AS INTEGER)"
_LINES = "all_lines AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS line, unnest(range(0, len(str_split(text, chr(10))))) AS item_no FROM documents)"
_STARS = "CASE WHEN doc_id % 11 <> 0 THEN doc_id % 6 ELSE 0 END"


def _unescaped(c: str) -> str:
    # a reference at the end of a cut text may lack its semicolon
    for code, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
        c = f"regexp_replace({c}, '&{code};?', '{char}', 'g')"
    return c


SQL = {
    "lookup_users": f"""WITH {USERS} SELECT c.email, u.username FROM changes c LEFT JOIN users u USING (email) WHERE op = 'login'""",
    "match_status": f"""WITH {USERS} SELECT seq, c.email, CASE WHEN u.email IS NULL THEN 'not_found' WHEN u.password = c.password THEN 'ok'
        ELSE 'mismatch' END AS status FROM changes c LEFT JOIN users u USING (email) WHERE op = 'login'""",
    "insert_absent": f"""WITH {USERS} SELECT * FROM users UNION ALL SELECT email, password, username FROM (SELECT * FROM changes
        WHERE op = 'register' AND email NOT IN (SELECT email FROM users) QUALIFY row_number() OVER (PARTITION BY email ORDER BY seq) = 1)""",
    "insert_absent_status": f"""WITH {USERS} SELECT seq, c.email, CASE WHEN u.email IS NULL
          AND row_number() OVER (PARTITION BY c.email ORDER BY seq) = 1 THEN 'ok' ELSE 'exists' END AS status
        FROM changes c LEFT JOIN users u USING (email) WHERE op = 'register'""",
    "upsert_users": f"""WITH {USERS}, newest AS (SELECT * FROM changes WHERE op = 'upsert'
          QUALIFY row_number() OVER (PARTITION BY email ORDER BY seq DESC) = 1)
        SELECT email, password, username FROM newest UNION ALL SELECT * FROM users WHERE email NOT IN (SELECT email FROM newest)""",
    "update_present": f"""WITH {USERS}, newest AS (SELECT email, max_by(password, seq) AS p FROM changes WHERE op = 'update' GROUP BY email)
        SELECT email, coalesce(p, password) AS password, username FROM users LEFT JOIN newest USING (email)""",
    "update_present_status": f"""WITH {USERS} SELECT seq, c.email, CASE WHEN u.email IS NULL THEN 'not_found' ELSE 'ok' END AS status
        FROM changes c LEFT JOIN users u USING (email) WHERE op = 'update'""",
    "delete_present": f"""WITH {USERS} SELECT *, CASE WHEN email IN (SELECT email FROM changes WHERE op = 'delete') THEN 'deleted'
        ELSE 'kept' END AS outcome FROM users""",
    "delete_present_status": f"""WITH {USERS} SELECT seq, c.email, CASE WHEN u.email IS NOT NULL
          AND row_number() OVER (PARTITION BY c.email ORDER BY seq) = 1 THEN 'ok' ELSE 'not_found' END AS status
        FROM changes c LEFT JOIN users u USING (email) WHERE op = 'delete'""",
    "apply_changes": f"""WITH {HISTORY}, ends AS (SELECT email,
          max_by(op, seq) FILTER (op IN ('load', 'register', 'upsert', 'delete')) AS last_op,
          max_by(set_p, seq) FILTER (set_p IS NOT NULL) AS password, max_by(set_u, seq) FILTER (set_u IS NOT NULL) AS username
          FROM history GROUP BY email)
        SELECT email, password, username FROM ends WHERE last_op IN ('load', 'register', 'upsert')""",
    "apply_changes_outcomes": f"""WITH {HISTORY}, judged AS (SELECT *, CASE WHEN op = 'register' AND known THEN 'exists'
          WHEN op IN ('login', 'update', 'delete') AND NOT known THEN 'not_found'
          WHEN op = 'login' AND password <> old_p THEN 'mismatch' ELSE 'ok' END AS outcome FROM history WHERE op <> 'load')
        SELECT seq, op, email, outcome, CASE WHEN outcome = 'ok' THEN 'success' ELSE 'error' END AS status,
          CASE WHEN outcome = 'ok' THEN CASE op WHEN 'register' THEN 201 ELSE 200 END
            WHEN op IN ('login', 'register') THEN 400 ELSE 404 END AS code,
          CASE outcome WHEN 'exists' THEN 'User already Exists.' WHEN 'not_found' THEN 'User not Found.'
            WHEN 'mismatch' THEN 'Invalid ID/PW' ELSE CASE op WHEN 'login' THEN 'Login Success.'
            WHEN 'register' THEN 'User registeration success.' WHEN 'delete' THEN 'User Deletion Success'
            WHEN 'update' THEN 'User password updated successfully.' END END AS message,
          CASE WHEN outcome = 'ok' THEN CASE WHEN op IN ('register', 'upsert') THEN username ELSE old_u END END AS username
        FROM judged""",
    "page_items": f"""SELECT page_id, {trimmed(_unescaped("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} AS title,
        {trimmed(_unescaped("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS headline,
        len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links FROM pages""",
    "extract_first_site": f"""WITH {_LINES} SELECT doc_id AS page_id, item_no, CAST({_STARS} AS DOUBLE) AS rating,
        strftime({_DAY}, '%Y.%m.%d.') AS date, {trimmed('line')} AS content FROM all_lines WHERE doc_id % 13 <> 0""",
    "extract_second_site": f"""WITH {_LINES} SELECT doc_id AS page_id, item_no, CAST({_STARS} AS DOUBLE) AS rating,
        strftime({_DAY}, '%Y.%m.%d') AS date,
        CASE WHEN {trimmed('line')} = '' THEN 'first' ELSE 'first' || chr(10) || {trimmed('line')} END AS content FROM all_lines""",
    "extract_third_site": f"""WITH {_LINES} SELECT doc_id AS page_id, doc_id % 4 AS filter_index, item_no, CAST({_STARS} AS DOUBLE) AS rating,
        CASE WHEN doc_id % 2 = 0 THEN strftime({_DAY}, '%Y.%m.%d') ELSE strftime({_DAY}, '%Y-%m-%d') END AS date, {trimmed('line')} AS content
        FROM all_lines WHERE doc_id % 13 <> 0""",
    "stream_clean_incremental": review_queries.SQL["clean_reviews"],
    "stream_clean_batches": review_queries.SQL["clean_reviews"],
    "stream_turn_state": chat_queries.SQL["turn_pairs"],
    "stream_live_turns": chat_queries.SQL["turn_pairs"],
}
SQL["stored_users"], SQL["stored_users_outcomes"] = SQL["apply_changes"], SQL["apply_changes_outcomes"]
