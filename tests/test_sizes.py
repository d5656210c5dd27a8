"""What queries write in between has as many files as the data asks for; every row stays."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewloom.plans import file_queries, table_queries
from reviewloom.sources import keyed_store


@pytest.fixture
def documents(spark, tmp_path):
    """Twelve documents in four files, with one text in three of them."""
    text = F.when(F.col("id") % 4 == 0, "the same line of some length").otherwise(F.concat(F.lit("a line with number "), F.col("id").cast("string")))
    (spark.range(200, 212, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"),
                                        F.lit("web").alias("source"), F.length(text).cast("long").alias("n_chars"))
     .write.parquet(f"{tmp_path}/documents.parquet"))
    return str(tmp_path)


def files(folder):
    return [p for p in Path(folder).rglob("part-*") if p.stat().st_size]


def kept_folders(monkeypatch, module):
    folders, make = {}, module.shared_folder

    def made(spark, purpose):
        folders[purpose] = make(spark, purpose)
        return folders[purpose]
    monkeypatch.setattr(module, "shared_folder", made)
    return folders


def local(path):
    return path.removeprefix("file:")


def test_collection_parts_are_cut_by_the_data(spark, documents, monkeypatch):
    folders = kept_folders(monkeypatch, file_queries)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = file_queries.collection_first_copies(spark, documents).orderBy("ingest_seq").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(files(local(folders["collection"]) + "/c")) > 2
    assert [r["ingest_seq"] for r in rows] == [0, 1, 2, 3, 5, 6, 7, 9, 10, 11]


def test_arrivals_are_batches_of_any_number_of_files(spark, documents, monkeypatch):
    folders = kept_folders(monkeypatch, table_queries)
    got = table_queries.stream_clean_batches(spark, documents)
    want = table_queries.stream_clean_incremental(spark, documents)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    assert len(files(local(folders["arrived"]))) > 3


def test_a_batch_computes_its_history_once(spark, tmp_path, monkeypatch):
    purposes, write = [], keyed_store.stored
    monkeypatch.setattr(keyed_store, "stored", lambda df, purpose: (purposes.append(purpose), write(df, purpose))[1])
    users = spark.createDataFrame([("a@x", "p", "A"), ("b@x", "q", None)], "email string, password string, username string")
    changes = spark.createDataFrame([(0, "update", "a@x", "n", "-"), (1, "delete", "b@x", None, None), (2, "register", "b@x", "r", "B")],
                                    "seq long, op string, email string, password string, username string")
    keyed_store.create(users, f"{tmp_path}/users", buckets=2)
    outcomes = keyed_store.apply_batch(changes, f"{tmp_path}/users", 1).orderBy("seq").collect()
    assert purposes.count("history") == 1
    assert [(r["outcome"], r["username"]) for r in outcomes] == [("ok", "A"), ("ok", None), ("ok", "B")]
    assert {tuple(r) for r in keyed_store.read(spark, f"{tmp_path}/users").collect()} == {("a@x", "n", "A"), ("b@x", "r", "B")}
