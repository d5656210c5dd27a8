"""The corpus pipeline stage by stage against plain versions."""

import corpus_pipeline
import pytest
from llm_cases import classes, copies, fingerprint, no_docs, odd_docs
from test_llm_budget import pieces_are_whole

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage gets, and those of the last one's result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, given[-1], SF).write.parquet(path)
        given.append(spark.read.parquet(path))
    return given


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "simhash_near_dedup", "mix_sources", "pack_sequences"]
    assert all(given.columns == stages[0].columns for given in stages[:-1])


def test_language_keeps_clean_documents(stages):
    assert stages[1].count() >= 0.99 * stages[0].count()


def test_copies_go(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    marked, _ = copies(rows)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({best for _, best, _, _ in marked})


def test_near_duplicates_go(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    of = classes([fingerprint(t) for _, t in rows], 2)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({rows[c][0] for c in of})


def test_mixture_follows_the_weights(stages):
    assert set(r.doc_id for r in stages[4].collect()) <= set(r.doc_id for r in stages[3].collect())
    assert stages[4].count() > 0.5 * stages[3].count()


def test_sequences_hold_all_that_was_mixed(stages):
    rows = [(r.doc_id, r.text) for r in stages[4].collect()]
    assert pieces_are_whole(rows, stages[5].collect()) == 0


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1].count()


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_odd_documents(spark, tmp_path, make):
    docs = make(spark)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
