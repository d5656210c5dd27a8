"""Exact copies, near duplicates and repeated passages against plain versions."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import classes, copies, fingerprint, no_docs, odd_docs, odd_rows, repeats
from pyspark.sql import functions as F

from reviewloom.llm import content_sort, repeats as passages, simhash
from reviewloom.llm.components import components


@pytest.mark.parametrize("heavy", [1000, 5, 1])
def test_exact_copies(spark, monkeypatch, heavy):
    """Sorted and pre-aggregated groups give the same answer: with 5, groups of more than 5 rows are heavy."""
    monkeypatch.setattr(content_sort, "HEAVY_ROWS", heavy)
    rows = odd_rows() + [(100 + k, "many copies" + " " * (k % 3), "en", "src0", 0) for k in range(40)]
    docs = odd_docs(spark, rows)
    found = content_sort.mark_copies(docs)
    got = [(r.row.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found.collect()]
    expected, groups = copies([r[:2] for r in rows])
    assert sorted(got, key=repr) == expected
    kept = content_sort.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == groups
    by_id = {r.row.doc_id: r.kept for r in found.where("row.doc_id IS NOT NULL AND row.doc_id <> 17").collect()}
    assert by_id[102] and not by_id[100] and by_id[2] and not by_id[1]
    assert found.where("row.doc_id = 17 AND kept").count() == 1


def test_many_rows_without_id_and_text(spark, monkeypatch):
    """A third of the rows are alike in every column: no task counts them one by one, and one is kept."""
    monkeypatch.setattr(content_sort, "HEAVY_ROWS", 50)
    rows = spark.range(6000).selectExpr("IF(id % 3 = 0, null, id) AS doc_id", "IF(id % 3 = 0, null, concat('text ', id)) AS text").repartition(8)
    marked = content_sort.mark_copies(rows)
    assert marked.count() == 6000 and marked.where("kept").count() == 4001
    assert {(r.kept, r.group_size, r["count"]) for r in marked.where("row.doc_id IS NULL").groupBy("kept", "group_size").count().collect()} == {
        (True, 2000, 1), (False, 2000, 1999)}


def test_exact_copies_of_nothing(spark):
    assert content_sort.mark_copies(no_docs(spark)).count() == 0


def test_masks_hide_any_differences():
    for radius in (1, 2):
        tables = simhash.masks(radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(64), radius):
            assert any(not table & sum(1 << b for b in bits) for table in tables)
    free = 0xFFFF00000000FFFF
    for bits in itertools.combinations([b for b in range(64) if free >> b & 1], 2):
        assert any(not table & sum(1 << b for b in bits) for table in simhash.masks(2, free))


def test_fingerprints_and_components(spark):
    rows = odd_rows()
    prints = [fingerprint(r[1]) for r in rows]
    of = classes(prints, 2)
    least = {}
    for r, c in zip(rows, of):
        if r[0] is not None:
            least[c] = min(least.get(c, 2**63), r[0])
    expected = sorted(((r[0], format(p, "016x"), least.get(c)) for r, p, c in zip(rows, prints, of)), key=repr)
    got = [tuple(r) for r in simhash.near_duplicates(odd_docs(spark)).collect()]
    assert sorted(got, key=repr) == expected
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_miss_no_pair(spark, monkeypatch, bucket):
    """Clusters of fingerprints a few bits apart, with buckets compared directly and divided."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    found = set()
    for _ in range(30):
        centre = int(rng.integers(2**63)) * 2 + 1
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            found.add(centre ^ sum(1 << int(b) for b in flips))
    found = sorted(found)
    of = classes(found, 2)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in found], "bits long")
    roots = {r.node: r.root for r in components(simhash.links(frame, 2)).collect()}
    groups = {}
    for x, c in zip(found, of):
        groups.setdefault(c, set()).add(roots.get(simhash._signed(x), simhash._signed(x)))
    assert all(len(r) == 1 for r in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_one_of_each_near_duplicate_group_stays(spark):
    docs = odd_docs(spark)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    marked = simhash.near_duplicates(docs)
    assert kept.where("doc_id IS NOT NULL").count() == marked.where("doc_id = component_id").select("doc_id").distinct().count()
    assert kept.where("doc_id IS NULL").count() == 2


def test_long_chains_are_one_component(spark):
    links = spark.range(1, 400).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    got = components(links.unionByName(spark.createDataFrame([(900, 901)], "u long, v long")))
    assert {r.root for r in got.where("node < 900").collect()} == {0} and got.count() == 400


@pytest.mark.parametrize("group", [1000, 2])
def test_repeated_passages(spark, monkeypatch, group):
    monkeypatch.setattr(passages, "GROUP", group)
    rows = odd_rows()
    rng = np.random.default_rng(3)
    parts = [" ".join(f"p{k}q{n}" for n in rng.integers(0, 40, 55)) for k in range(4)]
    rows += [(200 + k, " ".join([f"own{k}"] * 3 + [parts[n] for n in rng.integers(0, 4, 3)]), "en", "s", 0)
             for k in range(12)]
    found = passages.without_repeats(odd_docs(spark, rows))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()]
    assert sorted(got, key=repr) == repeats([r[:2] for r in rows])
    assert passages.without_repeats(no_docs(spark)).count() == 0


def test_shorter_passages(spark):
    rows = [(k, f"a{k} " + " ".join(f"x{n}" for n in range(k % 5, k % 5 + 9)), "en", "s", 0) for k in range(15)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
           for r in passages.without_repeats(odd_docs(spark, rows), width=6).collect()]
    assert sorted(got, key=repr) == repeats([r[:2] for r in rows], 6)


def test_whole_tables(spark, sf):
    """The registered queries on the small tables."""
    from reviewloom.llm import queries
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_substring_dedup(spark, sf).collect()]
    assert sorted(got, key=repr) == repeats(rows)
    prints = [fingerprint(t) for _, t in rows]
    of = classes(prints, 2)
    least = {}
    for (d, _), c in zip(rows, of):
        least[c] = min(least.get(c, 2**63), d)
    got = {tuple(r) for r in queries.op10_simhash_near_dedup(spark, sf).collect()}
    assert got == {(d, format(p, "016x"), least[c]) for (d, _), p, c in zip(rows, prints, of)}


def test_an_id_on_two_texts_is_two_documents(spark):
    one = "the quick brown fox jumps over the lazy dog near the river bank today"
    other = "an entirely different text about mountains and valleys in the far north of the land"
    frame = spark.createDataFrame([(1, one), (5, one), (5, other), (5, other), (None, one), (None, None)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.without_near_duplicates(frame).collect()]
    assert sorted(kept, key=repr) == sorted([(1, one), (5, other), (None, one), (None, None)], key=repr)


def test_one_of_two_linked_texts_with_one_id_stays(spark):
    words_ = [f"w{k}" for k in range(400)]
    texts = [" ".join(words_), " ".join(words_ + ["tail"])]
    assert simhash.near_duplicates(spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string")).select(
        "component_id").distinct().count() == 1
    frame = spark.createDataFrame([(1, t) for t in texts] * 3, "doc_id long, text string")
    assert simhash.without_near_duplicates(frame).count() == 1


@pytest.mark.parametrize("seed", range(8))
def test_suffix_trees_are_those_of_sorted_suffixes(seed):
    rng = np.random.default_rng(seed)
    runs = [rng.integers(0, 1 + seed % 3, rng.integers(1, 40)).tolist() for _ in range(rng.integers(1, 12))]
    words = np.array([w for run in runs for w in run])
    left = np.array([len(run) - k for run in runs for k in range(len(run))])
    order, depth = passages.suffix_tree(words, left)
    suffixes = [run[k:] for run in runs for k in range(len(run))]
    assert sorted(order.tolist()) == list(range(len(words)))
    in_order = [suffixes[k] for k in order]
    assert in_order == sorted(suffixes)

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert depth.tolist() == [0] + [common(a, b) for a, b in zip(in_order, in_order[1:])]


def test_equal_hashes_of_other_words_remove_nothing(spark, monkeypatch):
    """Every window has one prefix and one label: only the words tell them apart."""
    monkeypatch.setattr(passages, "windows", lambda words, width: np.zeros(max(0, len(words) - width + 1), np.uint64))
    rng = np.random.default_rng(6)
    passage = [f"p{k}" for k in range(60)]
    rows = [(d, " ".join([f"d{d}x{k}" for k in range(rng.integers(0, 40))] + (passage if d % 3 else passage[:40]) + [f"e{d}"] * 70)) for d in range(12)]
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows]), pa.array([d for d, _ in rows]),
                                           pa.array([[{"prefix": 0, "parts": 1}]] * len(rows),
                                                    pa.list_(pa.struct([("prefix", pa.int64()), ("parts", pa.int64())])))], ["id", "text", "key", "shared"])]
    found = [b for b in passages._subtrees(passages._suffixes(iter(batches), 50), 50)]
    marked = {}
    for b in found:
        for i, place, marks in zip(*(b.column(c).to_pylist() for c in ("id", "place", "marks"))):
            marked.setdefault(i, set()).update(place + k for k in range(31) if marks >> k & 1)
    first = {}
    for d, text in rows:
        own = text.split()
        want = {k for k in range(len(own) - 49) if first.setdefault(tuple(own[k:k + 50]), d) < d}
        assert marked.get(d, set()) == want
