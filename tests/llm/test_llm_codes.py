"""Vector codes against plain rounds, and the tree against all distances."""

import hashlib
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.llm import gnat, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and abs(x) < inf for x in v)


def plain(rows):
    """(vec_id, code, error, label_error) of rows of one length, and the digest of the codebooks."""
    rows = sorted((r for r in rows if usable(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[floor(1024 * Fraction(float(np.float32(x)))) for x in r[1]] for r in rows]
    width = len(vectors[0]) // 4
    parts = [[v[p * width:(p + 1) * width] for p in range(4)] for v in vectors]
    books = [[own[p] for own in parts[:256]] for p in range(4)]

    def nearest(own, book):
        return min((sum((a - b)**2 for a, b in zip(own, entry)), k) for k, entry in enumerate(book))
    for _ in range(4):
        for p in range(4):
            groups = {}
            for own in parts:
                groups.setdefault(nearest(own[p], books[p])[1], []).append(own[p])
            books[p] = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else entry for k, entry in enumerate(books[p])]
    found = [[nearest(own[p], books[p]) for p in range(4)] for own in parts]
    errors = [sum(e for e, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return (sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]]) for r, f, e in zip(rows, found, errors)), key=repr),
            hashlib.sha256(text.encode()).hexdigest())


def codes_of(spark, rows, partitions=3):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(partitions).withColumns(
        {c: F.lit(1) for c in ("code", "error", "place", "vector", "able", "n", "label_key", "hot", "row")})
    got = vector_codes.report(frame)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    out = got.collect()
    return sorted((tuple(r)[:4] for r in out), key=repr), {r.codebooks_sha256 for r in out}


def made(count, scale=0.3, size=16, seed=2):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in rng.normal(0, scale, size).astype(np.float32)], int(rng.integers(0, 5)) if k % 7 else None)
            for k in range(count)]


@pytest.mark.parametrize("scale, size, count", [(0.3, 16, 700), (0.001, 8, 600), (4000.0, 8, 300), (0.3, 4, 40)])
def test_codes_are_the_plain_ones(spark, scale, size, count):
    rows = made(count, scale, size)
    want, digest = plain(rows)
    assert codes_of(spark, rows) == (want, {digest})


def test_nulls_ties_and_repeated_rows(spark):
    """Null and bad vectors are left out; rows without an id come last; copies count each."""
    rows = made(300, 0.002, 8) + made(60, 0.002, 8)
    rows += [(None, [0.5] * 8, 3), (None, None, 1), (5, None, 2), (6, [nan] * 8, 2), (7, [None] + [0.0] * 7, 2), (8, [inf] + [0.0] * 7, 2), (9, [0.0] * 8, 4)] * 2
    want, digest = plain(rows)
    assert codes_of(spark, rows) == (want, {digest})


def test_other_lengths_and_huge_components_have_no_code(spark):
    rows = made(50, 0.3, 8)
    odd = [(100, [1.0] * 4, 1), (101, [], 1), (102, [1.0] * 7, None), (103, [1e30] * 8, 9), (104, [-3e38] * 8, 1)]
    want, digest = plain(rows)
    got, digests = codes_of(spark, rows + odd)
    assert digests == {digest}
    assert [r for r in got if r[0] < 100] == want
    sums = {label: total for (k, _, label), (i, _, _, total) in ((r, w) for r in rows for w in want if r[0] == w[0])}
    assert sorted(r for r in got if r[0] >= 100) == [(100, None, None, sums[1]), (101, None, None, sums[1]), (102, None, None, sums[None]),
                                                    (103, None, None, None), (104, None, None, sums[1])]


def test_no_rows(spark):
    assert codes_of(spark, []) == ([], set())
    assert codes_of(spark, [(1, None, 1), (2, [nan], 1)]) == ([], set())
    assert codes_of(spark, [(2, [1.0, 2.0], 1)])[0] == [(2, None, None, None)]
    zero = spark.createDataFrame([], SCHEMA)
    assert vector_codes.report(zero).count() == 0


def test_many_labels_beside_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT", 2)
    rows = [(k, v, 1 if k % 3 == 0 else k % 50) for k, v, _ in made(400, 0.3, 4)]
    want, digest = plain(rows)
    assert codes_of(spark, rows) == (want, {digest})


def test_codes_can_be_read_back(spark):
    rows = made(300, 0.3, 8)
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
    found = {r.vec_id: r for r in coded.collect()}
    back = vector_codes.decode([found[k].code for k, _, _ in rows], books)
    exact = np.array([np.floor(1024 * np.array(v)) for _, v, _ in rows])
    assert (((exact - back)**2).sum(axis=1) == [found[k].error for k, _, _ in rows]).all()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 120), st.integers(1, 5), st.sampled_from([1, 3, 50, 2**27]), st.integers(0, 10**6))
def test_the_tree_finds_the_lowest_nearest_point(count, width, reach, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-reach, reach + 1, (count, width))
    asked = rng.integers(-reach, reach + 1, (60, width))
    if reach < 1000:
        points, asked = points.astype(np.float64), asked.astype(np.float64)
    apart = ((asked.astype(np.int64)[:, None] - points.astype(np.int64)[None])**2).sum(axis=2)
    index, error = gnat.Tree(points).nearest(asked)
    assert (index == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()


def test_clustered_points_leave_subtrees_out(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(-10_000, 10_000, (16, 8))
    points = (centres[rng.integers(0, 16, 256)] + rng.integers(-20, 20, (256, 8))).astype(np.float64)
    asked = (centres[rng.integers(0, 16, 500)] + rng.integers(-20, 20, (500, 8))).astype(np.float64)
    tree, measured, whole = gnat.Tree(points), [], gnat.squared
    monkeypatch.setattr(gnat, "squared", lambda a, b: measured.append(len(a) * len(b)) or whole(a, b))
    index, _ = tree.nearest(asked)
    assert (index == whole(asked, points).argmin(axis=1)).all() and sum(measured) < 0.3 * len(asked) * len(points)
