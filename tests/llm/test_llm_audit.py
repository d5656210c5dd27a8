"""How sources differ in their terms, against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import no_docs, odd_docs, odd_rows
from reviewloom.llm import divergence, term_runs

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_docs, top=50):
    """Every row of the audit, by dictionaries."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = [s for la, s in counts if la == lang]
        every = Counter()
        for s in sources:
            every.update(counts[lang, s])

        def shares(own):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 5) // (total + 5 * len(kept)) for t in kept}
        p, q = shares(counts[lang, source]), shares(every)
        pairs = []
        for other in sources:
            if other != source:
                r = shares(counts[lang, other])
                pairs.append((-sum(abs(p[t] - r[t]) for t in kept), other.encode()))
        telling = [(q[t] - p[t], t.encode()) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(telling)[:top])):
            out += [(lang, source, part, i.decode(), -v, n + 1) for n, (v, i) in enumerate(found)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def many_rows():
    rng = np.random.default_rng(5)
    vocabulary = [w for k in range(40) for w in (f"w{chr(97 + k % 26)}{'x' * (k % 23)}", "é" * (k % 21 + 1), "Mixed" + "CASE" * (k % 6))]
    rows = []
    for doc in range(400):
        here = rng.choice(vocabulary, rng.integers(0, 60)).tolist()
        rows.append((doc, " ".join(here) if doc % 17 else None, ["en", "de", None][doc % 3],
                     f"src{int(rng.integers(0, 9))}" if doc % 13 else None, 0))
    return rows + rows[:40]


@pytest.mark.parametrize("least", [1, 2, 30])
def test_the_audit_is_the_plain_one(spark, least):
    from llm_cases import SCHEMA
    rows = many_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(divergence.audit(frame, least_docs=least)) == plain(rows, least)


def test_awkward_documents(spark):
    got = rows_of(divergence.audit(odd_docs(spark), least_docs=2))
    assert got == plain(odd_rows(), 2) and any(r[2] == "term" for r in got)
    assert divergence.audit(odd_docs(spark), least_docs=1000).filter("part = 'term' OR value <> 0").count() == 0
    empty = divergence.audit(no_docs(spark))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and empty.count() == 0


def test_blocks_of_sources_and_shares_of_terms_change_nothing(spark, monkeypatch):
    """Small blocks: every pair of blocks and every share is used."""
    from llm_cases import SCHEMA
    rows = many_rows()
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "ROWS", 40)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    counts = divergence.audit(frame, least_docs=2)
    assert rows_of(counts) == plain(rows, 2)


def test_dense_arrays_of_few_terms_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    sources = pa.table({"number": [0, 1, 2, 3], "block": [0, 0, 0, 0], "left": [0] * 4, "right": [0] * 4, "none": [5, 7, 6, 9],
                        "share": [0] * 4, "kept": [40] * 4, "lang": ["en"] * 4, "source": list("abcd")})
    places = sorted(rng.choice(4 * 30, 70, replace=False).tolist())
    rows = pa.table({"term": [f"t{k % 30}" for k in places], "number": [k // 30 for k in places],
                     "p": rng.integers(8, 90, 70)})
    whole = divergence._corrections(rows, sources)
    monkeypatch.setattr(divergence, "TERMS", 4)
    assert divergence._corrections(rows, sources) == whole and len(whole) == 6


def test_a_hot_source(spark):
    from llm_cases import SCHEMA
    rows = [(k, f"common word{chr(97 + k % 7)} {'hot' if k % 3 else 'cold' + chr(97 + k % 5)}", "en", "hot" if k % 3 else f"s{k % 30}", 0)
            for k in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(12)
    assert rows_of(divergence.audit(frame)) == plain(rows, 30)
    # what a block sends for a group does not grow with the group
    assert divergence.term_counts(frame).filter("source = 'hot'").count() == 1 + 1 + 7 + 1


def texts_of(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data])


def test_runs_count_terms_of_every_length():
    rng = np.random.default_rng(3)
    pool = ["a" * n for n in (1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 300)] + ["ab", "AB", "ba", "é", "éa", "zz" * 40 + "y", "b" + "a" * 16, "漢字" * 9]
    texts = [" ".join(rng.choice(pool, rng.integers(0, 50))) for _ in range(200)] + ["", "-", "tail"]
    groups = np.sort(rng.integers(0, 4, len(texts)))
    data, offsets = texts_of(texts)
    starts, ends, group, n, docs = term_runs.count_runs(data, offsets, groups)
    letters, cuts = term_runs.gather(data, starts, ends)
    got = {(letters[a:b].tobytes().decode(), int(g)): (int(x), int(d)) for a, b, g, x, d in zip(cuts, cuts[1:], group, n, docs)}
    want = defaultdict(lambda: [0, 0])
    for text, g in zip(texts, groups):
        for term, times in Counter(TERM.findall(text.translate(LOWER))).items():
            want[term, int(g)][0] += times
            want[term, int(g)][1] += 1
    assert got == {k: tuple(v) for k, v in want.items()} and len(got) == len(starts)


def test_a_term_ends_with_its_text():
    data, offsets = texts_of(["ab", "cd", "", "e"])
    starts, ends, text = term_runs.terms(data, offsets)
    assert list(zip(starts, ends, text)) == [(0, 2, 0), (2, 4, 1), (4, 5, 3)]


def test_radix_order_is_stable_and_right():
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 5, 1000).astype(np.uint64) << np.uint64(60), rng.integers(0, 2**63, 1000).astype(np.uint64) % np.uint64(7)
    assert (term_runs.radix_order([one, two]) == np.lexsort((two, one))).all()
