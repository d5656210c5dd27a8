"""How the sources of a language differ in their terms: pairwise distances and telling terms.

Tasks count terms by length-bucketed packing (``term_runs``) and send one row for every
term of a (language, source) group and block of text; from there on Spark adds and joins.
A language keeps the terms of enough of its documents. With c occurrences of a kept term,
N of all and V kept terms, a group or a language gives it p = 1 + floor(UNIT * (c +
PRIOR) / (N + PRIOR * V)), in whole numbers throughout.

Two sources differ by the sum of |p - q| over all V terms. Most terms occur in neither
of two sources, where both give the p of no occurrence. So the sum is V times the
difference of these, corrected at the terms that occur. Corrections are
computed in groups of (language, two blocks of ``SOURCES`` sources, a share of the
terms), each with at most about ``ROWS`` counts per block, by dense arrays of ``TERMS``
terms at a time.

Defined cases: null text, language and source are ''; a row is a document, so rows that
repeat an id count each; texts without terms make their group occur; a language without
kept terms has distances 0 and no telling terms; a group alone in its language has no
pairs; ties go to the smaller item in UTF-8. An empty table gives an empty table. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.llm.term_runs import count_runs, gather
from reviewloom.llm.words import blocks, text_bytes
from reviewloom.session import stored

UNIT, PRIOR = 1_000_000_000, 5
#: Bytes of text whose terms are sorted together.
BLOCK = 16 << 20
#: Sources of a block, counts of a share of the terms, and terms of a dense array.
SOURCES, ROWS, TERMS = 256, 200_000, 2_048


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of every block; a row with an empty term tells that a group occurs."""
    for batch in blocks(batches, text=2, size=BLOCK):
        langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
        width = max(1, len(sources.dictionary))
        code = langs.indices.to_numpy() * width + sources.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        data, offsets = text_bytes(batch.column(2).take(pa.array(order)))
        starts, ends, group, n, docs = count_runs(data, offsets, code[order].astype(np.int64))
        there = np.unique(code)
        letters, cuts = gather(data, starts, ends)
        cuts = np.concatenate([cuts, np.repeat(cuts[-1], len(there))])
        group = np.concatenate([group, there])
        none = np.zeros(len(there), np.int64)
        term = pa.LargeStringArray.from_buffers(len(group), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(letters))
        found = pa.record_batch({
            "lang": langs.dictionary.take(pa.array(group // width)), "source": sources.dictionary.take(pa.array(group % width)),
            "term": term.cast(pa.string()), "n": pa.array(np.concatenate([n, none])), "docs": pa.array(np.concatenate([docs, none])),
        })
        yield from (found.slice(at, 100_000) for at in range(0, len(found), 100_000))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs of all documents; each group also has a row with an empty term."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return (texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * kept)), exact beyond 64 bits."""
    n, total, kept = (c.cast("decimal(19,0)") for c in (n, total, kept))
    return F.expr("1L") + F.call_function(
        "div", (n + F.lit(PRIOR)) * F.lit(UNIT), total + kept * F.lit(PRIOR))


def _corrections(rows: pa.Table, sources: pa.Table) -> pa.Table:
    """Of every pair of sources of two blocks: its distance, as far as this share of the terms tells it."""
    sources = sources.sort_by("number")
    number, block, none = (sources[c].to_numpy() for c in ("number", "block", "none"))
    left, right = (np.flatnonzero(block == sources[c][0].as_py()) for c in ("left", "right"))
    total = np.zeros((len(left), len(right)), np.int64)
    apart = np.abs(none[left][:, None] - none[right][None, :])
    if sources["share"][0].as_py() == 0:
        total += sources["kept"][0].as_py() * apart
    terms = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy() if len(rows) else np.zeros(0, np.int64)
    order = np.argsort(terms, kind="stable")
    terms, who, p = terms[order], np.searchsorted(number, rows["number"].to_numpy())[order], rows["p"].to_numpy()[order]
    for first in range(0, int(terms[-1]) + 1 if len(terms) else 0, TERMS):
        here = slice(*np.searchsorted(terms, [first, first + TERMS]))
        width = min(TERMS, int(terms[-1]) + 1 - first)
        dense = np.repeat(none[:, None], width, axis=1)
        dense[who[here], terms[here] - first] = p[here]
        others = dense[right]
        for row, own in enumerate(dense[left]):
            total[row] += np.abs(others - own).sum(axis=1)
        total -= width * apart
    one, two = np.nonzero(number[left][:, None] < number[right][None, :])
    return pa.table({
        "lang": pc.take(sources["lang"], pa.array(left[one])), "source": pc.take(sources["source"], pa.array(left[one])),
        "item": pc.take(sources["source"], pa.array(right[two])), "value": pa.array(total[one, two]),
    })


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances to every other source, and the terms a source uses more."""
    counts = stored(term_counts(docs), "term-counts")
    kept = (counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
            .where(F.col("docs") >= least_docs).select("lang", "term", "lang_n"))
    rows = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("counts"))
    by_lang = (rows.groupBy("lang", "term").agg(F.first("lang_n").alias("n"))
               .groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("kept")))
    in_lang = Window.partitionBy("lang")
    groups = stored(
        counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left")
        .join(by_lang, "lang", "left").na.fill(0, ["total", "counts", "lang_total", "kept"])
        .withColumns({
            "number": F.row_number().over(in_lang.orderBy("source")) - 1,
            "blocks": F.ceil(F.count(F.lit(1)).over(in_lang) / SOURCES),
            "shares": F.greatest(F.ceil(F.sum("counts").over(in_lang) / ROWS), F.lit(1)),
            "none": F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0)),
        }).withColumn("block", F.floor(F.col("number") / SOURCES)), "source-groups")
    shares = rows.join(groups, ["lang", "source"]).withColumns({
        "p": _share(F.col("n"), F.col("total"), F.col("kept")),
        "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))})

    def paired(frame: DataFrame) -> DataFrame:
        return (frame.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
                .withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
                .select(*(F.col(c).alias(c) for c in (*frame.columns, "left", "right")))
                .groupBy("lang", "left", "right", "share"))

    distances = (
        paired(shares.select("lang", "number", "block", "blocks", "term", "p",
                             F.pmod(F.xxhash64("term"), F.col("shares")).alias("share")))
        .cogroup(paired(groups.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))))
        .applyInArrow(_corrections, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    pairs = distances.select("lang", F.inline(F.array(
        F.struct("source", "item", "value"),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = (shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
               .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumns({"rank": F.row_number().over(own), "part": F.lit("pair")}).select(columns)
            .unionByName(telling.withColumn("part", F.lit("term")).select(columns)))
