"""Language of texts by Bayesian fusion of several kinds of evidence.

* Text: naive Bayes over hashed byte trigrams. The profiles are fitted on about
  ``SAMPLE`` rows for each language that ``LEAST_ROWS`` rows declare, drawn
  by a hash of the row; texts are read whole. Trigrams overlap, so a text counts as
  at most ``TRIGRAMS`` independent ones. One more class spreads evenly over all
  trigrams; a text that fits it best is in none of the languages.
* Declared markup language: how often each declaration goes with each language.
* Address suffix: how often each suffix goes with each language.
* Host prior: the languages of a host's other texts, smoothed towards those of its
  parent domain, and these towards the whole table.

The last three are counts over all rows, made by grouped aggregation from the
languages that the text alone suggests; a row's own text is taken out of its host's
and parent's counts. Hosts and suffixes are joined, not broadcast, as they grow with the data.

Defined cases: a text without letters (null, empty, digits, marks) is in no
language ("und", confidence 0, not kept); null declarations, suffixes and hosts are
no evidence; with no usable declaration in the table every row is "und". A row whose
declaration has too few rows for a profile, and whose text is in none of the other
languages, is kept under its declaration with confidence ``CONFIDENCE``. Equal
scores go to the language that sorts first. Repeated rows are returned each. An
empty table gives an empty table. Other columns travel in the struct ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.llm.words import blocks, text_bytes
from reviewloom.session import stored

#: Bounds of the fitted model: rows per language (expected number), hashed trigrams.
SAMPLE, BUCKETS = 1000, 1 << 15
#: A language needs this many rows that declare it.
LEAST_ROWS = 5
#: Trigrams of a text that count as independent.
TRIGRAMS = 60
#: Strength of a prior in rows, and the least confidence of an accepted row.
STRENGTH, CONFIDENCE = 5.0, 0.5
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_TAG = re.compile(r"[a-z]{2,3}")


def declared_language(tag: Column) -> Column:
    """The primary part of a language tag, in lower case; null where there is none."""
    found = F.regexp_extract(F.lower(F.trim(tag)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(found != "", found)


def html_language(html: Column) -> Column:
    return declared_language(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"^www\.", ""))


def suffix_of(url: Column) -> Column:
    """The top-level domain, and a first path part that looks like a language."""
    top = F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1)
    path = F.regexp_extract(F.lower(url), r"^[^?#]*?//[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    return F.when((top != "") | (path != ""), F.concat_ws("/", top, path))


def _trigrams(batch: pa.RecordBatch, text: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of a batch that hold a letter, and where each text's begin among them."""
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    texts = pc.fill_null(batch.column(text).cast(pa.large_string()), none)
    data, offsets = text_bytes(pc.binary_join_element_wise(none, texts, none, space))
    folded = _FOLD[data]
    if len(folded) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:]
    use = (folded[1:-1] != 32) & (code != 0)
    ends = offsets[1:-1]
    for back in (1, 2):  # not across texts
        use[(ends - back)[(ends - back >= 0) & (ends - back < len(use))]] = False
    at = np.flatnonzero(use)
    hashed = (code[at] * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return hashed.astype(np.int64), np.searchsorted(at, offsets)


def _fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihood of each trigram in each; the last column is no language.

    ``rows`` has declared, text and draw, a hash of the row.
    """
    counted = (rows.where("declared IS NOT NULL").groupBy("declared").count()
               .where(F.col("count") >= LEAST_ROWS).collect())
    sizes = {r["declared"]: r["count"] for r in counted}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((BUCKETS, 1), np.float32)
    part = F.create_map(*(F.lit(x) for name in names for x in (name, SAMPLE / sizes[name])))[F.col("declared")]
    drawn = F.pmod(F.col("draw"), F.lit(1 << 20)) < part * (1 << 20)

    def profile(key: tuple[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in blocks(batches):
            total += np.bincount(_trigrams(batch, 1)[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()])],
                                         ["declared", "counts"])

    # a bounded sample: one task per language is enough
    profiles = (rows.where(drawn).select("declared", "text").groupBy("declared")
                .applyInArrow(profile, "declared string, counts binary").collect())
    table = np.full((BUCKETS, len(names) + 1), -np.log(BUCKETS), np.float32)
    for r in profiles:
        counts = np.frombuffer(r["counts"], np.int64) + 0.1
        table[:, names.index(r["declared"])] = np.log(counts / counts.sum())
    return names, table


def _scores(batches: Iterator[pa.RecordBatch], model: np.ndarray) -> Iterator[pa.RecordBatch]:
    kinds = model.shape[1]
    for batch in blocks(batches, text=1, size=2 << 20):
        found, first = _trigrams(batch, 1)
        counts = np.diff(first)
        sums = np.zeros((len(batch), kinds))
        full = np.flatnonzero(counts)
        if len(full):
            sums[full] = np.add.reduceat(model[found], first[full], axis=0, dtype=np.float64)
        sums *= (np.minimum(counts, TRIGRAMS) / np.maximum(counts, 1))[:, None]
        best = np.where(counts > 0, sums.argmax(axis=1), kinds - 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts.astype(np.int64)), pa.array(best.astype(np.int64)),
             pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, kinds).astype(np.int32)),
                                      pa.array(np.round(sums, 6).ravel()))],
            ["evidence", "trigrams", "text_best", "scores"])


def _counts(rows: DataFrame, by: str, kinds: int, names: str) -> DataFrame:
    """For each value of ``by`` the number of texts of each language, as an array, and of all texts."""
    return rows.where(F.col(by).isNotNull()).groupBy(F.col(by).alias(names)).agg(
        F.array(*(F.count(F.when(F.col("text_best") == k, 1)).cast("double") for k in range(kinds))).alias(names + "_n"),
        F.count(F.lit(1)).cast("double").alias(names + "_all"))


def identify(rows: DataFrame, text: Column, declared: Column, suffix: Column, host: Column,
             keep: Column) -> DataFrame:
    """keep (as given), declared, text_language, language, confidence and accepted of each row."""
    given = rows.select(F.struct(keep.alias("keep"), declared.alias("declared"), suffix.alias("suffix"),
                                 host.alias("host"),
                                 F.coalesce(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("parent"))
                        .alias("evidence"), text.alias("text"))
    # drawn by row: all copies of one text must not be drawn together
    names, model = _fit(given.select(F.col("evidence.declared").alias("declared"), "text",
                                     F.xxhash64("evidence.keep", "text").alias("draw")))
    kinds = model.shape[1]
    shape = given.schema["evidence"].dataType.simpleString()
    read = stored(given.mapInArrow(
        lambda b: _scores(b, model),
        f"evidence {shape}, trigrams long, text_best long, scores array<double>"), "language-scores")
    read = read.select("evidence.*", "trigrams", "text_best", "scores")

    usual = [r + 1.0 for r in read.agg(*(F.count(F.when(F.col("text_best") == k, 1)) for k in range(kinds))).first()]
    base = [x / sum(usual) for x in usual]

    # expressions of one language k, so that plans do not grow with the languages
    def prior(value: str, own: Column, under: Callable[[Column], Column]) -> Callable[[Column], Column]:
        total = F.coalesce(f"{value}_all", F.lit(0.0)) - own + STRENGTH

        def share(k: Column) -> Column:
            seen = F.coalesce(F.col(f"{value}_n")[k], F.lit(0.0)) - F.when(F.col("text_best") == k, own).otherwise(0.0)
            return (seen + STRENGTH * under(k)) / total
        return share

    all_usual = F.array(*(F.lit(x) for x in usual))

    def told(value: str, k: Column) -> Column:
        """log P(value | language), from counts smoothed by the value's share of all rows."""
        return F.when(F.col(f"{value}_n").isNull(), 0.0).otherwise(F.log(
            (F.col(f"{value}_n")[k] + STRENGTH * F.col(f"{value}_all") / sum(usual)) / (all_usual[k] + STRENGTH)))

    joined = read
    for by in ("declared", "suffix", "host", "parent"):
        table = _counts(read, by, kinds, f"{by}_of")
        # rows without a value must not meet in one task
        key = F.coalesce(F.col(by), F.concat(F.lit("\0"), F.pmod(F.xxhash64("scores"), F.lit(1 << 16))))
        joined = joined.join(table, key == table[f"{by}_of"], "left")
    world = F.array(*(F.lit(x) for x in base))
    own_host, own_parent = (F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0) for c in ("host", "parent"))
    hosts = prior("host_of", own_host, prior("parent_of", own_parent, lambda k: world[k]))
    fused = joined.withColumn("logs", F.transform(
        "scores", lambda s, k: s + F.log(hosts(k)) + told("declared_of", k) + told("suffix_of", k)))
    top = F.array_max("logs")
    labels = F.array(*(F.lit(x) for x in [*names, UNKNOWN]))
    empty = F.col("trigrams") == 0
    fused = fused.withColumn("best", F.array_position("logs", top) - 1).withColumn(
        "sure", 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    language = F.when(empty, UNKNOWN).otherwise(labels[F.col("best").cast("int")])
    confidence = F.when(empty, 0.0).otherwise(F.round("sure", 6))
    # a declaration that no profile can contradict
    believed = ~empty & F.col("declared").isNotNull() & ~F.array_contains(labels, F.col("declared")) & (
        (language == UNKNOWN) | (confidence < CONFIDENCE))
    language = F.when(believed, F.col("declared")).otherwise(language)
    confidence = F.when(believed, CONFIDENCE).otherwise(confidence)
    return fused.select("keep", "declared", F.when(empty, UNKNOWN).otherwise(labels[F.col("text_best").cast("int")])
                        .alias("text_language"), language.alias("language"), confidence.alias("confidence"),
                        ((language != UNKNOWN) & (confidence >= CONFIDENCE)).alias("accepted"))


def document_languages(docs: DataFrame) -> DataFrame:
    """doc_id, declared, text_language, language, confidence, kept; the source takes the part of the host."""
    found = identify(docs, F.col("text"), declared_language(F.col("lang")), F.lit(None).cast("string"),
                     F.col("source"), F.col("doc_id"))
    return found.withColumnRenamed("keep", "doc_id").withColumnRenamed("accepted", "kept")


def page_languages(pages: DataFrame) -> DataFrame:
    """page_id, declared, text_language, language, confidence, kept of raw pages; tags are left out of the text."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    found = identify(pages, text, html_language(F.col("html")), suffix_of(F.col("url")), host_of(F.col("url")),
                     F.col("page_id"))
    return found.withColumnRenamed("keep", "page_id").withColumnRenamed("accepted", "kept")


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is known, with their own columns; rows without an id are judged like others.

    Decisions are joined by id and text, so rows that share an id are told apart.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit("")), "lang", "source").alias("hash"))
    found = identify(docs, F.col("text"), declared_language(F.col("lang")), F.lit(None).cast("string"),
                     F.col("source"), key)
    gone = found.where("NOT accepted").select("keep.*").distinct()
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return rows.join(gone, rows["key.id"].eqNullSafe(gone["id"]) & (rows["key.hash"] == gone["hash"]),
                     "left_anti").select("row.*")
