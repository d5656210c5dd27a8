"""Repeated passages removed by suffix trees, one for every group of suffixes with a common prefix.

A suffix starts at every word, and a passage of ``width`` words that occurs twice
is the beginning of an internal node's path, at depth ``width`` or more, in the suffix tree of all texts.
The tree is divided into subtrees by prefixes of variable length: a suffix belongs to the one that
ends with the first ``width`` words' marker, the run of ``width // 2`` words with the
smallest hash. Equal passages have equal prefixes, so a node never lies in two groups.

1. One scan finds each text's prefixes and the digest of its words. Texts with the
   same words are one string of the tree; only the smallest id stays in it.
2. Prefixes are counted. One that lies in a single text leads to no repeat, and all
   its suffixes are dropped; this leaves the texts that share something.
3. The suffixes of shared prefixes are dealt to their groups as runs of neighbouring
   starts, with their words up to the end of the last start's passage. A prefix with
   more than ``GROUP`` texts is divided by id as well.
4. In a group all suffixes are sorted, by ranks of their first 1, 2, 4, ... words, and the
   lengths of the common prefixes of neighbours tell the internal nodes: those at depth
   ``width`` or more are maximal repeats. A start below one that also holds a smaller id begins a repeat. Of a
   divided prefix, only one start for each node and part stays undecided, and a
   second, small round compares these passages.
5. Words covered by repeats are removed from the texts that have any.

Hashes only choose groups and candidates; what is equal is decided by the words.

Defined cases: null and empty texts have no words; a text with fewer words than a
passage keeps them all; a null id counts as larger than every other; rows with
the same id never remove each other's words; repeated rows are returned each. An
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reviewloom.llm.words import blocks, hashes, spans, text_bytes, windows
from reviewloom.session import stored

WIDTH = 50
#: Texts of one prefix that are compared together.
GROUP = 1000
_LAST = 2**63 - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts, starts and ends of their words, and where each text's words begin."""
    data, offsets = text_bytes(texts)
    return data, *spans(data, offsets)


def _labels(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray],
            width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text; of every window: its text, place in it, prefix and label (a hash of all its words)."""
    data, starts, ends, first = found
    own = hashes(data, starts, ends)
    counts = np.diff(first)
    if len(own) < width:
        none = np.zeros(0, np.int64)
        return counts, none, none, none, none
    least = windows(own, width // 2)
    reach, wanted = 1, width - width // 2 + 1
    while reach < wanted:
        step = min(reach, wanted - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    text = np.repeat(np.arange(len(counts)), counts)[:len(least)]
    at = np.arange(len(least))
    inside = at + width <= first[text + 1]
    text, at = text[inside], at[inside]
    return counts, text, at - first[text], least[inside].view(np.int64), windows(own, width)[inside].view(np.int64)


def _runs(text: np.ndarray, place: np.ndarray, prefix: np.ndarray, most: int = 2**62) -> np.ndarray:
    """Where runs of windows with one prefix begin; no run is longer than ``most``."""
    if not len(text):
        return np.zeros(0, np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (prefix[1:] != prefix[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    since = np.arange(len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
    return np.flatnonzero(since % most == 0)


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)).astype(np.int32)), pa.array(values))


def _scan(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        counts, text, place, prefix, _ = _labels(_bytes(batch.column(1)), width)
        begin = _runs(text, place, prefix)
        digests = [hashlib.sha256(b" ".join((t.as_py() or "").encode().split())).hexdigest() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(counts.astype(np.int64)), pa.array(digests),
             _lists(prefix[begin], np.searchsorted(text[begin], np.arange(len(batch))))],
            ["id", "key", "n_words", "digest", "prefixes"])


def _suffixes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Runs of suffixes with shared prefixes and their words; ``shared`` lists each text's prefixes and their parts."""
    most = 31
    for batch in blocks(batches):
        found = data, starts, ends, first_word = _bytes(batch.column(1))
        _, text, place, prefix, label = _labels(found, width)
        shared, first = batch.column(3).flatten(), batch.column(3).offsets.to_numpy() - batch.column(3).offsets[0].as_py()
        names, parts = (field.to_numpy(zero_copy_only=False) for field in shared.flatten())
        bounds = np.searchsorted(text, np.arange(len(batch) + 1))
        take, part = np.zeros(len(text), bool), np.zeros(len(text), np.int64)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(len(batch)):
            mine = slice(bounds[k], bounds[k + 1])
            order = np.argsort(names[first[k]:first[k + 1]])
            known, split = names[first[k]:first[k + 1]][order], parts[first[k]:first[k + 1]][order]
            near = np.minimum(np.searchsorted(known, prefix[mine]), len(known) - 1)
            take[mine] = known[near] == prefix[mine]
            part[mine] = (int(ids[k]) * 2654435761 >> 7 & 0x7FFFFFFF) % split[near]
            part[mine] |= np.where(split[near] > 1, 1 << 40, 0)
        text, place, prefix, label, part = (x[take] for x in (text, place, prefix, label, part))
        begin_word = first_word[text] + place
        held = data.tobytes()

        def words(window: int) -> list[bytes]:
            return held[starts[begin_word[window]]:ends[begin_word[window] + width - 1]].split()

        # a text that goes round in circles has the same windows again and again: the first of each is enough
        order = np.lexsort((place, label, text))
        again = np.zeros(len(text), bool)
        alike = (text[order[1:]] == text[order[:-1]]) & (label[order[1:]] == label[order[:-1]])
        again[[n for n, m in zip(order[1:][alike].tolist(), order[:-1][alike].tolist()) if words(n) == words(m)]] = True
        text, place, prefix, part, begin_word = (x[~again] for x in (text, place, prefix, part, begin_word))
        begin = _runs(text, place, prefix, most)
        last = np.append(begin[1:], len(text)) - 1
        cells = [held[s:e] for s, e in zip(starts[begin_word[begin]].tolist(), ends[begin_word[last] + width - 1].tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(prefix[begin]), pa.array(part[begin]), pa.array(ids[text[begin]]),
             batch.column(2).take(pa.array(text[begin])), pa.array(place[begin]), pa.array(cells, pa.binary())],
            ["prefix", "part", "id", "key", "place", "words"])


def suffix_tree(words: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the common prefix of each with the one before it.

    ``words`` are numbers; ``left`` tells how many words each suffix has up to the end of its run.
    """
    ranks, size, at = [np.unique(words, return_inverse=True)[1]], 1, np.arange(len(words))
    longest = left.max(initial=0)
    while size < longest:
        now = ranks[-1]
        behind = np.where(left > size, now[np.minimum(at + size, len(at) - 1)] + 1, 0)
        ranks.append(np.unique(now * (len(at) + 1) + behind, return_inverse=True)[1])
        size *= 2
    order = np.argsort(ranks[-1], kind="stable")
    one, two = order[:-1], order[1:]
    end = np.minimum(left[one], left[two])
    depth = np.zeros(len(one), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        inside = depth < end
        a, b = (np.minimum(x + depth, len(at) - 1) for x in (one, two))
        depth += np.where(inside & (ranks[level][a] == ranks[level][b]), 1 << level, 0)
    return order, np.append(0, np.minimum(depth, end)) if len(order) else depth


def _nodes(batch: pa.Table, width: int) -> pa.RecordBatch:
    """Trees of whole groups: which starts lie below a deep node with a smaller id, and which stay undecided."""
    prefix, part, ids, key, place = (batch.column(k).to_numpy() for k in range(5))
    known: dict[bytes, int] = {}
    runs = [cell.as_py().split() for cell in batch.column(5)]
    sizes = np.array([len(run) for run in runs], np.int64)
    words = np.fromiter((known.setdefault(w, len(known)) for run in runs for w in run), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(prefix)), sizes)
    bit = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[row] - bit
    new = np.ones(len(prefix), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])
    order, depth = suffix_tree(words + np.cumsum(new)[row] * len(known), left)
    begin = np.flatnonzero(depth < width)  # each deep node's first suffix, or a suffix below none
    least = np.minimum.reduceat(ids[row][order], begin) if len(order) else ids[:0]
    start = left >= width
    below = np.zeros(len(words), bool)
    below[order] = ids[row][order] > np.repeat(least, np.diff(np.append(begin, len(order))))
    below &= start
    marks = np.bincount(row[below], weights=2.0**bit[below], minlength=len(prefix)).astype(np.int64)
    repeats = np.flatnonzero(marks)
    open_ = np.flatnonzero(~below & start & (part[row] >= 1 << 40))
    both = np.concatenate([repeats, row[open_]])
    passages = [b" ".join(runs[r][k:k + width]).decode() for r, k in zip(row[open_].tolist(), bit[open_].tolist())]
    none = [None] * len(repeats)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[both]), pa.array(key[both]),
         pa.array(np.concatenate([place[repeats], place[row[open_]] + bit[open_]])),
         pa.array(np.concatenate([marks[repeats], np.ones(len(open_), np.int64)])),
         pa.array(none + passages, pa.string())],
        ["id", "key", "place", "marks", "passage"])


def _subtrees(batches: Iterator[pa.RecordBatch], width: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group in; whole groups are worked on together, one open group is held."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        prefix, part = table.column(0).to_numpy(), table.column(1).to_numpy()
        cut = int(np.argmax((prefix == prefix[-1]) & (part == part[-1])))
        if cut:
            yield _nodes(table.slice(0, cut).combine_chunks(), width)
            table = table.slice(cut)
        held, count = table.to_batches(), len(table)
    if held:
        yield _nodes(pa.Table.from_batches(held).combine_chunks(), width)


def _kept(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Texts without the words of marked windows, and of windows of the same words elsewhere in the text."""
    for batch in blocks(batches):
        _, text, _, _, label = _labels(_bytes(batch.column(1)), width)
        bounds = np.searchsorted(text, np.arange(len(batch) + 1))
        removed, texts = [], []
        for k, (text, found) in enumerate(zip(batch.column(1), batch.column(3))):
            words = (text.as_py() or "").encode().split()
            own = label[bounds[k]:bounds[k + 1]]
            marks = np.array([(m["place"], m["marks"]) for m in found.as_py()], np.int64)
            marked = np.concatenate([marks[marks[:, 1] >> bit & 1 == 1, 0] + bit for bit in range(int(marks[:, 1].max()).bit_length())])
            begin = np.zeros(len(own), bool)
            begin[marked] = True
            same: dict[int, list[int]] = {}
            for place in np.flatnonzero(begin).tolist():
                same.setdefault(own[place], []).append(place)
            for place in np.flatnonzero(np.isin(own, own[marked]) & ~begin).tolist():
                begin[place] = any(words[place:place + width] == words[m:m + width] for m in same[own[place]])
            begin = np.flatnonzero(begin)
            cover = np.zeros(len(words) + 1, np.int64)
            cover[begin] += 1
            cover[begin + width] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            removed.append(int(gone.sum()))
            texts.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
            ["id", "digest", "n_removed", "kept_text"])


def without_repeats(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing was removed) per row.

    The kept text is the kept words joined by one space; ``kept_sha256`` is its digest.
    """
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("id"),
                       F.col(text_column).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("key"))
    scanned = stored(rows.mapInArrow(
        lambda b: _scan(b, width), "id long, key long, n_words long, digest string, prefixes array<long>"), "prefixes")
    # copies are combined before they are shuffled; written, the join can split a text with many copies
    strings = stored(
        scanned.groupBy("digest").agg(F.min(F.struct("id", "key", "prefixes")).alias("one"))
        .select("digest", F.col("one.id").alias("least"), "one.key", "one.prefixes"), "strings")
    named = scanned.drop("prefixes").join(strings.select("digest", "least"), "digest")

    starts = strings.where(F.size("prefixes") > 0).select(
        F.col("least").alias("id"), "key", "digest", F.explode(F.array_distinct("prefixes")).alias("prefix"))
    shared = starts.groupBy("prefix").agg(F.min("id").alias("low"), F.max("id").alias("high"),
                                          F.count(F.lit(1)).alias("n")).where("low < high")
    parts = F.ceil(F.col("n") / GROUP).cast("long").alias("parts")
    per_text = starts.join(shared, "prefix").groupBy("id", "key", "digest").agg(
        F.collect_list(F.struct("prefix", parts)).alias("shared"))
    texts = stored(rows.join(per_text, ["id", "key"]).dropDuplicates(["id", "key"])
                   .select("id", "text", "key", "shared", "digest"), "sharing-texts")

    found = stored(
        texts.mapInArrow(lambda b: _suffixes(b, width),
                    "prefix long, part long, id long, key long, place long, words binary")
        .repartition("prefix", "part").sortWithinPartitions("prefix", "part")
        .mapInArrow(lambda b: _subtrees(b, width), "id long, key long, place long, marks long, passage string"), "nodes")
    below = found.where("passage IS NOT NULL").withColumn(
        "least", F.min("id").over(Window.partitionBy("passage"))).where("id > least")
    marks = found.where("passage IS NULL").unionByName(below.drop("least")).groupBy("id", "key").agg(
        F.collect_list(F.struct("place", "marks")).alias("found"))
    cut = texts.select("id", "text", "key", "digest").join(marks, ["id", "key"]).select(
        "id", "text", "digest", "found").mapInArrow(
        lambda b: _kept(b, width), "id long, digest string, n_removed long, kept_text string")

    whole = (F.col("id") > F.col("least")) & (F.col("n_words") >= width)
    changed = F.col("n_removed").isNotNull()
    return named.join(cut, ["id", "digest"], "left").select(
        F.when(F.col("id") < _LAST, F.col("id")).alias("doc_id"), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).when(changed, F.sha2("kept_text", 256)).otherwise(F.col("digest"))
        .alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
