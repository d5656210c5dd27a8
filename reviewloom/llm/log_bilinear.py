"""Scores of texts under a log-bilinear language model trained with noise-contrastive estimation.

A word's representation is predicted as the sum of the context words'
representations, each scaled per dimension by its position's weights; the product
with a target's representation plus its bias is the target's score. Targets are all
words that come at least ``LEAST_COUNT`` times in the training rows (at most the
``OUTPUTS`` most frequent ones, which bounds what a task holds), the text's end, and
one target for all rarer words, inside which a word has its smoothed share of the
counts. Probabilities are normalised exactly in two levels, classes of words of
like frequency and then the words of the class, so a text's tokens have proper
probabilities. Both levels have outputs of their own and are trained by noise-contrastive
steps, which touch the target and the noise only and so do not grow with the vocabulary.

Passes, all over the whole table:

1. Words of the training rows are counted, combined per task before the shuffle.
2. Parameters start from a bounded draw of about ``FIRST_ROWS`` training rows. Then
   every task trains a copy on every place of its own training rows,
   and each word's vectors are averaged over the copies by how often they were
   learnt; tasks hand on only those, in ranges of words.
3. Every row is scored in blocks by matrix products. The counts of the ``KNOWN`` most
   frequent words travel with the tasks, which bounds them; those of all others are
   joined by word, and their shares are added to both scores.

Words are compared by a 64-bit hash. Base score: log10 of add-0.1 smoothed counts.

Defined cases: a null or empty text is its end alone; a null id is hashed as empty
text, which holds the row out; repeated rows are counted and scored each; without
training rows every count is zero and all targets share the class of other words;
texts of any length are scored in blocks. An empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reviewloom.llm.words import blocks, hashes, spans, text_bytes
from reviewloom.session import stored

#: Words with an output of their own at most, words whose counts every task holds, context words, dimensions.
OUTPUTS, KNOWN, CONTEXT, DIMENSIONS = 1 << 18, 1 << 18, 4, 16
#: A word with an output of its own comes so often at least.
LEAST_COUNT = 5
#: Training rows that the first parameters come from; after that each task trains on all its places.
FIRST_ROWS = 2000
#: Noise words per batch, places per batch, learning rate.
NOISE, BATCH, RATE = 64, 1024, 0.1
#: Distinct words that a task gathers before it hands its counts on.
GATHERED = 1 << 20
ADDED = 0.1
#: Rows of a table of parameters that are averaged together; scores computed at a time.
RANGE, AT_A_TIME = 1024, 1 << 17

Parameters = dict[str, np.ndarray]


@dataclass
class Vocabulary:
    """Counts of the most frequent words (sorted by hash) and totals of the training tokens."""

    names: np.ndarray  # hashes, ascending
    counts: np.ndarray
    targets: np.ndarray  # the target each is: its own, or that of other words
    tokens: int
    distinct: int
    ends: int
    own: np.ndarray  # counts per target

    @property
    def other(self) -> int:
        return len(self.own) - 2

    @property
    def end(self) -> int:
        return len(self.own) - 1

    @property
    def classes(self) -> np.ndarray:
        """The class of each target: k holds the words of rank k*k up to (k+1)*(k+1); others and the end are alone."""
        words = np.sqrt(np.arange(self.other)).astype(np.int64)  # exact, as ranks are far below 2**52
        return np.append(words, np.arange(2) + (words[-1] + 1 if len(words) else 0))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Target and count of each word, and whether it is among the known ones."""
        if not len(self.names):
            return np.full(len(words), self.other), np.zeros(len(words)), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.names, words), len(self.names) - 1)
        known = self.names[at] == words
        return np.where(known, self.targets[at], self.other), np.where(known, self.counts[at], 0), known


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 10 == 0
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), held.alias("held_out"))


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(batch.column(1))
    starts, ends, first = spans(data, offsets)
    return hashes(data, starts, ends, lower=True).view(np.int64), first


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names = np.concatenate([n for n, _ in parts])
    order = np.argsort(names, kind="stable")
    names, counts = names[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    return names[first], np.add.reduceat(counts, first)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in blocks(batches):
        found, _ = _words(batch)
        if len(found):
            parts.append(np.unique(found, return_counts=True))
        if sum(len(n) for n, _ in parts) > GATHERED:
            parts = [_merged(parts)]
            if len(parts[0][0]) > GATHERED // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts.pop()], ["word", "n"])
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(parts)], ["word", "n"])


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``KNOWN`` of the most frequent words, the most frequent first.

    Words are counted by the logarithm of their count, a few thousand levels at
    most, and whole levels are taken from the top; no task sorts the words.
    """
    levels = counts.groupBy(F.floor(F.log2("n") * 64).alias("level")).agg(
        F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    least, taken = None, 0
    for level in sorted(levels, key=lambda r: -r["level"]):
        taken += level["words"]
        if taken > KNOWN:
            break
        least = level["least"]
    found = counts.where(F.col("n") >= (2**62 if least is None else least)).toArrow()
    names, own = (found.column(k).to_numpy() for k in (0, 1))
    order = np.lexsort((names, -own))
    return names[order], own[order]


def count_words(rows: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """word and n of all training words, and what every task needs of it."""
    learnt = rows.where("NOT held_out")
    counts = stored(learnt.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")),
                    "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    ends = learnt.count()
    names, own = _frequent(counts)
    outputs = min(OUTPUTS, int((own >= LEAST_COUNT).sum()))
    targets = np.minimum(np.arange(len(names)), outputs)
    order = np.argsort(names)
    per_target = np.append(own[:outputs], [total["tokens"] - own[:outputs].sum(), ends]).astype(np.float64)
    return counts, Vocabulary(names[order], own[order].astype(np.float64), targets[order],
                              total["tokens"] + ends, total["distinct"] + (ends > 0), ends, per_target)


def _sequence(batch: pa.RecordBatch, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """Targets of a batch with each text's end, place in the text, and the words as found."""
    found, first = _words(batch)
    target, count, known = vocabulary.find(found)
    targets = np.insert(target, first[1:], vocabulary.end)
    sizes = np.diff(first) + 1
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(targets)) - np.repeat(begin, sizes)
    return targets, place, begin, found, first, count, known


def _contexts(targets: np.ndarray, place: np.ndarray, at: np.ndarray, start: int) -> np.ndarray:
    """The targets before each of the places ``at``, nearest first; ``start`` before a text."""
    back = np.arange(1, CONTEXT + 1)[:, None]
    return np.where(place[at] >= back, targets[np.maximum(at - back, 0)], start)


def _fresh(vocabulary: Vocabulary) -> Parameters:
    """Every target begins with its share of the counts, whatever the context."""
    rng, size = np.random.default_rng(11), len(vocabulary.own)

    def log_share(counts: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(counts, 0.5) / max(counts.sum(), 1)).astype(np.float32)

    per_class = np.bincount(vocabulary.classes, weights=vocabulary.own)
    return {
        "context": rng.normal(0, 0.1, (size + 1, DIMENSIONS)).astype(np.float32),
        "places": np.repeat(1 / np.arange(1, CONTEXT + 1, dtype=np.float32)[:, None], DIMENSIONS, axis=1),
        "target": np.zeros((size, DIMENSIONS), np.float32),
        "bias": log_share(vocabulary.own),
        "class": np.zeros((len(per_class), DIMENSIONS), np.float32),
        "class_bias": log_share(per_class),
    }


class Trainer:
    """Noise-contrastive steps with per-parameter rates; only what a step touches is moved."""

    def __init__(self, parameters: Parameters, vocabulary: Vocabulary, seed: int):
        self.p = {k: v.copy() for k, v in parameters.items()}
        self.seen = {k: np.full(v.shape, 1.0, np.float32) for k, v in self.p.items()}
        self.learnt = {k: np.zeros(len(v)) for k, v in self.p.items()}  # how often each row
        self.classes = vocabulary.classes
        self.noise = {}
        for name, counts in (("target", vocabulary.own), ("class", np.bincount(self.classes, weights=vocabulary.own))):
            share = np.maximum(counts, 0.5) / np.maximum(counts, 0.5).sum()
            self.noise[name] = np.cumsum(share)[:-1], np.log(share * NOISE).astype(np.float32)
        self.rng, self.places = np.random.default_rng(seed), 0

    def _step(self, name: str, gradient: np.ndarray, rows: np.ndarray, times: np.ndarray | int) -> None:
        self.learnt[name][rows] += times
        seen = self.seen[name].take(rows, axis=0)
        seen += gradient * gradient
        self.seen[name][rows] = seen
        np.sqrt(seen, out=seen)
        self.p[name][rows] -= np.divide(RATE * gradient, seen, out=seen)

    @staticmethod
    def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row once, the sum of its values, and how often it came."""
        order = np.argsort(rows)
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        times = np.diff(np.append(first, len(rows)))
        return rows[first], np.add.reduceat(values.take(order, axis=0), first, axis=0), times

    def _level(self, name: str, bias: str, predicted: np.ndarray, target: np.ndarray) -> np.ndarray:
        """One step for the outputs ``name``; returns the gradient of ``predicted``."""
        p, (ends, log_noise) = self.p, self.noise[name]
        noise = np.searchsorted(ends, self.rng.random(NOISE), side="right")
        own, others = p[name].take(target, axis=0), p[name][noise]
        true = np.einsum("nd,nd->n", predicted, own) + p[bias][target] - log_noise[target]
        false = predicted @ others.T
        false += p[bias][noise] - log_noise[noise]
        # gradients of -log s(true) - sum log s(-false)
        g_true = -1 / (1 + np.exp(np.clip(true, -30, 30)))
        np.clip(false, -30, 30, out=false)
        np.exp(np.negative(false, out=false), out=false)
        false += 1
        g_false = np.reciprocal(false, out=false)
        back = g_true[:, None] * own + g_false @ others
        wide = np.concatenate([predicted, np.ones((len(predicted), 1), np.float32)], axis=1)  # the last one is the bias
        rows, total, times = self._summed(np.append(target, noise),
                                          np.concatenate([g_true[:, None] * wide, g_false.T @ wide]))
        self._step(name, total[:, :-1], rows, times)
        self._step(bias, total[:, -1], rows, times)
        return back

    def learn(self, target: np.ndarray, context: np.ndarray) -> None:
        """One batch; ``context`` has one row per position before the targets."""
        p, n = self.p, len(target)
        near = p["context"].take(context, axis=0)
        predicted = np.einsum("jnd,jd->nd", near, p["places"])
        back = self._level("target", "bias", predicted, target)
        back += self._level("class", "class_bias", predicted, self.classes[target])
        spread = back[None] * p["places"][:, None]
        self._step("places", np.einsum("jnd,nd->jd", near, back), np.arange(CONTEXT), n)
        rows, total, times = self._summed(context.ravel(), spread.reshape(-1, DIMENSIONS))
        self._step("context", total, rows, times)
        self.places += n

    def learn_from(self, batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, rounds: int = 1) -> None:
        for batch in blocks(batches, size=4 << 20):
            targets, place, *_ = _sequence(batch, vocabulary)
            for _ in range(rounds):
                at = self.rng.permutation(len(targets))
                for begin in range(0, len(at), BATCH):
                    here = at[begin:begin + BATCH]
                    self.learn(targets[here], _contexts(targets, place, here, len(vocabulary.own)))


def _trained(rows: DataFrame, start: Parameters, vocabulary: Vocabulary, rounds: int) -> Parameters:
    """Copies of ``start`` trained by each task of ``rows`` on its own rows, averaged by how often they learnt each row."""
    shared = rows.sparkSession.sparkContext.broadcast((start, vocabulary))  # bounded by OUTPUTS and KNOWN

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, words = shared.value
        trainer = Trainer(first, words, TaskContext.get().partitionId())
        trainer.learn_from(batches, words, rounds)
        for name in sorted(first):
            at = np.flatnonzero(trainer.learnt[name])
            for part in np.split(at, np.flatnonzero(np.diff(at // RANGE)) + 1):
                if len(part):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([int(part[0]) // RANGE]), pa.array([part.astype(np.int64).tobytes()]),
                         pa.array([trainer.learnt[name][part].tobytes()]), pa.array([trainer.p[name][part].tobytes()])],
                        ["name", "part", "at", "times", "value"])

    def mean(key: tuple[pa.Scalar, pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, base = key[0].as_py(), key[1].as_py() * RANGE
        total, times = 0.0, np.zeros(RANGE)
        for batch in batches:
            for at, n, value in zip(*(batch.column(k) for k in ("at", "times", "value"))):
                here = np.frombuffer(at.as_py(), np.int64) - base
                n = np.frombuffer(n.as_py())
                value = np.frombuffer(value.as_py(), np.float32).reshape(len(here), -1)
                if not isinstance(total, np.ndarray):
                    total = np.zeros((RANGE, value.shape[1]))
                total[here] += n[:, None] * value
                times[here] += n
        met = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([(met + base).tobytes()]),
             pa.array([(total[met] / times[met, None]).astype(np.float32).tobytes()])], ["name", "at", "value"])

    out = {k: v.copy() for k, v in start.items()}
    for r in (rows.mapInArrow(learn, "name string, part long, at binary, times binary, value binary")
              .groupBy("name", "part").applyInArrow(mean, "name string, at binary, value binary").collect()):
        at = np.frombuffer(r["at"], np.int64)
        out[r["name"]][at] = np.frombuffer(r["value"], np.float32).reshape(len(at), *start[r["name"]].shape[1:])
    return out


def train(rows: DataFrame, vocabulary: Vocabulary) -> Parameters:
    """Parameters from a bounded draw in one task, then from all training rows in all tasks."""
    learnt = rows.where("NOT held_out")
    part = int(min(1.0, FIRST_ROWS / max(1, vocabulary.ends)) * (1 << 20))
    drawn = learnt.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < part).repartition(1)
    first = _trained(drawn, _fresh(vocabulary), vocabulary, 2)
    return _trained(learnt, first, vocabulary, 1)


def _log_probabilities(targets: np.ndarray, place: np.ndarray, p: Parameters, v: Vocabulary) -> np.ndarray:
    """Natural logarithm of each target's probability after its context: its class, then itself in the class."""
    n, classes = len(targets), v.classes
    kinds = classes[targets]
    predicted, logs = np.ones((n, DIMENSIONS + 1), np.float32), np.empty(n)

    def wide(outputs: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
        """Outputs with their bias, and whether no score of them can leave the range of exp."""
        most = float(np.sqrt(np.square(outputs).sum(axis=1).max(initial=0))) * longest + float(np.abs(bias).max(initial=0))
        return np.concatenate([outputs, bias[:, None]], axis=1), most < 60

    def among(rows: np.ndarray, mine: np.ndarray, outputs: np.ndarray, near: bool) -> np.ndarray:
        scores = room[:len(rows) * len(outputs)].reshape(len(rows), len(outputs))
        np.matmul(predicted[rows], outputs.T, out=scores)
        if not near:
            scores -= scores.max(axis=1, keepdims=True)
        own = scores[np.arange(len(rows)), mine].astype(np.float64)
        return own - np.log((np.exp(scores, out=scores) @ ones[:len(outputs)]).astype(np.float64))

    def parts(rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
        step = max(1, AT_A_TIME // width)
        return (rows[at:at + step] for at in range(0, len(rows), step))

    begin = np.searchsorted(classes, np.arange(len(p["class"]) + 1))
    widest = max(len(p["class"]), int(np.diff(begin).max()))
    room, ones = np.empty(max(AT_A_TIME, widest), np.float32), np.ones(widest, np.float32)
    for here in parts(np.arange(n), len(p["class"])):
        near = _contexts(targets, place, here, len(v.own))
        predicted[here, :-1] = sum(p["context"].take(near[k], axis=0) * p["places"][k] for k in range(CONTEXT))
    longest = float(np.sqrt(np.square(predicted[:, :-1]).sum(axis=1).max(initial=0)))
    outputs, bounded = wide(p["class"], p["class_bias"])
    for here in parts(np.arange(n), len(p["class"])):
        logs[here] = among(here, kinds[here], outputs, bounded)
    order = np.argsort(kinds, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(kinds[order])) + 1):
        first, last = (begin[kinds[rows[0]] + k] for k in (0, 1)) if len(rows) else (0, 0)
        if last - first > 1:
            outputs, bounded = wide(p["target"][first:last], p["bias"][first:last])
            for here in parts(rows, last - first):
                logs[here] += among(here, targets[here] - first, outputs, bounded)
    return logs


def _scored(batches: Iterator[pa.RecordBatch], p: Parameters, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Both scores as far as the known words tell, and the other words' hashes."""
    v, row = vocabulary, TaskContext.get().partitionId() << 33
    all_base = math.log10(v.tokens + ADDED * (v.distinct + 1))
    own = len(v.own) - 2
    others = v.own[v.other] + ADDED * (v.distinct - own - (v.ends > 0) + 1)
    end_base = math.log10(v.ends + ADDED) - all_base
    for batch in blocks(batches, size=4 << 20):
        targets, place, begin, found, first, count, known = _sequence(batch, v)
        logs = _log_probabilities(targets, place, p, v) / math.log(10)
        share = np.log10(count + ADDED)
        rest = targets[np.delete(np.arange(len(targets)), first[1:] + np.arange(len(begin)))] == v.other \
            if len(found) else np.zeros(0, bool)

        def sums(values: np.ndarray) -> np.ndarray:
            total = np.append(0.0, np.cumsum(values))
            return total[first[1:]] - total[first[:-1]]

        base = sums(np.where(known, share, 0.0) - all_base) + end_base
        model = np.add.reduceat(logs, begin) + sums(np.where(rest, np.where(known, share, 0.0) - math.log10(others), 0.0))
        unknown = np.flatnonzero(~known)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row + np.arange(len(batch))), batch.column(0), batch.column(2),
             pa.array(np.diff(first) + 1), pa.array(sums(known.astype(float)).round().astype(np.int64) + (v.ends > 0)),
             pa.array(base), pa.array(model),
             pa.ListArray.from_arrays(pa.array(np.searchsorted(unknown, first).astype(np.int32)),
                                      pa.array(found[unknown]))],
            ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "others"])
        row += len(batch)


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) of every row."""
    rows = _rows(docs, id_column, text_column)
    counts, vocabulary = count_words(rows)
    model = train(rows, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((model, vocabulary))  # bounded by OUTPUTS and KNOWN
    kind = docs.schema[id_column].dataType.simpleString()
    read = stored(rows.mapInArrow(
        lambda batches: _scored(batches, *shared.value),
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, "
        "others array<long>"), "known-scores")
    others = (
        read.select("row", F.explode("others").alias("word")).join(counts, "word", "left").groupBy("row")
        .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADDED)).alias("share"), F.count("n").alias("counted"))
    )
    share = F.coalesce("share", F.lit(0.0))
    return read.drop("others").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("counted", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + share).alias("base_score"), (F.col("model") + share).alias("score"))
