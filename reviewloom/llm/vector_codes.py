"""Vectors as short codes: each part of a vector is the index of its nearest codebook entry.

Components become whole numbers, floor(scale * x); a vector is cut into equal consecutive
parts. A part's codebook starts as that part of the first rows by id. Each round gives
every part to its nearest entry and moves entries to the floored mean of their
parts; the last assignment gives codes and errors. Nearest entries are found by a tree
over each codebook (``gnat``), exactly, with ties to the lower index.

A round is one scan: tasks build the trees, assign their own rows and send one row of
counts and sums per entry, which Spark adds; only codebooks, whose size does not depend
on the table, pass the driver. Errors per label are added before rows meet them: the
``HOT`` most frequent labels are broadcast, by digests of fixed length, and the others,
none of which can hold more than one row in ``HOT``, are joined.

Defined cases: vectors that are null or hold a null or non-finite component are left out.
The first row by id (null ids last, equal ids by vector) whose length divides into parts
tells the length; vectors of another length, and those with components so large that
squared distances would pass 64 bits, are returned with null code and error, and move no
entry. Rows that repeat an id or a vector count each. With fewer rows than entries the
codebook is as long as there are rows. Labels are equal if their texts are, and nulls
together. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.llm.gnat import Tree
from reviewloom.session import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Rows that are searched together, and labels whose sums are broadcast.
BLOCK, HOT = 4_096, 256


def _most(width: int) -> int:
    """The largest component for which squared distances of parts, added over all parts, stay below 2**62."""
    return math.isqrt((1 << 60) // (PARTS * width))


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _codable(size: int) -> Column:
    most = _most(size // PARTS)
    return (F.size("vector") == size) & F.forall("vector", lambda x: F.abs(x.cast("double") * SCALE) < most)


def whole(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of ``size`` whole components."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(vectors), size)


def _exact(numbers: np.ndarray, books: np.ndarray) -> bool:
    """Whether squared distances are exact in doubles."""
    most = max(np.abs(numbers).max(initial=0), np.abs(books).max(initial=0))
    return 4 * int(most)**2 * books.shape[2] < 1 << 51


class Coder:
    """Nearest entries of parts, for codebooks of shape (parts, entries, width)."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.trees: dict[type, list[Tree]] = {}

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's parts."""
        parts, _, width = self.books.shape
        kind = np.float64 if _exact(rows, self.books) else np.int64
        trees = self.trees.setdefault(kind, [Tree(book.astype(kind)) for book in self.books] if kind not in self.trees else [])
        index, error = (np.empty((len(rows), parts), np.int64) for _ in range(2))
        for at in range(0, len(rows), BLOCK):
            for part, tree in enumerate(trees):
                here = rows[at:at + BLOCK, part * width:(part + 1) * width].astype(kind)
                index[at:at + BLOCK, part], error[at:at + BLOCK, part] = tree.nearest(here)
        return index, error


def _sums(books: np.ndarray, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, (parts, entries, width) = Coder(books), books.shape
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            rows = whole(batch.column(0), size)
            place = (coder(rows)[0] + entries * np.arange(parts)).ravel()
            order = np.argsort(place, kind="stable")
            used, first = np.unique(place[order], return_index=True)
            if len(used):
                sums[used] += np.add.reduceat(rows.reshape(-1, width)[order], first, axis=0)
                counts += np.bincount(place, minlength=parts * entries)
        used = np.flatnonzero(counts)
        yield pa.record_batch({"place": pa.array(used), "n": pa.array(counts[used]),
                               "sums": pa.array(list(sums[used]), pa.list_(pa.int64()))})
    return add


def _moved(vectors: DataFrame, books: np.ndarray, size: int) -> np.ndarray:
    """The codebooks after one round."""
    width = books.shape[2]
    found = (vectors.select("vector").mapInArrow(_sums(books, size), "place long, n long, sums array<long>")
             .groupBy("place").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(width))).alias("sums")))
    after = books.reshape(-1, width).copy()
    for row in found.collect():  # one row per entry at most
        after[row.place] = [total // row.n for total in row.sums]
    return after.reshape(books.shape)


def _coded(books: np.ndarray, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, parts = Coder(books), books.shape[0]
        for batch in batches:
            able = batch.column(2).to_numpy(zero_copy_only=False)
            index, error = coder(whole(batch.column(3).filter(batch.column(2)), size))
            codes, errors = np.full(len(able), None, object), np.full(len(able), None, object)
            codes[able] = [bytes(row).hex() for row in index.astype(np.uint8)] if parts else ""
            errors[able] = error.sum(axis=1)
            yield pa.record_batch({"vec_id": batch.column(0), "label": batch.column(1),
                                   "code": pa.array(codes, pa.string()), "error": pa.array(errors, pa.int64())})
    return code


def _with_label_error(coded: DataFrame) -> DataFrame:
    coded = coded.withColumn("label_key", F.sha2(F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")), 256))
    sums = stored(coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    hot = sums.orderBy(F.desc("n"), "label_key").limit(HOT).select("label_key", F.col("label_error").alias("hot_error"), F.lit(True).alias("hot"))
    met = coded.join(F.broadcast(hot), "label_key", "left")
    cold = (met.where("hot IS NULL").drop("hot_error", "hot")
            .join(sums.join(F.broadcast(hot), "label_key", "left_anti").select("label_key", "label_error"), "label_key"))
    return met.where("hot").withColumnRenamed("hot_error", "label_error").drop("hot").unionByName(cold).drop("label_key")


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
             label_column: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, code, error, label_error of every usable row; and the codebooks."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"),
                          F.col(vector_column).alias("vector")).where(_usable(F.col("vector")))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = rows.where((F.size("vector") > 0) & (F.size("vector") % PARTS == 0)).orderBy(*order).select(F.size("vector")).first()
    size = first[0] if first else PARTS
    able = rows.where(_codable(size))
    start = able.orderBy(*order).limit(ENTRIES).select("vector").toArrow()["vector"].combine_chunks()
    books = whole(start, size).reshape(len(start), PARTS, size // PARTS).transpose(1, 0, 2)
    if not len(start):
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long")))), books
    for _ in range(ROUNDS):
        books = _moved(able, books, size)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    coded = stored(rows.select("vec_id", "label", F.coalesce(_codable(size), F.lit(False)).alias("able"), "vector").mapInArrow(
        _coded(books, size), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    return _with_label_error(coded).select("vec_id", "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimals, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """The codes with the digest of the codebooks that give them."""
    coded, books = compress(vectors)
    return coded.withColumn("codebooks_sha256", F.lit(digest(books)))


def decode(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The whole components that codes stand for."""
    index = np.array([list(bytes.fromhex(code)) for code in codes], np.int64).reshape(len(codes), books.shape[0])
    return books[np.arange(books.shape[0]), index].reshape(len(codes), -1)
