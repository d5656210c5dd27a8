"""Hierarchical packing of documents into training sequences of several lengths.

Every document (its ids and an end id) first gives up whole windows of the longest
tier. What remains is routed to the smallest tier that holds it. A task packs its
pool block by block, longest tier first: a document opens a window of its tier, the
gap is filled with the longest documents of shorter tiers that fit, and the last
gap is closed by a cut. Windows are therefore exactly full, and a full window of a
power of two needs no padding. The sequences of a block are dealt, longest first,
to the lightest of its step groups, so steps cost the same.

What a task cannot fill (less than one longest window) is its tail. Tails are few
and short; the second level lays them end to end through offsets per task and cuts
them at window limits, and the very last window is divided into powers of two. No
text or id list is shuffled: a task reads its own split of the input, and only the
tails' ids are kept beside the pieces.

Defined cases: a null or empty text is its end id alone; rows that repeat an id are
documents of their own; a text of any length is encoded in pieces. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from reviewloom.llm.token_ids import encoded
from reviewloom.session import stored

#: Context sizes, all powers of two.
TIERS = (512, 1024, 2048, 4096)
#: Tokens of one training step, and of a block that a task packs together.
STEP_TOKENS, BLOCK_TOKENS = 1 << 16, 1 << 20
END_ID = 2

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "context int, step_id long")
_NAMES = [field.split()[0] for field in PIECES.split(", ")]
_TAIL = ", part long, ids binary"
_FAR = 1 << 62


class _Packer:
    """Packs one task's documents; rows are lists in the order of PIECES, then part and ids."""

    def __init__(self, tiers: tuple[int, ...], part: int):
        self.tiers, self.most, self.part = sorted(tiers), max(tiers), part
        self.pool: list[tuple[int, int]] = []  # (length, key), ascending
        self.held: dict[int, tuple[int, int, memoryview, int]] = {}  # key: doc_id, start, ids, doc_tokens
        self.tokens = self.block = self.keys = self.sequences = self.steps = 0
        self.open: list[tuple[int, list[list]]] = []  # (context, rows) of the block
        self.rows: list[list] = []

    def add(self, doc_id: int, chunks: list[int], ids: bytes, total: int) -> None:
        """A document: check sums of its whole windows, the ids after them, all its tokens."""
        for k, crc in enumerate(chunks):
            self.open.append((self.most, [[doc_id, k * self.most, self.most, crc, total]]))
        if ids:
            self._put(doc_id, len(chunks) * self.most, memoryview(ids), total)
        self.block += total
        if self.block >= BLOCK_TOKENS:
            self.pack()

    def _put(self, doc_id: int, start: int, ids: memoryview, total: int) -> None:
        self.keys += 1
        self.held[self.keys] = doc_id, start, ids, total
        bisect.insort(self.pool, (len(ids) // 4, self.keys))
        self.tokens += len(ids) // 4

    def _take(self, place: int, length: int, into: list[list]) -> None:
        """Move the first ``length`` tokens of a document in the pool into a window."""
        full, key = self.pool.pop(place)
        doc_id, start, ids, total = self.held.pop(key)
        self.tokens -= full
        into.append([doc_id, start, length, zlib.crc32(ids[:4 * length]), total])
        if length < full:
            self._put(doc_id, start + length, ids[4 * length:], total)

    def pack(self) -> None:
        """Fill windows as long as the pool can, then deal the block's sequences to steps."""
        while self.pool:
            longest = self.pool[-1][0]
            tier = next(t for t in self.tiers if t >= longest)
            if self.tokens < tier:
                break
            rows: list[list] = []
            gap = tier - longest
            self._take(len(self.pool) - 1, longest, rows)
            while gap:
                place = bisect.bisect_right(self.pool, (gap, self.keys + 1)) - 1
                if place >= 0:
                    length = self.pool[place][0]
                else:
                    place, length = 0, gap
                gap -= length
                self._take(place, length, rows)
            self.open.append((tier, rows))
        self._deal()
        self.block = 0

    def _deal(self) -> None:
        total = sum(context for context, _ in self.open)
        loads = [(0, k) for k in range(max(1, round(total / STEP_TOKENS)))]
        for context, rows in sorted(self.open, key=lambda x: -x[0]):
            load, step = loads[0]
            heapq.heapreplace(loads, (load + context, step))
            offset = 0
            for row in rows:
                self.rows.append([*row, self.part << 33 | self.sequences, offset, context,
                                  self.part << 33 | self.steps + step, None, None])
                offset += row[2]
            self.sequences += 1
        if self.open:
            self.steps += len(loads)
        self.open.clear()

    def finish(self) -> None:
        self.pack()
        offset = 0
        for length, key in reversed(self.pool):
            doc_id, start, ids, total = self.held[key]
            self.rows.append([doc_id, start, length, None, total, None, offset, None, None, self.part, bytes(ids)])
            offset += length

    def batches(self, schema: pa.Schema, least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*self.rows), schema.types)], schema=schema)
            self.rows.clear()


_ARROW = pa.schema([(name, pa.int32() if name == "context" else pa.int64()) for name in _NAMES]
                   + [("part", pa.int64()), ("ids", pa.binary())])


def _packed(batches: Iterator[pa.RecordBatch], tokenizer: str, tiers: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    packer = _Packer(tiers, TaskContext.get().partitionId())
    window = 4 * packer.most
    end = np.array([END_ID], "<u4").tobytes()
    chunks: list[int] = []
    rest, total = b"", 0
    rows = ((d.as_py(), t.as_py()) for batch in batches for d, t in zip(batch.column(0), batch.column(1)))
    for doc_id, ids, last in encoded(rows, tokenizer):
        rest = rest + ids + end if last else rest + ids
        whole = len(rest) // window * window
        chunks += [zlib.crc32(memoryview(rest)[at:at + window]) for at in range(0, whole, window)]
        rest, total = rest[whole:], total + whole
        if last:
            packer.add(doc_id, chunks, rest, (total + len(rest)) // 4)
            chunks, rest, total = [], b"", 0
            yield from packer.batches(_ARROW, 20_000)
    packer.finish()
    yield from packer.batches(_ARROW, 1)


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Cut the tails at the windows of their common line of tokens."""
    schema = pa.schema([(f.name, f.type) for f in _ARROW][:len(_NAMES)])
    for batch in batches:
        out: list[list] = []
        for row in batch.to_pylist():
            at, data = row["place"], memoryview(row["ids"])
            base = row["total"] // most * most
            done = 0
            while done < row["length"]:
                here = at + done
                begin, context, number = here // most * most, most, here // most
                if begin == base:  # the last window is made of powers of two
                    begin, left = base, row["total"] - base
                    while True:
                        context = 1 << left.bit_length() - 1
                        if here < begin + context:
                            break
                        begin, left, number = begin + context, left - context, number + 1
                size = min(row["length"] - done, begin + context - here)
                out.append([row["doc_id"], row["start"] + done, size,
                            zlib.crc32(data[4 * done:4 * (done + size)]), row["doc_tokens"], _FAR | number,
                            here - begin, context, _FAR | begin // STEP_TOKENS])
                done += size
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*out), schema.types)], schema=schema)


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context
    (tokens of the sequence) and step_id (sequences that train together).
    ``tokenizer`` is a tokenizer file that every worker can read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    written = stored(rows.mapInArrow(lambda batches: _packed(batches, tokenizer, tiers), PIECES + _TAIL), "pieces")
    tails = written.where("ids IS NOT NULL")
    # one row per task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tails.groupBy("part").agg(F.sum("length").alias("tokens")).select(
        "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"),
        F.sum("tokens").over(Window.partitionBy()).alias("total"))
    placed = tails.join(parts, "part").withColumn("place", F.col("before") + F.col("offset"))
    most = max(tiers)
    return written.where("ids IS NULL").select(*_NAMES).unionByName(
        placed.mapInArrow(lambda batches: _cut(batches, most), PIECES))
