"""Near duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has the majority of each bit over the XXH64 hashes of a text's word
shingles. Masks from a linear code find the close pairs: every bit position gets a
non-zero vector of radius + 1 bits, and the mask of vector v keeps the positions
whose vector has an odd product with v. Whatever ``radius`` positions differ, some
v is orthogonal to all their vectors, so its mask hides every difference and the
pair meets in that table: 2**(radius + 1) - 1 tables miss no pair.

Only distinct fingerprints are searched, so copies of a text count once. A bucket
holds fingerprints that agree under its mask; one with more than ``BUCKET`` of them
is divided by the same construction on the bits its mask leaves free, which again
misses no pair and leaves so few free bits that its parts are small. Within a
bucket only links that connect are written, as stars, never all pairs.

Defined cases: null and empty texts, and texts of white space, have no words and
fingerprint zero, and link like any other; a text of fewer words than a shingle is
one shingle; a null id takes no part in choosing a component's smallest id but its
row is returned; repeated rows are returned each. An empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.llm.components import components
from reviewloom.llm.words import pieces
from reviewloom.session import stored

SEED = 42
#: Fingerprints of a bucket that are compared directly.
BUCKET = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8) * 256


def fingerprint(text: str | None, width: int) -> int:
    """Majority bits over all shingles of ``width`` words, repeats included; A-Z count as a-z."""
    counts, total, carry = np.zeros((8, 256), np.int64), 0, []
    for piece in pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + piece.split()
        grams = map(b" ".join, zip(*(words[k:] for k in range(width))))
        found = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        counts += np.bincount((found.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
        total += len(found)
        carry = words[len(words) - width + 1:] if len(words) >= width else words
    if not total:
        if not carry:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    bits = (2 * (counts @ _BITS) > total).ravel()
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the 64-bit fingerprint as a signed number, and a hash of the whole text."""
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)],
                                             ["doc_id", "bits", "text_hash"])

    text = F.col(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(of_batches, "doc_id long, bits long, text_hash long")


def masks(radius: int, free: int = 2**64 - 1) -> list[int]:
    """Masks over the ``free`` bit positions such that any ``radius`` of them are hidden by some mask."""
    places = [i for i in range(64) if free >> i & 1]
    count = 2 ** (radius + 1) - 1
    vectors = {place: 1 + k % count for k, place in enumerate(places)}
    return [sum(1 << p for p in places if (vectors[p] & v).bit_count() % 2) for v in range(1, count + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _stars(found: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the first of its component among ``found``."""
    rest, ends, roots = found, [], []
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(front), 256):
                near |= (np.bitwise_count(front[at:at + 256, None] ^ rest[None, :]) <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            ends.append(front)
            roots.append(np.full(len(front), root))
    if not ends:
        return found[:0], found[:0]
    return np.concatenate(ends), np.concatenate(roots)


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (table, part) in, star links of each bucket out; holds one open bucket."""
    kept = [np.zeros(0, np.int64)] * 3

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        table, part, bits = columns
        new = np.ones(len(table), bool)
        new[1:] = (table[1:] != table[:-1]) | (part[1:] != part[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(table)))
        two = begin[size == 2]
        a, b = bits[two].view(np.uint64), bits[two + 1].view(np.uint64)
        near = np.bitwise_count(a ^ b) <= radius
        ends, roots = [a[near]], [b[near]]
        for at, n in zip(begin[size > 2], size[size > 2]):
            end, root = _stars(bits[at:at + n].view(np.uint64), radius)
            ends.append(end)
            roots.append(root)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (ends, roots)],
                                          ["u", "v"])

    for batch in batches:
        if not len(batch):
            continue
        columns = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns)]
        last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
        cut = int(np.argmax(last))
        kept = [c[cut:] for c in columns]
        if cut:
            yield links([c[:cut] for c in columns])
    if len(kept[0]):
        yield links(kept)


def _mask(table: int, mask: int) -> Column:
    return F.struct(F.lit(table).cast("long").alias("table"), F.lit(_signed(mask)).cast("long").alias("mask"))


def _tables(found: DataFrame, choices: Column) -> DataFrame:
    """Each fingerprint once per chosen mask, as (table, part, bits)."""
    return (found.select("bits", F.explode(choices).alias("c"))
            .select("c.table", F.col("bits").bitwiseAND(F.col("c.mask")).alias("part"), "bits"))


def links(found: DataFrame, radius: int) -> DataFrame:
    """Links u, v that connect all of the distinct fingerprints ``found`` within ``radius`` bits of each other."""
    first = masks(radius)
    outer = [_mask(n, m) for n, m in enumerate(first)]
    inner = [F.array(*(_mask(len(first) * (n + 1) + k, m | more) for k, more in enumerate(masks(radius, (2**64 - 1) ^ m))))
             for n, m in enumerate(first)]
    rows = _tables(found, F.array(*outer))
    counts = rows.groupBy("table", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = F.col("table").cast("int")
    shared = rows.join(counts, ["table", "part"])
    narrow = _tables(shared, F.when(F.col("n") <= BUCKET, F.array(F.array(*outer)[at])).otherwise(F.array(*inner)[at]))
    ordered = narrow.repartition("table", "part").sortWithinPartitions("table", "part", "bits")
    return ordered.mapInArrow(lambda batches: _linked(batches, radius), "u long, v long").distinct()


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """bits, root, component_id of every fingerprint: its component and the smallest id there."""
    found = rows.groupBy("bits").agg(F.min("doc_id").alias("least"))
    roots = components(links(found.select("bits"), radius))
    classes = found.join(roots, F.col("bits") == F.col("node"), "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return classes.join(smallest, "root").select("bits", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id that links lead to)."""
    rows = stored(fingerprints(docs, width, id_column, text_column), "fingerprints")
    return rows.join(_classes(rows, radius), "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_column: str = "doc_id",
                            text_column: str = "text") -> DataFrame:
    """One document of each group, that with the smallest id, with its own columns.

    A row is told by its id and text: an id that stands on two texts is two documents, and of two texts
    of one group with the same smallest id one stays. Rows without an id are kept. Of rows that
    repeat the id and text that stay, one is kept.
    """
    rows = stored(fingerprints(docs, width, id_column, text_column), "fingerprints")
    chosen = (rows.where("doc_id IS NOT NULL").groupBy("bits", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
              .join(_classes(rows, radius), "bits").groupBy("root")
              .agg(F.min(F.struct("doc_id", "text_hash", "copies")).alias("stays")).select("stays.*"))
    stays = stored(chosen, "stays")
    named = docs.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("doc_id"),
                        F.xxhash64(F.col(text_column)).alias("text_hash"))
    keys = ["doc_id", "text_hash"]
    once = named.join(stays.where("copies = 1").select(*keys), keys, "left_semi").select("row")
    repeated = (named.join(stays.where("copies > 1").select(*keys), keys, "left_semi")
                .groupBy(*keys).agg(F.any_value("row").alias("row")).select("row"))
    return once.unionAll(repeated).unionAll(named.where("doc_id IS NULL").select("row")).select("row.*")
