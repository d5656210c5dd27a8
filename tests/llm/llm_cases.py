"""Small awkward tables, and plain versions of what the operators do."""

import hashlib
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; none of them may get in the way of a table's own columns.
CLASHING = ("row hash head content id key part ids size shard slot kept keep_id bits component_id tokens epoch digest "
            "budget leaf_tokens slice start label prefix word n evidence declared host keep vec_id vector least").split()

PASSAGE = " ".join(f"shared{k}" for k in range(70))
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    base = "The quick brown fox and the lazy dog went to the market with five apples in one small basket today"
    rows = [
        (1, base, "en", "src1"), (2, base + " ", "en", "src1"), (3, base.replace(" ", "\n"), "en", "src2"),
        (4, None, "en", "src1"), (5, "", "de", None), (6, " \t\n", None, "src1"), (7, "a", "fr", "src9"),
        (8, "a b", "fr", "src9"), (None, base, "en", "src1"), (None, None, None, None),
        (9, LONG, "en", "src0"), (10, LONG + " tail", "en", "src0"), (11, "0 1 2 3", "xx", "src0"),
        (12, "start " + PASSAGE + " end", "en", "src0"), (13, PASSAGE, "en", "src0"),
        (14, "x y z " + PASSAGE + " " + PASSAGE, "en", "src0"), (15, "rep " * 300, "es", "other"),
        (16, "rep " * 120, "es", "other"), (17, "Été à la plage avec l'été, naïve façade", "fr", "src3"),
        (17, "Été à la plage avec l'été, naïve façade", "fr", "src3"), (18, "漢字 かな   combining é 'S <|endoftext|>",
                                                                      "ja", "src4"),
        (0, "zero " * 10, "en", "src1"), (-3, "minus one two three", "en", "src1"),
    ]
    return [(d, t, la, s, None if t is None else len(t)) for d, t, la, s in rows]


def odd_docs(spark, rows=None):
    """The awkward documents, with extra columns of clashing names."""
    frame = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    return frame.withColumns({name: F.lit(7) for name in CLASHING})


def no_docs(spark):
    return odd_docs(spark, [])


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def digest(parts):
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def crc(text):
    return zlib.crc32((text or "").encode())


def copies(rows):
    """doc_id, keep_id, group_size and digest of every row, sorted; and how many rows stay."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0D]", "", text or ""), []).append((doc, text or ""))
    out = []
    for content, own in groups.items():
        best = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        out += [(d, best, len(own), hashlib.sha256(content.encode()).hexdigest()) for d, _ in own]
    return sorted(out, key=repr), len(groups)


def fingerprint(text, width=3):
    own = words((text or "").encode().lower().decode())
    grams = [b" ".join(own[k:k + width]) for k in range(len(own) - width + 1)] or ([b" ".join(own)] if own else [])
    if not grams:
        return 0
    found = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((found >> np.uint64(b) & np.uint64(1)).sum()) > len(found))


def classes(prints, radius):
    """The component of each fingerprint, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


def repeats(rows, width=50):
    """doc_id, words, removed words and digest of the rest, by a table of all windows."""
    first = {}
    for doc, text in rows:
        own = words(text)
        for k in range(len(own) - width + 1):
            key = tuple(own[k:k + width])
            first[key] = min(first.get(key, 2**63), 2**63 if doc is None else doc)
    out = []
    for doc, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for k in range(len(own) - width + 1):
            if first[tuple(own[k:k + width])] < (2**63 if doc is None else doc):
                gone[k:k + width] = [True] * width
        out.append((doc, len(own), sum(gone), digest([w for w, g in zip(own, gone) if not g])))
    return sorted(out, key=repr)
