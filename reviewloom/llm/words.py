"""Words and their 64-bit hashes for whole Arrow batches.

A word is a run of bytes that are not white space (\\x20, \\x09-\\x0D). Hashes are
polynomials over the bytes modulo 2**64, from prefix sums, then mixed; hashes of
word windows are built the same way over the words' hashes. Work goes in blocks,
so memory is bounded by the batch and not by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 19
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below at least ``length``."""
    if base not in _tables or len(_tables[base][0]) < length:
        def table(x: int) -> np.ndarray:
            out = np.empty(max(length, _BLOCK), np.uint64)
            out[0] = 1
            filled = 1
            while filled < len(out):
                step = min(filled, len(out) - filled)
                out[filled:filled + step] = out[:step] * np.uint64(pow(x, filled, 2**64))
                filled += step
            return out
        _tables[base] = table(base), table(pow(base, -1, 2**64))
    return _tables[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and the offset of each text in them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each text's words begin among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = True
    after[cuts - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    return starts, np.flatnonzero(word & after) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with ``lower``, of the word with A-Z in lower case."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        first, last = starts[at], ends[upto - 1]
        power, inverse = _powers(_BASE, int(last - first) + 1)
        part = data[first:last]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[_LOWER[part] if lower else part] * power[:len(part)], out=sums[1:])
        s, e = starts[at:upto] - first, ends[at:upto] - first
        out[at:upto] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(_WINDOW_BASE))
        at = upto
    return out


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words; windows may reach over text ends."""
    count = len(words) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(count, np.uint64)
    power, inverse = _powers(_WINDOW_BASE, _BLOCK + width)
    for at in range(0, count, _BLOCK):
        part = words[at:at + _BLOCK + width - 1]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * power[:len(part)], out=sums[1:])
        here = len(part) - width + 1
        out[at:at + here] = mixed((sums[width:] - sums[:here]) * inverse[:here])
    return out


def pieces(data: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes that end between words."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each part's texts have about ``size`` bytes, or one text more."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < len(batch):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto
