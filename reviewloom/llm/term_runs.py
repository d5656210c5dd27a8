"""Counts of terms in whole Arrow batches: packed into words, radix-sorted, run-counted.

A term is a run of ASCII letters and non-ASCII bytes, A-Z lower-cased. Terms are
bucketed by length. Up to eight bytes are one uint64, up to sixteen two; the first
byte is the highest, so numbers order like bytes, and as no term holds a zero byte the
padding is unambiguous. The words are sorted by 16-bit digits, lowest first, each pass
a stable radix sort. Longer terms lie in buckets of their own, one for every power of
two, and are sorted as fixed-width bytes. A sorted bucket is counted by its runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms in the bytes of some texts, and the text each lies in."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _TERM[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a term ends where its text ends
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    cuts = np.unique(cuts[_TERM[data[cuts]] & _TERM[data[cuts - 1]]]) if len(cuts) else cuts
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start as one number, first byte highest; ``data`` has eight spare bytes."""
    every = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    packed = np.ascontiguousarray(every[starts]).view(">u8").ravel().astype(np.uint64)
    shift = (8 * (8 - np.clip(lengths, 0, 8))).astype(np.uint64)
    return np.where(lengths > 0, packed >> np.minimum(shift, np.uint64(63)) << np.minimum(shift, np.uint64(63)), np.uint64(0))


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """A stable order of rows of numbers, the first column deciding first."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, 64, 16):
            digit = (column >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each bucket of lengths its terms in order, and which of them differ from the one before."""
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    for low, high in ((1, 8), (9, 16)):
        own = np.flatnonzero((lengths >= low) & (lengths <= high))
        if not len(own):
            continue
        columns = [_words(padded, starts[own], lengths[own])]
        if high > 8:
            columns.append(_words(padded, starts[own] + 8, lengths[own] - 8))
        order = radix_order(columns)
        new = np.ones(len(own), bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        yield own[order], new
    own = np.flatnonzero(lengths > 16)
    classes = np.frexp(lengths[own] - 1)[1]  # 17 to 32, 33 to 64, ...
    for size in np.unique(classes):
        here = own[classes == size]
        width = int(lengths[here].max())
        wide = np.zeros((len(here), width), np.uint8)
        for row, term in enumerate(here):
            wide[row, :lengths[term]] = data[starts[term]:ends[term]]
        keys = wide.view(f"S{width}").ravel()
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(here), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        yield here[order], new


def count_runs(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every (term, group): start and end of one occurrence, group, occurrences and texts.

    ``groups`` numbers the group of each text and must not fall from text to text.
    """
    lower = _LOWER[data]
    starts, ends, text = terms(data, offsets)
    group = groups[text] if len(text) else np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    for order, new in _buckets(lower, starts, ends):
        # stable orders leave a term's occurrences by text, and texts are by group
        first = np.flatnonzero(new | np.concatenate([[True], np.diff(group[order]) != 0]))
        texts = np.cumsum(new | np.concatenate([[True], np.diff(text[order]) != 0]))
        upto = np.append(first[1:], len(order))
        one = order[first]
        out.append((starts[one], ends[one], group[one], upto - first, texts[upto - 1] - texts[first] + 1))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of some terms one after the other, and their offsets."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    places = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return _LOWER[data[places]], offsets
