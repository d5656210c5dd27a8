"""Token ids of whole texts, with the ids of words remembered in each Python worker.

The tokenizer splits at white space before anything else, so a text's ids are
those of its words one after the other. Words are looked up in a bounded memory;
what it lacks is encoded together, once per block of texts.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator
from itertools import compress
from operator import not_

import numpy as np
import regex

from reviewloom.llm.words import pieces

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries that a worker keeps of words, and of parts of words.
WORDS, PARTS = 500_000, 400_000
#: Words that are looked up together.
BLOCK_WORDS = 100_000
#: Where lower case, composition and classes of characters leave no doubt.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Letters and the signs after them, a line each; nothing for a line of another form.
_SIMPLE = re.compile(r"(?m)^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)|[^\n]*)$")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """Ids as little-endian unsigned 32-bit numbers, equal to the tokenizer's ids of the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.mark = self._whole("0")
        self.last = self._last_ids()

    def _last_ids(self) -> np.ndarray | None:
        """Which ids only a part's last piece has, if the vocabulary tells them by a suffix."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab()
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[n for piece, n in vocabulary.items() if piece.endswith(suffix)]] = True
        return last

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Parts are encoded together; where each ends tell its last piece's suffix or else, as parts hold no digit
        unless they are one, the id of a digit between them."""
        digits = [p for p in parts if len(p) == 1 and p.isnumeric()]
        rest = [p for p in parts if not (len(p) == 1 and p.isnumeric())]
        found = {p: self._whole(p) for p in digits}
        if not rest:
            return found
        if self.last is not None:
            ids = self._ids(" ".join(rest))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(rest) and ends[-1] == len(ids):
                data, at = ids.tobytes(), 0
                for part, end in zip(rest, (4 * ends).tolist()):
                    found[part] = data[at:end]
                    at = end
                return found
        ids = self._ids(" 0 ".join(rest) + " 0")
        ends = np.flatnonzero(ids == int.from_bytes(self.mark, "little"))
        data, at = ids.tobytes(), 0
        for part, end in zip(rest, ends.tolist(), strict=True):
            found[part] = data[4 * at:4 * end]
            at = end + 1
        return found

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Letters and the signs after them, the form of nearly all words, are taken apart by one search of them all."""
        found, split = {}, {}
        cores, signs = zip(*_SIMPLE.findall(b"\n".join(words).decode("utf-8", "replace")))
        cores = "\n".join(cores).lower().split("\n")
        if "<|" in "\n".join(signs):
            cores = ["" if "<|" in sign else core for core, sign in zip(cores, signs)]
        wanted = {*cores, *signs, ""}
        wanted.remove("")
        for word in compress(words, map(not_, cores)):
            text = word.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                split[word] = own = _SPLIT.findall(text.lower())
                wanted.update(own)
            else:
                found[word] = self._whole(text)
        known = self.parts
        new = self._encode_parts(list(wanted.difference(known)))
        full = len(known) >= PARTS
        known.update(new)
        found.update((word, known[core] + known[sign] if sign else known[core])
                     for word, core, sign in zip(words, cores, signs, strict=True) if core)
        for word, own in split.items():
            found[word] = b"".join([known[p] for p in own])
        if full:
            for part in new:
                del known[part]
        return found

    def look_up(self, words: list[bytes]) -> tuple[list[bytes | None], dict[int, bytes]]:
        """The ids of the words that are remembered, and the other words by their places."""
        found = list(map(self.words.get, words))
        return found, {at: words[at] for at, ids in enumerate(found) if ids is None} if None in found else {}

    def fill(self, texts: Iterable[tuple[list[bytes | None], dict[int, bytes]]]) -> Iterator[bytes]:
        """The ids of several lists of words that have been looked up."""
        texts = list(texts)
        wanted = {word for _, lacking in texts for word in lacking.values()}
        new = self._encode_words(list(wanted)) if wanted else {}
        if len(self.words) < WORDS:
            self.words.update(new)
        for found, lacking in texts:
            for at, word in lacking.items():
                found[at] = new[word]
            yield b"".join(found)

    def encode(self, texts: Iterable[list[bytes]]) -> list[bytes]:
        """The ids of several lists of words."""
        return list(self.fill(map(self.look_up, texts)))


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded(rows: Iterable[tuple[object, str | None]], path: str) -> Iterator[tuple[object, bytes, bool]]:
    """(key, ids, last): the ids of each text in pieces, in order; ``last`` marks a text's end."""
    model, waiting, held = encoder(path), [], 0

    def flush() -> Iterator[tuple[object, bytes, bool]]:
        found = model.fill([words for _, words, _ in waiting])
        yield from ((key, ids, last) for (key, _, last), ids in zip(waiting, found))
        waiting.clear()

    for key, text in rows:
        data = (text or "").encode("utf-8", "replace")
        at = 0
        for piece in pieces(data):
            at += len(piece)
            words = piece.split()
            held += len(words)
            waiting.append((key, model.look_up(words), at == len(data)))
            if held >= BLOCK_WORDS:
                yield from flush()
                held = 0
        if not data:
            waiting.append((key, ([], {}), True))
    yield from flush()
