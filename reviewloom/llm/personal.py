"""Personal data by anchor expansion: mail and web addresses, numbers, accounts.

One Aho-Corasick pass over a text finds anchors: at-signs, the ``://`` of a scheme, a
plus before a digit, digits, and words that announce an identifier. At an anchor a small
parser expands to both sides, never over what its kind has already taken, and checks what
it found; each parser reads on without going back, so a text takes time in proportion to
its length whatever it holds.

Base kinds, each from left to right without overlaps, a failing one dropped whole:
``email``; ``ip``, four numbers up to 255; ``card``, 14 to 19 digits that pass Luhn's
check; ``phone``, a plus and 10 to 15 digits. The anchors add ``address``, a web address
that names a person or a machine (user before an at-sign, a host of four numbers, a home
folder /~name), and ``account``, the identifier that follows a word for it: an IBAN with
right check digits, a social security number, or 6 to 20 letters and digits, of them at
least four digits. Kinds may overlap one another. Places are code points.

Defined cases: a null text is empty and has no spans; a null id and repeated rows are
returned as they are; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh")
#: Words that announce an identifier; found in lower case, upper case and with a capital.
CUES = ("iban", "ssn", "account", "acct", "passport", "customer id", "member id", "konto", "compte", "cuenta")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_FOUR = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_DIAL = re.compile(r"[ ().0-9-]++")
_SCHEME = re.compile(rf"(?<![A-Za-z0-9+.-])(?:{'|'.join(SCHEMES)})\Z", re.IGNORECASE)
_REST = re.compile(r'[^\x00-\x20\x7F<>"]++')
_PERSON = re.compile(r'[^\x00-\x20\x7F<>"/?#@]++@[A-Za-z0-9]|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[A-Za-z0-9-])'
                     r'|[A-Za-z0-9.:-]++/~[A-Za-z0-9]')
_ASIDE = re.compile(r"(?: ?(?:number|no\.?|nr\.?|id)(?![A-Za-z0-9]))? ?[:#=]? ?", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9-])")
_NUMBER = re.compile(r"[A-Z0-9]++(?:-[A-Z0-9]++)*+(?![A-Za-z0-9])")
_LUHN = {str(d): (d, sum(divmod(2 * d, 10))) for d in range(10)}


@functools.cache
def _anchors() -> ahocorasick.Automaton:
    """Each anchor with its kind and length."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("://", (":", 3))
    for digit in "0123456789":
        found.add_word(digit, ("0", 1))
        found.add_word("+" + digit, ("+", 2))
    for cue in CUES:
        for word in (cue, cue.upper(), cue.capitalize()):
            found.add_word(word, ("word", len(word)))
    found.make_automaton()
    return found


def passes_luhn(digits: str) -> bool:
    return sum(_LUHN[d][k % 2] for k, d in enumerate(reversed(digits))) % 10 == 0


def _is_iban(text: str) -> bool:
    compact = text.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _mail(text: str, at: int, floor: int) -> tuple[int, int] | None:
    before = text[floor:at]
    start = floor + len(before.rstrip(_LOCAL))
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    run = _DIAL.match(text, plus + 2)
    inner = run.group().rstrip(" ().-") if run else ""
    if len(inner) < 2 or not 10 <= 1 + sum(map(str.isdigit, inner)) <= 15:
        return None
    return plus, plus + 2 + len(inner)


def _address(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around the ``://`` at ``at``."""
    scheme = _SCHEME.search(text[max(floor, at - 8):at])
    if not scheme or not _PERSON.match(text, at + 3):
        return None
    return at - len(scheme.group()), at + 3 + len(_REST.match(text, at + 3).group().rstrip(".,;:!?'()[]{}"))


def _account(text: str, start: int, end: int) -> tuple[int, int] | None:
    """After the word from ``start`` to ``end``."""
    if start and text[start - 1].isascii() and text[start - 1].isalnum():
        return None
    at = _ASIDE.match(text, end).end()
    if at == end:  # the word goes on, or ends the text
        return None
    word = text[start:end].lower()
    found = (_IBAN if word == "iban" else _SSN if word == "ssn" else _NUMBER).match(text, at, at + 64)
    if not found or word == "iban" and not _is_iban(found.group()):
        return None
    compact = found.group().replace("-", "")
    if word in ("iban", "ssn") or 6 <= len(compact) <= 20 and sum(map(str.isdigit, compact)) >= 4:
        return found.span()
    return None


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, by start and kind; kinds are places in ``KINDS``."""
    out: list[tuple[int, int, int]] = []
    mail_floor = ip_end = card_end = address_end = account_end = 0
    for last, (anchor, length) in _anchors().iter(text):
        if anchor == "0":
            if last >= card_end and (chain := _CHAIN.match(text, last)):
                card_end = chain.end()
                if card_end - last <= 37:
                    digits = chain.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and passes_luhn(digits):
                        out.append((last, 2, card_end))
            if last >= ip_end and not (last and text[last - 1] in "0123456789") and (four := _FOUR.match(text, last)):
                ip_end = four.end()
                if all(len(part := x.lstrip("0")) <= 3 and int(part or 0) <= 255 for x in four.groups()):
                    out.append((last, 1, ip_end))
        elif anchor == "@":
            if found := _mail(text, last, min(mail_floor, last)):
                out.append((found[0], 0, found[1]))
            mail_floor = max(last + 1, found[1] if found else 0)
        elif anchor == "+":
            if found := _phone(text, last - 1):
                out.append((found[0], 3, found[1]))
        elif anchor == ":":
            if last >= address_end and (found := _address(text, last - 2, address_end)):
                address_end = found[1]
                out.append((found[0], 4, address_end))
        elif last >= account_end and (found := _account(text, last + 1 - length, last + 1)):
            account_end = found[1]
            out.append((found[0], 5, account_end))
    return sorted(out)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends, kinds, cuts = [], [], [], [0]
        for text in batch.column(1):
            for start, kind, end in find(text.as_py() or ""):
                starts.append(start)
                ends.append(end)
                kinds.append(KINDS[kind])
            cuts.append(len(starts))
        spans = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                                           ["kind", "start", "end"])
        yield pa.record_batch({"doc_id": batch.column(0), "spans": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)})


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for value in batch.column(1):
            text, parts, at = value.as_py(), [], 0
            for start, kind, end in find(text or ""):
                if start >= at:
                    parts += [text[at:start], f"[{KINDS[kind]}]"]
                at = max(at, end)
            texts.append(text if not at else "".join([*parts, text[at:]]))
        yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end; by start, then kind) of every document."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _spans, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long>>")


def mask(docs: DataFrame) -> DataFrame:
    """doc_id, text with the kind in place of each span, or of spans that overlap the first one's; null stays null."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _masked, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans, and all spans as text."""
    spans = F.col("spans")
    return find_personal(docs).select(
        "doc_id",
        *map(_count, BASE),
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _listed(spans).alias("spans"))
