"""Personal data by anchors, against plain patterns over whole texts."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from llm_cases import no_docs, odd_docs, odd_rows
from reviewloom.llm import personal

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WEB = re.compile(r"(?i)(?<![a-z0-9+.-])(?:https?|ftps?|sftp|ssh)://(?=[^\x00-\x20\x7F<>\"/?#@]+@[a-z0-9]"
                 r"|\d{1,3}(?:\.\d{1,3}){3}(?!\.?[a-z0-9-])|[a-z0-9.:-]+/~[a-z0-9])[^\x00-\x20\x7F<>\"]+", re.ASCII)


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (kind, pattern) in enumerate(BASE.items())
                  for m in re.finditer(pattern, text) if holds(kind, m.group()))


def base(text):
    return [s for s in personal.find(text) if s[1] < len(BASE)]


CASES = [
    "a.b@c.d@e.f", "a@b", "@b.c", "x a@b.c.", "a@b@c.d", "a@b..c", "é.a@b-c.de!", "a_b%+-@x.y.z", "a@-.-", "me@x.y,you@x.z",
    "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 255.255.255.255", "0000255.1.1.01", "1..2.3.4.5", "1.2.3.4@5.6",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111", "4111111111111111 1", "x4111111111111111y", "1" * 40, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (017) 555-7713", "+1 (017) 555-7713.", "+15", "+1 5", "++1234567890", "+1234567890+1234567890", "+123456789012345678", "+1 2 3 4 5 6 7 8 9 0 (",
    "漢😀 a@b.c 漢 1.2.3.4", "", " ", "+", "@", "1",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_are_those_of_the_patterns(text):
    assert base(text) == plain(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="01259 .-+@()aZ%_é😀:/", max_size=60))
def test_base_spans_of_any_text(text):
    assert base(text) == plain(text)


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["http://", "HTTPS://", "ftp://", "xhttp://", "u@", "h.org", "1.2.3.4", "/~me", ".", ")", " ", "a", "-", "<", "5"]), max_size=9))
def test_web_addresses(parts):
    text = "".join(parts)
    want = []
    at = 0
    while m := WEB.search(text, at):
        end = m.start() + len(m.group().rstrip(".,;:!?'()[]{}"))
        want.append((m.start(), 4, end))
        at = end
    assert [s for s in personal.find(text) if s[1] == 4] == want


def said(text):
    return [(personal.KINDS[k], text[a:b]) for a, k, b in personal.find(text)]


def test_accounts():
    iban = "DE89 3704 0044 0532 0130 00"
    assert said(f"IBAN: {iban}.") == [("account", iban)]
    assert said(f"iban {iban.replace(' ', '')}") == [("account", iban.replace(" ", ""))]
    assert said("IBAN: DE88 3704 0044 0532 0130 00") == []
    assert said("SSN 123-45-6789") == [("account", "123-45-6789")] and said("SSN 666-45-6789") == []
    assert said("Account no. AB-123456, Passport: C01X00T47") == [("account", "AB-123456"), ("account", "C01X00T47")]
    for clean in ("on account of 2024", "account for it", "accounts 123456", "myaccount 123456", "passport office", "account: 12345", "account 123456789012345678901",
                  "account A1B2C3d4", "account", "iban", "iban "):
        assert said(clean) == [], clean


def test_luhn():
    assert personal.passes_luhn("4111111111111111") and not personal.passes_luhn("4111111111111112")


def test_the_report(spark):
    texts = {1: "mail a@b.cd and 1.2.3.4", 2: "4111 1111 1111 1111 +1 (017) 555-7713 http://u@h.org IBAN: DE89 3704 0044 0532 0130 00",
             3: None, 4: "", 5: "clean text, 5 words", 6: "😀 a@b.cd " * 50_000}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in personal.report(frame).collect()}
    for doc, text in texts.items():
        spans = personal.find(text or "")
        kinds = [personal.KINDS[k] for _, k, _ in spans]
        assert [got[doc][f"n_{k}"] for k in personal.BASE] == [kinds.count(k) for k in personal.BASE]
        listed = [f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert got[doc].spans == ",".join(listed)
        own = ",".join(x for x in listed if x.split(":")[0] in personal.BASE)
        assert got[doc].base_sha256 == hashlib.sha256(own.encode()).hexdigest()
    assert got[1].spans == "email:5:11,ip:16:23" and got[6].n_email == 50_000
    masked = {r.doc_id: r.text for r in personal.mask(frame).collect()}
    assert masked[1] == "mail [email] and [ip]" and masked[3] is None and masked[5] == texts[5]
    assert masked[2] == "[card] [phone] [address] IBAN: [account]"


def test_awkward_documents(spark):
    got = personal.report(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows()) and got[0].asDict().keys() == {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}
    assert {r.spans for r in got} == {""}
    assert personal.report(no_docs(spark)).count() == 0 and personal.mask(no_docs(spark)).count() == 0
