"""Packing, shards and mixtures."""

import zlib

import numpy as np
import pytest
from llm_cases import crc, no_docs, odd_docs, odd_rows, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewloom.llm import mixing, packing, queries, sharding, token_ids


def pieces_are_whole(rows, found):
    """Every id of every document lies in one piece; sequences are full and without gaps. Returns padding."""
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    ids = {}
    for doc, text in rows:
        own = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        ids.setdefault(doc, []).append(np.array(own, "<u4"))
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, own in ids.items():
        assert sum(r.length for r in by_doc[doc]) == sum(map(len, own))
        assert {r.doc_tokens for r in by_doc[doc]} == set(map(len, own))
        if len(own) == 1:
            at = 0
            for r in sorted(by_doc[doc], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(own[0][at:at + r.length].tobytes())
                at += r.length
    padding = 0
    for rows_of in by_sequence.values():
        at = 0
        for r in sorted(rows_of, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
        padding += 0 if at & at - 1 == 0 else 4096 - at
    return padding


def test_pieces(spark):
    rows = odd_rows()
    found = packing.pack(odd_docs(spark), queries.TOKENIZER).collect()
    assert pieces_are_whole([r[:2] for r in rows], found) == 0
    assert packing.pack(no_docs(spark), queries.TOKENIZER).count() == 0


@pytest.mark.parametrize("sizes", [[3000] * 40, [4096] * 5 + [1], [600, 3500] * 30, [5] * 700, [100_000, 2, 2]])
def test_windows_of_any_lengths_fill(sizes):
    """One task's packer leaves less than one longest window."""
    packer = packing._Packer(packing.TIERS, 0)
    for doc, size in enumerate(sizes):
        ids = np.arange(size, dtype="<u4").tobytes()
        whole = size // 4096
        packer.add(doc, [zlib.crc32(ids[4 * 4096 * k:4 * 4096 * (k + 1)]) for k in range(whole)], ids[4 * 4096 * whole:], size)
    packer.finish()
    full = [r for r in packer.rows if r[-1] is None]
    tail = [r for r in packer.rows if r[-1] is not None]
    assert sum(r[2] for r in full) + sum(r[2] for r in tail) == sum(sizes)
    assert sum(r[2] for r in tail) < 4096
    totals = {}
    for r in full:
        totals[r[5], r[7]] = totals.get((r[5], r[7]), 0) + r[2]
    assert all(tokens == context for (_, context), tokens in totals.items())


def test_steps_are_balanced(spark):
    found = queries.op1_packing(spark, "/root/testdata/sf0.01").where("sequence_id < (1L << 61)")
    steps = [r["sum(length)"] for r in found.groupBy("step_id").sum("length").collect()]
    assert max(steps) <= 1.1 * packing.STEP_TOKENS and sorted(steps)[1] >= 0.7 * packing.STEP_TOKENS


def test_word_by_word_ids_equal_whole_text_ids():
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    texts = [t for _, t, *_ in odd_rows()] + [
        "it's I'LL we'VE o'clock 's 't", "a1b22c ½ ² x́ İstanbul ΣΑΣ ß ẞ", "tab\tand\x0bline\x0cfeed\r\n",
        "́start", "non break space\x1cx\x85y", "<|startoftext|> <|endoftext|>a", "THE!! $$%%&&& ### x", "\x00 \x7f"]
    for _ in range(2):  # the second time from memory
        got = [ids for _, ids, last in token_ids.encoded(enumerate(texts), queries.TOKENIZER) if last]
        whole = [ids for _, ids, _ in token_ids.encoded(enumerate(texts), queries.TOKENIZER)]
        for text, ids in zip(texts, got):
            if len((text or "").encode()) < 4 << 20:
                assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
        assert len(whole) == len(texts)


def test_shards(spark):
    rows = odd_rows()
    got = sharding.assign_shards(odd_docs(spark), shards=4).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((d, len((t or "").encode()) + 8, crc(t)) for d, t, *_ in rows), key=repr)
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    for shard in {r.shard for r in got}:
        assert [r.slot for r in ordered if r.shard == shard] == list(range(sum(r.shard == shard for r in got)))
    assert sharding.assign_shards(no_docs(spark)).count() == 0


def test_shards_are_nearly_equal(spark):
    rows = [(k, "x" * (k % 50), None, None, None) for k in range(5000)]
    sizes = [r["sum(size)"] for r in
             sharding.assign_shards(odd_docs(spark, rows), 24).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 57


def fill(children, budget):
    """Weights with capacities, by raising the level step by step."""
    given = {name: 0.0 for name in children}
    open_ = {n for n, (capacity, weight) in children.items() if weight and capacity}
    while budget > 1e-9 and open_:
        total = sum(children[n][1] for n in open_)
        step = min(budget / total, min((children[n][0] - given[n]) / children[n][1] for n in open_))
        for n in open_:
            given[n] += step * children[n][1]
        budget -= step * total
        open_ = {n for n in open_ if children[n][0] - given[n] > 1e-9}
    return given


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 500), ("a", "de", "s1", 5), ("b", "en", "s3", 40), ("b", "fr", "s4", 1),
              ("c", "en", "s5", 1000), ("d", "en", "s6", 900)]
    weights = {"domain": {"a": 4, "b": 3, "c": 2, "d": 0}, "lang": {"en": 3}}
    from pyspark.sql import functions as F
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(
        spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"),
        F.lit(900), weights, 2).collect()}
    capacity = lambda rows: 2 * sum(r[3] for r in rows)
    top = fill({d: (capacity([r for r in leaves if r[0] == d]), weights["domain"][d]) for d in "abcd"}, 900)
    for d in "abcd":
        own = [r for r in leaves if r[0] == d]
        by_lang = fill({la: (capacity([r for r in own if r[1] == la]), 3 if la == "en" else 1) for la in {r[1] for r in own}}, top[d])
        for la, budget in by_lang.items():
            last = fill({r[2]: (2 * r[3], 1) for r in own if r[1] == la}, budget)
            for source, tokens in last.items():
                assert got[d, la, source] == pytest.approx(tokens)


def test_mixture_of_odd_documents(spark):
    docs = odd_docs(spark)
    chosen = mixing.select_prefixes(docs, queries.WEIGHTS, share=0.5).collect()
    tokens = {}
    for d, t, *_ in odd_rows():
        tokens.setdefault(d, set()).add(len(words(t)))
    assert all(r.tokens in tokens[r.doc_id] for r in chosen)
    total = sum(len(words(t)) for _, t, *_ in odd_rows())
    assert abs(sum(r.taken for r in chosen) - total // 2) <= 25
    by_leaf = {}
    for r in chosen:
        by_leaf.setdefault((r.domain, r.lang, r.source), []).append(r)
    for own in by_leaf.values():
        at = 0
        for r in sorted(own, key=lambda r: (r.epoch, r.digest, r.doc_id is not None, r.doc_id or 0, r.tokens)):
            assert r.start == at
            at += r.tokens
    mixed = mixing.mixed(docs, queries.WEIGHTS, share=0.5)
    assert mixed.columns == docs.columns
    assert sorted((r.doc_id for r in mixed.collect()), key=repr) == sorted((r.doc_id for r in chosen), key=repr)
    assert mixing.select_prefixes(no_docs(spark), queries.WEIGHTS).count() == 0
    assert mixing.mixed(no_docs(spark), queries.WEIGHTS).count() == 0


def test_rows_that_repeat_an_id_are_counted_and_come_back(spark):
    """A third of the rows without an id, empty texts among them: every row has its own place in its leaf's line."""
    rows = [(None if k % 3 == 0 else k, "" if k % 9 == 0 else "two words" if k % 3 == 0 else "one " * (k % 5), "en", "src1", 0) for k in range(900)]
    docs = odd_docs(spark, rows)
    chosen = mixing.select_prefixes(docs, {}, share=2.0, epochs=2).collect()
    assert len(chosen) == 1800 and sum(r.doc_id is None for r in chosen) == 600
    for epoch in (0, 1):
        line = sorted((r.start, r.tokens) for r in chosen if r.epoch == epoch)
        at = line[0][0]
        for start, tokens in line:
            assert start == at
            at += tokens
    # before the end, what an id and length have in common is one row
    kept = mixing.mixed(docs, {}, share=0.5)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("seed", range(3))
def test_water_levels_of_many_siblings(spark, seed):
    rng = np.random.default_rng(seed)
    tokens = np.floor(rng.pareto(0.6, 3000)).astype(int) % 100_000
    leaves = spark.createDataFrame([("d", "en", f"s{k}", int(t)) for k, t in enumerate(tokens)], "domain string, lang string, source string, tokens long")
    weights = {"source": {f"s{k}": int(w) for k, w in enumerate(rng.integers(0, 6, 300))}}
    got = {r.source: r.budget for r in mixing.budgets(leaves, F.floor(F.col("all_tokens") * 0.3), weights, 1).collect()}
    total = float(np.floor(tokens.sum() * 0.3))
    weight = np.array([weights["source"].get(f"s{k}", 1) for k in range(len(tokens))], float)
    low, high = 0.0, 1e9
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if np.minimum(tokens, middle * weight).sum() < total else (low, middle)
    assert np.allclose([got[f"s{k}"] for k in range(len(tokens))], np.minimum(tokens, high * weight), rtol=1e-6)


def test_words_are_encoded_without_separators_and_alike_when_memory_is_full(monkeypatch):
    """The ids are the tokenizer's, and nothing is encoded only to tell where a part ends."""
    from reviewloom.llm import token_ids
    texts = ["Don't the-cat 's 12x, École! ſ ½² <|endoftext|> 漢字 a", "the dog, the-cat; don't!! Zz9 \x00 é", "", None, "new Words only here"]
    path, asked = token_ids_path(), []
    for words, parts in ((token_ids.WORDS, token_ids.PARTS), (0, 0)):
        monkeypatch.setattr(token_ids, "WORDS", words)
        monkeypatch.setattr(token_ids, "PARTS", parts)
        model = token_ids.WordEncoder(path)
        joined = model._ids
        monkeypatch.setattr(model, "_ids", lambda text: (asked.append(text), joined(text))[1])
        for _ in range(2):
            got = model.encode([(t or "").encode().split() for t in texts])
            assert got == [b"".join(model._whole(w) for w in (t or "").split()) for t in texts]
        assert bool(model.words) == bool(model.parts) == bool(words)
    assert asked and not any(c.isdigit() for text in asked for c in text)


def test_words_of_letters_and_signs_are_taken_apart_together(monkeypatch):
    """Only words of other forms are searched one by one; all ids are the tokenizer's."""
    from reviewloom.llm import token_ids
    text = "École, the THE heat*** été... a' b<| ß; don't x-y 7 'quoted' naïve!? c<||>d"
    model, searched, split = token_ids.WordEncoder(token_ids_path()), [], token_ids._SPLIT

    class Watched:
        @staticmethod
        def findall(word):
            searched.append(word)
            return split.findall(word)
    monkeypatch.setattr(token_ids, "_SPLIT", Watched)
    got = model.encode([text.encode().split(), "the été... new,".encode().split()])
    assert got == [model._whole(text), model._whole("the été... new,")]
    assert sorted(searched) == sorted(["don't", "x-y", "7", "'quoted'"])


def token_ids_path():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
