import random

import pytest
from tokenizers import BertWordPieceTokenizer

from reviewloom.operators import wordpiece

PIECES = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "롯데", "##월드", "월", "##드", "좋", "##아", "##요", "un", "##aff", "##able",
          "a", "##b", "##a", "b", "日", "本", "##本", "_", "!", "²"]


@pytest.fixture()
def vocabulary(spark):
    return spark.createDataFrame([(p,) for p in PIECES], "piece string")


def test_pieces_equal_a_public_tokenizer(spark, vocabulary):
    known = BertWordPieceTokenizer({p: i for i, p in enumerate(PIECES)}, lowercase=False, strip_accents=False)
    rnd = random.Random(5)
    parts = ["롯데", "월드", "좋아요", "un", "aff", "able", "a", "b", " ", "日本", "_", "!", "x", "²", "\t", "$", "^", "`", "~", "「", "…", "\u3000", "豈", "𠀀", "々", "—"]
    texts = ["롯데월드 좋아요", "unaffable", "日本a", "a" * 101, "a" * 100, ""] + [
        "".join(rnd.choices(parts, k=rnd.randint(1, 8))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = [r.tokenized_content for r in wordpiece.with_pieces(df, vocabulary, 1000).orderBy("i").collect()]
    assert got == [known.encode(t, add_special_tokens=False).tokens for t in texts]


def test_limits_null_and_a_long_vocabulary(spark, vocabulary):
    df = spark.createDataFrame([(0, "a " * 300), (1, None)], "i int, content string")
    got = [r.tokenized_content for r in wordpiece.with_pieces(df, vocabulary).orderBy("i").collect()]
    assert got == [["a"] * 250, []]
    long = vocabulary.unionByName(spark.range(600_000).selectExpr("concat('piece', id) AS piece")).unionByName(vocabulary)
    got = wordpiece.with_pieces(df, long.unionByName(spark.createDataFrame([(None,)], "piece string"))).orderBy("i").collect()
    assert [r.tokenized_content for r in got] == [["a"] * 250, []]
    words = spark.createDataFrame([("aaaa",)], "content string")
    assert wordpiece.with_pieces(words, long, word_limit=3).first().tokenized_content == ["[UNK]"]
    assert wordpiece.with_pieces(words, long, limit=2).first().tokenized_content == ["a", "##a"]
