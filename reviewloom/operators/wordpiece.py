"""Word pieces from a given vocabulary.

The default tokens of a cleaned review are its words, cut out by Spark itself.
Where a vocabulary is at hand, words are cut further into its longest pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.fixed_values import TOKEN_LIMIT
from reviewloom.functions.text import split_words

UNKNOWN = "[UNK]"
#: Default of the longest word that is cut; longer ones become one ``[UNK]``.
WORD_LIMIT = 100


#: Ideographs stand alone as words, and so do punctuation and the other printable marks of ASCII.
_ALONE = (r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EE5D}\x{30000}-\x{323AF}"
          r"\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}\p{P}$+<=>^`|~])")


def _split(text: Column) -> Column:
    return split_words(F.regexp_replace(text, _ALONE, " $1 "))


def _longest_first(word: Column, steps: Column) -> Column:
    """Pieces of a word from the left; ``steps`` maps a place to the longest piece's length there."""
    end = F.length(word) + 1
    nothing = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(done: Column, _: Column) -> Column:
        size = F.try_element_at(steps, done["at"])
        piece = F.concat(F.when(done["at"] > 1, "##").otherwise(""), F.substr(word, done["at"], size))
        return (F.when(done["at"] >= end, done)
                .when(size.isNull(), F.struct(end.alias("at"), F.array(F.lit(UNKNOWN)).alias("pieces")))
                .otherwise(F.struct((done["at"] + size).alias("at"), F.concat(done["pieces"], F.array(piece)).alias("pieces"))))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), nothing, step)["pieces"]


def cut_words(words: DataFrame, vocabulary: DataFrame, word_limit: int = WORD_LIMIT) -> DataFrame:
    """``word, pieces`` of distinct words: longest pieces from the left, later ones with the ``##`` prefix.

    Every part of a word is looked up by an equi-join, so a vocabulary can have any size.
    """
    size = F.length("word")
    parts = (
        words.filter(size <= word_limit).select("word", F.explode(F.sequence(F.lit(1), size)).alias("at"))
        .select("word", "at", F.explode(F.sequence(F.lit(1), size - F.col("at") + 1)).alias("n"))
        .withColumn("piece", F.concat(F.when(F.col("at") > 1, "##").otherwise(""),
                                      F.substr("word", "at", "n")))
    )
    known = vocabulary.select("piece").filter("piece IS NOT NULL").distinct()
    steps = (parts.join(known, "piece").groupBy("word", "at").agg(F.max("n").alias("n"))
             .groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("steps")))
    return words.join(steps, "word", "left").select("word", F.when(
        F.col("steps").isNull(), F.array(F.lit(UNKNOWN))).otherwise(_longest_first(F.col("word"), F.col("steps"))).alias("pieces"))


def with_pieces(clean: DataFrame, vocabulary: DataFrame, limit: int = TOKEN_LIMIT,
                word_limit: int = WORD_LIMIT) -> DataFrame:
    """Replace ``tokenized_content`` by the first ``limit`` word pieces of ``content``.

    ``vocabulary`` has one column ``piece`` and any length. Equal contents are cut
    once; a NULL or empty content has no pieces.
    """
    # every word gives a piece, so words beyond the limit do not count
    placed = clean.select("content").distinct().select(
        "content", F.posexplode(F.slice(_split(F.col("content")), 1, limit)).alias("place", "word"))
    cut = cut_words(placed.select("word").distinct(), vocabulary, word_limit)
    ordered = F.array_sort(F.collect_list(F.struct("place", "pieces")))
    tokens = placed.join(cut, "word").groupBy("content").agg(
        F.slice(F.flatten(F.transform(ordered, lambda w: w["pieces"])), 1, limit).alias("__pieces"))
    return clean.join(tokens, "content", "left").withColumn(
        "tokenized_content", F.coalesce("__pieces", F.array().cast("array<string>"))).select(
        *dict.fromkeys([*clean.columns, "tokenized_content"]))
