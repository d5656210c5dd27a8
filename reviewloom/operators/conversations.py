"""Conversation turns: pairing, history, last message, transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reviewloom.fixed_values import HISTORY_TURNS
from reviewloom.operators.ordered import RANGE_WIDTH, with_ranges

_ROLES = ("user", "assistant")


def pair_turns(messages: DataFrame, width: int = RANGE_WIDTH) -> DataFrame:
    """``conv_id, pair_no, user, assistant`` from ``conv_id, turn, role, text``.

    A user message opens a pair. An assistant message fills the pair that is
    open, and otherwise opens one without a user text. A pair is open until it
    holds an assistant text that is not empty. Other roles are ignored.
    """
    return merge_fragments(number_messages(messages, width=width))


def number_messages(messages: DataFrame, width: int = RANGE_WIDTH) -> DataFrame:
    """Each message as its part of a pair: ``conv_id, turn, pair_no, user, assistant``.

    A conversation may be longer than one task should hold, so it is cut into
    ranges of about ``width`` messages. Inside a range only its first message lacks a predecessor;
    one summary row per range settles that message and the count so far.
    """
    is_user = F.col("role") == "user"
    rows = messages.filter(F.col("role").isin(*_ROLES)).select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("leaves_open", is_user | (F.col("text") == ""))

    inside = Window.partitionBy("conv_id", "range").orderBy("turn")
    seen = with_ranges(rows, ["conv_id"], "turn", width, "range").withColumn(
        "was_open", F.lag("leaves_open").over(inside))
    # pairs opened here; NULL for an assistant message that begins a range
    seen = seen.withColumn("opens", F.when(is_user, 1).otherwise((~F.col("was_open")).cast("int")))

    ranges = seen.groupBy("conv_id", "range").agg(
        F.sum("opens").alias("n"), F.max(F.col("opens").isNull()).alias("unsettled"),
        F.max_by("leaves_open", "turn").alias("ends_open"))
    earlier = Window.partitionBy("conv_id").orderBy("range")
    settled = ranges.withColumn(
        "first_opens", (F.col("unsettled") & ~F.lag("ends_open", 1, False).over(earlier)).cast("int"))
    all_before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = settled.select(
        "conv_id", "range", "first_opens",
        F.coalesce(F.sum(F.coalesce("n", F.lit(0)) + F.col("first_opens")).over(all_before), F.lit(0)).alias("offset"))

    counted = seen.withColumn("local_no", F.coalesce(F.sum("opens").over(inside), F.lit(0)))
    return counted.join(offsets, ["conv_id", "range"]).select(
        "conv_id", "turn", (F.col("offset") + F.col("first_opens") + F.col("local_no")).alias("pair_no"),
        F.when(is_user, F.col("text")).otherwise("").alias("user"),
        F.when(is_user, "").otherwise(F.col("text")).alias("assistant"))


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """One row per pair from parts of it; of each side at most one part is not empty."""
    return fragments.groupBy("conv_id", "pair_no").agg(
        F.max("user").alias("user"), F.max("assistant").alias("assistant"))


def last_turns(pairs: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """The last ``n`` pairs of each conversation."""
    latest = Window.partitionBy("conv_id").orderBy(F.desc("pair_no"))
    return pairs.withColumn("__back", F.row_number().over(latest)).filter(F.col("__back") <= n).drop("__back")


def history(pairs: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """The last ``n`` pairs as one ordered list per conversation."""
    ordered = F.array_sort(F.collect_list(F.struct("pair_no", "user", "assistant")))
    return last_turns(pairs, n).groupBy("conv_id").agg(
        F.transform(ordered, lambda p: F.struct(p["user"].alias("user"), p["assistant"].alias("assistant")))
        .alias("conversation_history"))


def last_user_message(messages: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """Last non-empty user text per conversation, else its ``user_input``, else ''."""
    spoken = F.when((F.col("role") == "user") & (F.col("text") != ""), F.col("turn"))
    found = messages.groupBy("conv_id").agg(F.max_by("text", spoken).alias("found"))
    if inputs is None:
        return found.select("conv_id", F.coalesce("found", F.lit("")).alias("last_user_message"))
    return found.join(inputs.select("conv_id", "user_input"), "conv_id", "full").select(
        "conv_id", F.coalesce("found", "user_input", F.lit("")).alias("last_user_message"))


def append_answers(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Add one ``{user, assistant}`` pair per answered conversation after its last one.

    ``answers`` holds ``conv_id, user, assistant``, one row per conversation.
    """
    ends = pairs.groupBy("conv_id").agg(F.max("pair_no").alias("last_no"))
    added = answers.join(ends, "conv_id", "left").select(
        "conv_id", (F.coalesce("last_no", F.lit(0)) + 1).alias("pair_no"), "user", "assistant")
    return pairs.unionByName(added)


def transcript(pairs: DataFrame, node: str = "chat") -> DataFrame:
    """One transcript entry per pair; joined by line feeds they are the whole text.

    Entries stay rows, since the text of one conversation has no upper bound.
    """
    label = F.col("node") if "node" in pairs.columns else F.lit(node)
    entry = F.concat(F.lit("["), label, F.lit("] 사용자: "), F.coalesce("user", F.lit("None")),
                     F.lit("\n챗봇: "), F.col("assistant"), F.lit("\n"))
    return pairs.select("conv_id", "pair_no", entry.alias("entry"))
