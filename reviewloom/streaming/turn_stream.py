"""Conversation state: message events to paired turns, whatever the order they arrive in.

A micro-batch only adds its messages to the sink, so its cost does not grow with
what came before. Pairs follow from the stored messages by the batch operator,
which spreads a long conversation over many tasks; a message that arrives late
takes its place by ``turn``. ``start_pairing`` stores messages as they are.
``start_live_pairing`` also numbers their pairs at once from two numbers per
conversation in Spark's state store; a conversation in which a message came late
is marked, and its pairs are made anew from its messages when they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reviewloom.operators.conversations import merge_fragments, pair_turns
from reviewloom.operators.ordered import RANGE_WIDTH

_PARTS = "conv_id long, turn long, role string, text string, pair_no long, late boolean"
_STATE = "pairs long, is_open boolean, last_turn long"
_ROLES = ("user", "assistant")


def start_pairing(messages: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Store the messages that have arrived, then stop; later starts go on from there.

    ``messages`` streams ``conv_id, turn, role, text``. A micro-batch writes its
    own folder, so running it again after a failure replaces what it wrote.
    """
    return (messages.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, batch_id: pair_batch(batch, batch_id, sink))
            .trigger(availableNow=True).start())


def pair_batch(batch: DataFrame, batch_id: int, sink: str) -> None:
    """Write one micro-batch's messages; their pairs are numbered when they are read."""
    (batch.filter(F.col("role").isin(*_ROLES)).select(
        "conv_id", "turn", "role", "text", F.lit(None).cast("long").alias("pair_no"), F.lit(True).alias("late"))
     .write.mode("overwrite").parquet(f"{sink}/parts/batch={batch_id}"))


def _pair(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Number this micro-batch's messages of one conversation after the stored pair count."""
    pairs, is_open, last = state.get if state.exists else (0, False, None)
    rows = pd.concat(list(chunks)).sort_values("turn")
    late = last is not None and int(rows["turn"].iloc[0]) <= last
    numbers = []
    for role, text in zip(rows["role"], rows["text"].fillna("")):
        is_user = role == "user"
        pairs += is_user or not is_open
        is_open = is_user or text == ""
        numbers.append(pairs)
    newest = int(rows["turn"].iloc[-1])
    state.update((int(pairs), bool(is_open), newest if last is None else max(newest, last)))
    yield pd.DataFrame({"conv_id": key[0], "turn": rows["turn"], "role": rows["role"], "text": rows["text"],
                        "pair_no": numbers, "late": late})


def start_live_pairing(messages: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """The same with keyed state. One conversation's messages of a micro-batch are
    ordered in one task, so bound the micro-batch at its source (``stream_messages`` does)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/parts/batch={batch_id}")

    kept = messages.filter(messages["role"].isin(*_ROLES))
    parts = kept.groupBy("conv_id").applyInPandasWithState(
        _pair, _PARTS, _STATE, "append", GroupStateTimeout.NoTimeout)
    return (parts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(write).trigger(availableNow=True).start())


def read_pairs(spark: SparkSession, sink: str, width: int = RANGE_WIDTH) -> DataFrame:
    """All pairs so far; those of conversations with late messages are numbered here."""
    parts = spark.read.schema(_PARTS).parquet(f"{sink}/parts")
    late = parts.filter("late").select("conv_id").distinct()
    text, is_user = F.coalesce("text", F.lit("")), F.col("role") == "user"
    in_order = parts.join(late, "conv_id", "left_anti").select(
        "conv_id", "pair_no", F.when(is_user, text).otherwise("").alias("user"),
        F.when(is_user, "").otherwise(text).alias("assistant"))
    again = parts.join(late, "conv_id", "left_semi").select("conv_id", "turn", "role", "text")
    return merge_fragments(in_order).unionByName(pair_turns(again, width))
