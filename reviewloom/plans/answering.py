"""A batch of chat messages through routing and the three handlers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from reviewloom.fixed_values import (CATEGORY_WORDS, PROMPT_CHAT, REPLY_CHAT_FAILED, REPLY_REVIEW_FAILED,
                                     REPLY_SUBJECT_FAILED)
from reviewloom.functions.text import trim_space
from reviewloom.operators import retrieval, routing, subjects
from reviewloom.operators.answers import ask_once, one_by_one
from reviewloom.operators.embed import hashed_features
from reviewloom.operators.ordered import drop_range, running_sum
from reviewloom.session import stored

FIGURES = ("retrieved_reviews", "total_found", "filtered_count", "used_count", "avg_similarity", "max_similarity",
           "min_similarity", "confidence", "note")


def session_states(messages: DataFrame, index: DataFrame, catalogue: DataFrame, reply_col: str | None = None,
                   make_embedder: Callable = lambda: hashed_features, categories=CATEGORY_WORDS) -> DataFrame:
    """One wide row per message ``msg_id, text`` (a number, a text): its route and what that handler finds.

    Columns of the other handlers stay NULL. ``prompt`` is what the handler asks
    the model; ``reply`` is a fixed answer that needs no model.
    """
    routed = routing.route(messages, reply_col=reply_col).select("msg_id", "text", "routing_decision")

    def of(route: str) -> DataFrame:
        return routed.filter(F.col("routing_decision") == route)

    asked = of("rag_review").select(F.col("msg_id").alias("query_id"), F.col("text").alias("question"))
    reviews = retrieval.search_reviews(index, asked, make_embedder).select(
        F.col("query_id").alias("msg_id"), F.col("question").alias("text"), F.lit("rag_review").alias("routing_decision"),
        trim_space(F.col("question")).alias("review_query"), F.col("context").alias("rag_context"), *FIGURES, "prompt", "reply")

    resolved = subjects.resolve_messages(of("subject_info"), catalogue, categories=categories)
    described = subjects.subject_prompts(resolved, catalogue).drop("subject_pos")

    # a label that is no route gets no prompt
    chat = routed.filter(~F.col("routing_decision").isin("rag_review", "subject_info")).withColumn(
        "prompt", F.when((F.col("routing_decision") == "chat") & (F.coalesce("text", F.lit("")) != ""), PROMPT_CHAT))
    return reviews.unionByName(described, allowMissingColumns=True).unionByName(chat, allowMissingColumns=True)


def answer_states(states: DataFrame, make_model: Callable[[], Callable[[str], str]], path: str | None = None) -> DataFrame:
    """The answer to each state: ``msg_id, text, routing_decision, result, said, error``.

    ``result`` is what is shown, ``said`` what goes into the history. A review
    answer is shown with its confidence note, and a failure with its reason. A
    chat answer is trimmed, and its failure is a fixed text and no error. Only
    these two kinds are said; a fixed reply and a subject answer are not. The model is
    asked once per distinct prompt; ``path`` is where its answers are kept for later calls.
    """
    states = stored(states, "states")
    answers = ask_once(states, lambda: one_by_one(make_model()), path=path)

    def of(route: str, fallback: str, **options) -> DataFrame:
        return retrieval.answer(states.filter(F.col("routing_decision") == route), make_model, fallback, answers=answers, **options)

    nothing = F.lit(None).cast("string")
    reviews = of("rag_review", REPLY_REVIEW_FAILED).select(
        "msg_id", "text", "routing_decision",
        F.coalesce("reply", retrieval.noted_result(F.col("result"), F.col("note"), F.col("error"))).alias("result"),
        F.col("result").alias("said"), "error")
    described = of("subject_info", REPLY_SUBJECT_FAILED.replace("{subject}", "{extracted_subject}"),
                   fallback_fields=("extracted_subject",)).select(
        "msg_id", "text", "routing_decision", "result", nothing.alias("said"), "error")
    chat = of("chat", REPLY_CHAT_FAILED, trim=True).select(
        "msg_id", "text", "routing_decision", "result", F.col("result").alias("said"), nothing.alias("error"))
    return reviews.unionByName(described).unionByName(chat)


def answered_history(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """The pairs of each conversation, then what was said in it, in order of ``turn``.

    ``answers`` holds ``conv_id, turn, text, said``; a conversation can have any
    number of answers, so they are counted in ranges of turns.
    """
    said = answers.filter(F.col("said").isNotNull()).select("conv_id", "turn", "text", "said")
    ends = pairs.groupBy("conv_id").agg(F.max("pair_no").alias("last_no"))
    numbered = drop_range(running_sum(said, ["conv_id"], "turn", F.lit(1).cast("long"), "n"))
    added = numbered.join(ends, "conv_id", "left").select(
        "conv_id", (F.coalesce("last_no", F.lit(0)) + F.col("n")).alias("pair_no"), F.col("text").alias("user"),
        F.col("said").alias("assistant"))
    return pairs.unionByName(added)
