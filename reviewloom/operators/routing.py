"""Which of the three handlers a message goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.fixed_values import INFO_WORDS, PROMPT_CHAT, PROMPT_INTENT, REVIEW_WORDS, ROUTES
from reviewloom.functions.text import contains_any, fill_template, is_blank, trim_space


def keyword_route(text: Column, review_words=REVIEW_WORDS, info_words=INFO_WORDS) -> Column:
    """Review words are tested before info words; neither means ``chat``."""
    return (F.when(contains_any(text, review_words), "rag_review")
            .when(contains_any(text, info_words), "subject_info").otherwise("chat"))


def reply_route(reply: Column) -> Column:
    """``intent`` of a JSON object reply, ``chat`` if it has none, NULL if the reply is not such JSON."""
    parsed = F.try_parse_json(reply)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    intent = F.try_variant_get(parsed, "$.intent", "string")
    return F.when(is_object, F.coalesce(intent, F.lit("chat")))


def route(messages: DataFrame, text_col: str = "text", reply_col: str | None = None,
          review_words=REVIEW_WORDS, info_words=INFO_WORDS) -> DataFrame:
    """Add ``routing_decision`` and whether it is one of the known labels."""
    trimmed = messages.withColumn("__text", trim_space(F.coalesce(text_col, F.lit(""))))
    words = keyword_route(F.col("__text"), review_words, info_words)
    chosen = F.coalesce(reply_route(F.col(reply_col)), words) if reply_col else words
    decided = trimmed.withColumn(
        "routing_decision", F.when(F.col("__text") == "", "chat").otherwise(chosen)).drop("__text")
    return decided.withColumn("known_route", F.col("routing_decision").isin(*ROUTES))


def intent_prompts(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Classifier prompt of every message that is not blank."""
    prompt = fill_template(PROMPT_INTENT, user_message=trim_space(F.col(text_col)))
    return messages.filter(~is_blank(F.col(text_col))).withColumn("prompt", prompt)


def chat_prompts(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Free-chat prompt; its template takes neither message nor history."""
    said = F.coalesce(F.col(text_col), F.lit("")) != ""
    return messages.filter(said).withColumn("prompt", F.lit(PROMPT_CHAT))
