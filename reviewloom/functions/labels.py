"""Column expressions for source strings, context entries and confidence labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reviewloom.fixed_values import CONFIDENCE_HIGH, CONFIDENCE_LOW, NOTE_HIGH, NOTE_LOW
from reviewloom.functions.text import shorten


def or_default(c: Column, default: str) -> Column:
    """Replace NULL and empty text."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def rating_suffix(rating: Column) -> Column:
    return F.when(rating.isNotNull(), F.concat(F.lit("|rating="), rating.cast("string"))).otherwise("")


def hit_source(meta: Column) -> Column:
    """``review|date[|rating=r][|platform]``; an unknown platform is left out."""
    platform = or_default(meta["platform"], "unknown")
    return F.concat(
        F.lit("review|"),
        or_default(meta["date"], ""),
        rating_suffix(meta["rating"]),
        F.when(platform != "unknown", F.concat(F.lit("|"), platform)).otherwise(""),
    )


def chunk_source(meta: Column) -> Column:
    """``platform|subject or place|date[|rating=r]``."""
    return F.concat(
        or_default(meta["platform"], "review"), F.lit("|"),
        F.coalesce(F.nullif(meta["subject"], F.lit("")), F.nullif(meta["place"], F.lit("")), F.lit("")), F.lit("|"),
        or_default(meta["date"], ""),
        rating_suffix(meta["rating"]),
    )


def hit_entry(content: Column, meta: Column, score: Column) -> Column:
    """One context entry with its source and score."""
    return F.concat(content, F.lit("\n(source: "), hit_source(meta), F.lit(", similarity: "),
                    F.format_number(score, 3), F.lit(")"))


def chunk_entry(content: Column, meta: Column) -> Column:
    return F.concat(F.lit("[Chunk]\n"), content, F.lit("\n(meta: source="), chunk_source(meta), F.lit(")"))


def reference_line(content: Column, meta: Column) -> Column:
    """One line of a reference list: cut text, platform, rating, date."""
    return F.concat(
        F.lit('   - "'), shorten(F.coalesce(content, F.lit(""))),
        F.lit('" (플랫폼: '), F.coalesce(meta["platform"], F.lit("")),
        F.lit(", 평점: "), F.coalesce(meta["rating"].cast("string"), F.lit("")),
        F.lit(", 날짜: "), F.coalesce(meta["date"], F.lit("")), F.lit(")"),
    )


def confidence(mean_score: Column) -> Column:
    return F.when(mean_score < CONFIDENCE_LOW, "low").when(mean_score > CONFIDENCE_HIGH, "high").otherwise("none")


def confidence_note(label: Column) -> Column:
    return F.when(label == "low", NOTE_LOW).when(label == "high", NOTE_HIGH).otherwise("")
