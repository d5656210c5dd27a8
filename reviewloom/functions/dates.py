"""Column expressions on dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reviewloom.fixed_values import DATE_LABEL, DATE_PATTERNS
from reviewloom.functions.text import trim_space


def parse_date(c: Column) -> Column:
    """Timestamp from ISO text or one of the sites' own forms; NULL if none fits."""
    text = trim_space(c)
    forms = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS]
    return F.coalesce(*forms)


def normalise_labelled_date(c: Column) -> Column:
    """``label: 2024year 5month 3day`` to ``2024.05.03``; any other text stays as it is."""
    bare = trim_space(F.replace(c, F.lit(DATE_LABEL + ":"), F.lit("")))
    parsed = F.date_format(F.try_to_timestamp(bare, F.lit(DATE_PATTERNS[-1])), "yyyy.MM.dd")
    return F.when(c.contains(DATE_LABEL), F.coalesce(parsed, c)).otherwise(c)


def weekday_name(ts: Column) -> Column:
    """English day name such as ``Friday``."""
    return F.date_format(ts, "EEEE")
