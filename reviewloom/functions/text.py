"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as Python's str methods see it: Java's Unicode \s lacks U+001C..U+001F.
SPACE = r"\s\x1c-\x1f"
# Python's \w is letters, numbers of every kind, and the underscore.
_NOT_WORD_OR_SPACE = rf"(?U)[^\p{{L}}\p{{N}}_{SPACE}]+|\n"
_OUTER_SPACE = rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z"
_SPACES = rf"(?U)[{SPACE}]+"


def strip_specials(c: Column) -> Column:
    """Keep word characters and whitespace, but no line feed."""
    return F.regexp_replace(c, _NOT_WORD_OR_SPACE, "")


def trim_space(c: Column) -> Column:
    """Trim every kind of whitespace; Spark's ``trim`` strips U+0020 only."""
    return F.regexp_replace(c, _OUTER_SPACE, "")


def split_words(c: Column) -> Column:
    """Whitespace-separated words, none of them empty."""
    return F.filter(F.split(c, _SPACES), lambda w: w != "")


def tokens(c: Column, limit: int) -> Column:
    """The first ``limit`` words; NULL text has no tokens."""
    return F.coalesce(F.slice(split_words(c), 1, limit), F.array().cast("array<string>"))


def contains_any(c: Column, words) -> Column:
    """True where the lower-cased text holds one of the words as a substring.

    One pattern for all words, so the text is lower-cased and read once.
    """
    return F.lower(c).rlike("|".join(quoted(w.lower()) for w in words)) if words else F.lit(False)


def quoted(word: str) -> str:
    """A word as a literal pattern."""
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def is_blank(c: Column) -> Column:
    return trim_space(F.coalesce(c, F.lit(""))) == ""


def shorten(c: Column, limit: int = 40) -> Column:
    """One line of at most ``limit`` characters, marked when it was cut."""
    line = F.replace(trim_space(c), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("..."))).otherwise(line)


def fill_template(template: str, **values: Column) -> Column:
    """Concatenate a template's literal parts with columns for its {names}.

    A value that itself holds ``{name}`` is never substituted again.
    """
    parts, rest = [], template
    while rest:
        spots = [(rest.find("{" + name + "}"), name) for name in values]
        spots = [s for s in spots if s[0] >= 0]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, name = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name], F.lit("")))
        rest = rest[at + len(name) + 2:]
    return F.concat(*parts)
