"""Whitespace, tokens and word counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java character class body.
WHITESPACE_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
CONTROL_PATTERN = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
TOKENS_PER_WORD_DIVISOR = 0.75


def strip(value: Column) -> Column:
    """Remove leading and trailing white space of any kind (plain ``trim`` removes spaces only)."""
    return F.btrim(value, F.lit(WHITESPACE))


def blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def words(value: Column) -> Column:
    """Words of a text as an array; empty for null or blank text."""
    stripped = strip(F.coalesce(value, F.lit("")))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, f"[{WHITESPACE_CLASS}]+")
    )


def word_count(value: Column) -> Column:
    return F.size(words(value))


def collapse_whitespace(value: Column) -> Column:
    return strip(F.regexp_replace(value, f"[{WHITESPACE_CLASS}]+", " "))


def approx_tokens(n_words: Column) -> Column:
    """Estimated model tokens for a number of words."""
    return F.ceil(n_words / F.lit(TOKENS_PER_WORD_DIVISOR))


def alnum_runs(value: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def token_bag(value: Column) -> Column:
    """Runs longer than one character, repeats kept."""
    return F.filter(alnum_runs(value), lambda t: F.length(t) > 1)


def token_set(value: Column) -> Column:
    """Distinct runs longer than one character."""
    return F.array_distinct(token_bag(value))


def is_clean_value(value: Column) -> Column:
    """Present, not empty, no surrounding white space, no control characters."""
    return F.coalesce(
        (value != "") & (value == strip(value)) & ~value.rlike(CONTROL_PATTERN), F.lit(False)
    )


def number_text(value: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(
        F.format_string("%.2f", value)
    )


def any_word_in(value: Column, markers: list[str]) -> Column:
    """True when the text contains any of a short fixed list of markers."""
    found = F.lit(False)
    for marker in markers:
        found = found | value.contains(marker)
    return found
