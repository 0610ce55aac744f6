"""Column expressions for turning text into words.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word, and which words survive cleaning.
WORD_BREAK = "[^a-zA-Z]+"
ABBREVIATION_OR_WORD = r"(?:[a-zA-Z]\.){2,}|[a-zA-Z]+"
MAX_TOKEN_LENGTH = 32
MIN_STEM_LENGTH = 3
MAX_STEM_LENGTH = 14


def words(text: Column) -> Column:
    """Array of the ASCII words of ``text``; may hold an empty string at either end."""
    return F.split(text, WORD_BREAK)


def words_and_abbreviations(text: Column) -> Column:
    """Array of words, keeping abbreviations such as ``U.S.A.`` in one piece."""
    return F.regexp_extract_all(text, F.lit(ABBREVIATION_OR_WORD), F.lit(0))


def token_length_ok(token: Column) -> Column:
    return F.length(token) <= MAX_TOKEN_LENGTH


def stem_length_ok(stem: Column) -> Column:
    return F.length(stem).between(MIN_STEM_LENGTH, MAX_STEM_LENGTH)
