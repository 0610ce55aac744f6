"""Porter stemming as one Spark column expression.

The steps are a chain of ``transform`` calls over a one-element array, so that
every step binds its input word once; a plain nesting of the steps would repeat
the whole previous step wherever the word is mentioned.

Stem each distinct word once (see ``operators.vocabulary``), not each occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix and replacement of the rule lists of Porter (1980), in
# the published order.  A rule without replacement removes its suffix.
STEP_1A = ["sses ss", "ies i", "ss ss", "s"]
STEP_2 = [
    "ational ate", "tional tion", "enci ence", "anci ance", "izer ize",
    "abli able", "alli al", "entli ent", "eli e", "ousli ous",
    "ization ize", "ation ate", "ator ate", "alism al", "iveness ive",
    "fulness ful", "ousness ous", "aliti al", "iviti ive", "biliti ble",
]
STEP_3 = ["icate ic", "ative", "alize al", "iciti ic", "ical ic", "ful", "ness"]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

# ``y`` is a vowel exactly when the letter after it is a consonant, so a run of
# y's alternates from its right end and a final y is a consonant.
VOWEL_Y = "y(?=(?:yy)*[^aeiouy])|y(?=y(?:yy)*(?:[aeiou]|$))"


def rule(text: str) -> tuple[str, str]:
    suffix, _, replacement = text.partition(" ")
    return suffix, replacement


def _plain(word: Column) -> Column:
    """``word`` with its vowel y's written as another vowel."""
    return F.regexp_replace(word, VOWEL_Y, "a")


def _measure(word: Column) -> Column:
    """Number of vowels that a consonant follows."""
    return F.regexp_count(_plain(word), F.lit("[aeiou][^aeiou]"))


def _has_vowel(word: Column) -> Column:
    return _plain(word).rlike("[aeiou]")


def _short_end(word: Column) -> Column:
    """Ends consonant, vowel, consonant, the vowel not being a y."""
    return _plain(word).rlike("[^aeiou][aeiou][^aeiou]$") & (F.substring(word, -2, 1) != "y")


def _trim(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def _first_rule(word: Column, rules: list[str], keep=None) -> Column:
    """Apply the first rule whose suffix fits and whose trimmed word passes ``keep``."""
    result = None
    for suffix, replacement in map(rule, rules):
        trimmed = _trim(word, len(suffix))
        fits = word.endswith(suffix)
        if keep is not None:
            fits = fits & keep(trimmed, suffix)
        value = F.concat(trimmed, F.lit(replacement)) if replacement else trimmed
        result = F.when(fits, value) if result is None else result.when(fits, value)
    return result.otherwise(word)


def _step_1b(word: Column) -> Column:
    """Drop ``ed``/``ing`` after a vowel; marks the cut with a trailing ``-``."""
    return _first_rule(word, ["ed -", "ing -"], lambda t, _: _has_vowel(t))


def _step_1b_repair(word: Column) -> Column:
    cut = _trim(word, 1)
    return (
        F.when(~word.endswith("-"), word)
        .when(cut.rlike("(?:at|bl|iz)$"), F.concat(cut, F.lit("e")))
        .when(cut.rlike(r"([^aeioulsz])\1$"), _trim(cut, 1))
        .when((_measure(cut) == 1) & _short_end(cut), F.concat(cut, F.lit("e")))
        .otherwise(cut)
    )


def _step_4_condition(trimmed: Column, suffix: str) -> Column:
    long_enough = _measure(trimmed) > 1
    return long_enough & trimmed.rlike("[st]$") if suffix == "ion" else long_enough


def _step_5a(word: Column) -> Column:
    trimmed = _trim(word, 1)
    m = _measure(trimmed)
    return F.when(
        word.endswith("e") & ((m > 1) | ((m == 1) & ~_short_end(trimmed))), trimmed
    ).otherwise(word)


_STEPS = [
    lambda w: _first_rule(w, STEP_1A),
    _step_1b,
    _step_1b_repair,
    lambda w: _first_rule(w, ["y i"], lambda t, _: _has_vowel(t)),
    lambda w: _first_rule(w, STEP_2, lambda t, _: _measure(t) > 0),
    lambda w: _first_rule(w, STEP_3, lambda t, _: _measure(t) > 0),
    lambda w: _first_rule(w, STEP_4, _step_4_condition),
    _step_5a,
    lambda w: F.when(w.endswith("ll") & (_measure(w) > 1), _trim(w, 1)).otherwise(w),
]


def _published_plain(word: Column) -> Column:
    """``word`` with its vowel y's written as another vowel, its other y's in upper case: here
    a y is a vowel exactly when the letter before it is a consonant (runs of up to four)."""
    for _ in range(2):
        word = F.regexp_replace(word, "(^|[aeiou])y", "$1Y")
        word = F.regexp_replace(word, "([^aeiouy])y", "$1a")
    return word


def _published_measure(word: Column) -> Column:
    return F.regexp_count(_published_plain(word), F.lit("[aeiou][^aeiou]"))


def _published_vowel(word: Column) -> Column:
    return _published_plain(word).rlike("[aeiou]")


def _published_short_end(word: Column) -> Column:
    """Ends consonant, vowel, consonant, the last not being w, x or y."""
    return _published_plain(word).rlike("[^aeiou][aeiou][^aeiouwxY]$")


def _longest_rule(word: Column, rules: list[str], keep) -> Column:
    """The rule of the longest suffix that fits, if its trimmed word passes ``keep``."""
    result = None
    for suffix, replacement in sorted(map(rule, rules), key=lambda r: -len(r[0])):
        trimmed = _trim(word, len(suffix))
        value = F.concat(trimmed, F.lit(replacement)) if replacement else trimmed
        outcome = F.when(keep(trimmed, suffix), value).otherwise(word)
        fits = word.endswith(suffix)
        result = F.when(fits, outcome) if result is None else result.when(fits, outcome)
    return result.otherwise(word)


def _published_1b(trimmed: Column, suffix: str) -> Column:
    return _published_measure(trimmed) > 0 if suffix == "eed" else _published_vowel(trimmed)


def _published_repair(word: Column) -> Column:
    cut = _trim(word, 1)
    return (
        F.when(~word.endswith("-"), word)
        .when(cut.rlike("(?:at|bl|iz)$"), F.concat(cut, F.lit("e")))
        .when(cut.rlike(r"([^aeioulsz])\1$"), _trim(cut, 1))
        .when((_published_measure(cut) == 1) & _published_short_end(cut), F.concat(cut, F.lit("e")))
        .otherwise(cut)
    )


def _published_4(trimmed: Column, suffix: str) -> Column:
    long_enough = _published_measure(trimmed) > 1
    return long_enough & trimmed.rlike("[st]$") if suffix == "ion" else long_enough


def _published_5a(word: Column) -> Column:
    trimmed = _trim(word, 1)
    m = _published_measure(trimmed)
    return F.when(
        word.endswith("e") & ((m > 1) | ((m == 1) & ~_published_short_end(trimmed))), trimmed
    ).otherwise(word)


_PUBLISHED_STEPS = [
    lambda w: _longest_rule(w, STEP_1A, lambda t, _: F.lit(True)),
    lambda w: _longest_rule(w, ["eed ee", "ed -", "ing -"], _published_1b),
    _published_repair,
    lambda w: _longest_rule(w, ["y i"], lambda t, _: _published_vowel(t)),
    lambda w: _longest_rule(w, STEP_2, lambda t, _: _published_measure(t) > 0),
    lambda w: _longest_rule(w, STEP_3, lambda t, _: _published_measure(t) > 0),
    lambda w: _longest_rule(w, STEP_4, _published_4),
    _published_5a,
    lambda w: F.when(w.endswith("ll") & (_published_measure(w) > 1), _trim(w, 1)).otherwise(w),
]

#: ``default`` reads y by the letter after it and falls through to shorter suffixes;
#: ``published`` is Porter (1980) to the letter.
VARIANTS = {"default": _STEPS, "published": _PUBLISHED_STEPS}


def stem_box(word: Column, variant: str = "default") -> Column:
    """One-element array with the stem.

    Explode it to stem a column: Catalyst neither copies a generator's input into
    later filters nor pushes such filters below it, so each word is stemmed once.
    """
    box = F.array(F.lower(word))
    for step in VARIANTS[variant]:
        box = F.transform(box, step)
    return box


def porter_stem(word: Column, variant: str = "default") -> Column:
    """The Porter stem of ``word`` in lower case."""
    return F.element_at(stem_box(word, variant), 1)
