"""Normalisation, counts and shingles of text as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What stands for a gap in an edition.
GAPS = r"\[[^\]]{0,40}\]|<[^>]{0,40}>|\{[^}]{0,40}\}|\.{2,}|-{2,}|\*{2,}|#{2,}|\?{2,}"
#: A text with a gap has one of these.
GAP_SIGNS = ("[", "<", "{", "..", "--", "**", "##", "??")
#: No gap looks further ahead than this, except for runs of one sign that vanish as a whole.
GAP_REACH = 42
BRACKETS = "(){}"
PUNCTUATION = r"(?U)[^\p{L}\p{N}_\s]"
# Code points that a line of a script may have, besides white space.
SCRIPTS = {"greek": r"Ͱ-Ͽἀ-῿̀-ͯ", "latin": r"A-Za-zÀ-ɏḀ-ỿ̀-ͯ"}


@cache
def _accents() -> tuple[str, str]:
    """Characters whose canonical decomposition without marks is one other character."""
    pairs = {}
    for i in range(0xC0, 0xFFFF):
        if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Mn":
            plain = "".join(c for c in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(c) != "Mn")
            if len(plain) == 1 and plain != chr(i):
                pairs[chr(i)] = plain
    return "".join(pairs), "".join(pairs.values())


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out a single time, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def strip_diacritics(text: Column, exact: bool = False) -> Column:
    """Decompose canonically and drop nonspacing marks.

    The native form leaves the few characters that decompose to several letters as they are;
    ``exact`` treats these too, in a vectorised function.
    """
    if exact:
        return _strip_exact(text)
    # A text of one-byte characters has none to strip.
    return once(text, lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(F.regexp_replace(F.translate(x, *_accents()), r"\p{Mn}+", "")))


@F.pandas_udf(StringType())
def _strip_exact(text: pd.Series) -> pd.Series:
    def strip(x: str | None) -> str | None:
        return None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")

    return text.map(strip)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, for which there is no native function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def squeeze(text: Column) -> Column:
    # Runs of white space become a space; single spaces are no matches, so most of a text is left alone.
    return F.trim(F.regexp_replace(text, r"(?U) \s+|[^\S ]\s*", " "))


def close_gaps(text: Column) -> Column:
    def close(x: Column) -> Column:
        signs = [F.contains(x, F.lit(c)) for c in GAP_SIGNS]
        return F.when(reduce(or_, signs), F.regexp_replace(x, GAPS, " ")).otherwise(x)

    return once(text, close)


def normalize_v1(text: Column, lowercase: bool = True, punctuation: bool = True, diacritics: bool = True) -> Column:
    """Of labelled corpora: brackets vanish, other punctuation becomes a space. Null is empty."""
    x = F.coalesce(text.cast("string"), F.lit(""))
    x = strip_diacritics(x) if diacritics else x
    x = F.lower(x) if lowercase else x
    if punctuation:
        x = F.regexp_replace(F.translate(x, BRACKETS, ""), PUNCTUATION, " ")
    return squeeze(x)


def normalize_v2(text: Column, lowercase: bool = True, punctuation: bool = True, diacritics: bool = True) -> Column:
    """Of whole corpora: gaps become a space before anything else."""
    x = close_gaps(F.coalesce(text.cast("string"), F.lit("")))
    x = strip_diacritics(x) if diacritics else x
    x = F.lower(x) if lowercase else x
    x = F.regexp_replace(x, PUNCTUATION, " ") if punctuation else x
    return squeeze(x)


def normalize_v3(text: Column, lowercase: bool = True, punctuation: bool = True, diacritics: bool = True) -> Column:
    """As v2, with compatibility composition after the gaps."""
    x = nfkc(close_gaps(F.coalesce(text.cast("string"), F.lit(""))))
    x = strip_diacritics(x) if diacritics else x
    x = F.lower(x) if lowercase else x
    x = F.regexp_replace(x, PUNCTUATION, " ") if punctuation else x
    return squeeze(x)


def word_count(text: Column) -> Column:
    """Number of parts between white space; of an empty text 0."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def is_script(text: Column, script: str) -> Column:
    """Not blank, at least three letters, and nothing but the script's code points and white space."""
    return text.rlike(rf"^[{SCRIPTS[script]}\s]+$") & (letters(text) >= 3)


def shingles(text: Column, k: int) -> Column:
    """Runs of ``k`` characters; a shorter text is one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))


def hash31(text: Column) -> Column:
    """31 bits of the MD5, which other engines can compute as well."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def hash32(*parts: Column | str | int) -> Column:
    """Seeded 32-bit hash of values, for draws that other engines can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])), 1, 8), 16, 10).cast("long")
