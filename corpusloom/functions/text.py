"""Text cleaning, splitting and statistics as column expressions.

All functions take and return columns; patterns stay ASCII (``\\s`` and ``\\b``) so that
they mean the same in other engines. Null in, null out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Literal replacements of the Unicode step, one for one and one for many.
ONE_FOR_ONE = ("\u2018\u2019\u201c\u201d\u00a0\u200b\ufeff", "''\"\" ")
ONE_FOR_MANY = (("–", "-"), ("—", "--"), ("…", "..."))

# Ordered repairs of extracted text.
ARTIFACTS = (
    (r"-\s*\n\s*", ""),
    (r"\s+([,.!?;:])", "$1"),
    (r"([.!?])[ \t]+([A-Z])", "$1 $2"),
    (r" {2,}", " "),
    (r"(?md)^\s*\d+\s*$", ""),
)
NOT_PLAIN = r"""[^a-zA-Z0-9\s.,!?;:()\-"'\n]"""


_SPACE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(c, F.lit(_SPACE))


def normalizer(form: str):
    """A vectorized Unicode normalization; ASCII texts come back as they are."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normalization form {form}")

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return run


def literal_replacements(c: Column) -> Column:
    c = F.translate(c, *ONE_FOR_ONE)
    for a, b in ONE_FOR_MANY:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fix_artifacts(c: Column) -> Column:
    for pattern, to in ARTIFACTS:
        c = F.regexp_replace(c, pattern, to)
    return c


def normalize_whitespace(c: Column, preserve_structure: bool = True) -> Column:
    if not preserve_structure:
        return strip(F.regexp_replace(c, r"\s+", " "))
    parts = F.transform(F.split(c, "\n\n"), lambda p: F.regexp_replace(strip(p), r"\s+", " "))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def remove_special_characters(c: Column) -> Column:
    return F.regexp_replace(c, NOT_PLAIN, "")


def final_cleanup(c: Column, preserve_structure: bool = True) -> Column:
    c = strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))
    if preserve_structure:
        return c
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), "\n")


def clean_text(
    c: Column, *, normalize_unicode: bool = True, remove_extra_whitespace: bool = True, remove_special_chars: bool = False, preserve_structure: bool = True
) -> Column:
    if normalize_unicode:
        c = literal_replacements(normalizer("NFC")(c))
    c = fix_artifacts(c)
    if remove_extra_whitespace:
        c = normalize_whitespace(c, preserve_structure)
    if remove_special_chars:
        c = remove_special_characters(c)
    return final_cleanup(c, preserve_structure)


def newline_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def cleaning_stats(before: Column, after: Column) -> dict[str, Column]:
    n, m = F.length(before), F.length(after)
    return {
        "original_length": n,
        "cleaned_length": m,
        "lines_removed": F.greatest(F.lit(0), newline_count(before) - newline_count(after)),
        "characters_removed": F.greatest(F.lit(0), n - m),
        "compression_ratio": F.round(F.when(n == 0, F.lit(1.0)).otherwise(m / n), 6),
    }


def sentences(c: Column, min_length: int = 10) -> Column:
    """Pieces between sentence ends, longer than ``min_length``."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) > min_length)


def paragraphs(c: Column, min_length: int = 20) -> Column:
    parts = F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: F.length(p) > min_length)
    return F.transform(parts, lambda p: F.regexp_replace(p, r"\n+", " "))


def tokens(c: Column) -> Column:
    """White-space tokens; none for a blank text."""
    return F.filter(F.split(strip(c), r"\s+"), lambda t: t != "")


def text_statistics(c: Column) -> dict[str, Column]:
    words, sents = F.size(tokens(c)), F.size(sentences(c))
    return {
        "characters": F.length(c),
        "words": words,
        "lines": newline_count(c) + 1,
        "paragraphs": F.size(F.filter(F.split(c, "\n\n"), lambda p: strip(p) != "")),
        "sentences": sents,
        "avg_words_per_sentence": F.when(sents > 0, F.round(words / sents, 2)).otherwise(F.lit(0.0)),
        "avg_chars_per_word": F.when(words > 0, F.round(F.length(c) / words, 2)).otherwise(F.lit(0.0)),
    }


def page_cleanup(c: Column) -> Column:
    """Lines stripped, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), "\n")


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def for_embedding(c: Column) -> Column:
    """White space collapsed; a blank text becomes a marker."""
    flat = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(flat == "", F.lit("[EMPTY]")).otherwise(flat)
