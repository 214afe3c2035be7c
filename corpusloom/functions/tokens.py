"""Token normalization and token metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.preprocess import remove_accents
from corpusloom.functions.text import normalizer, strip, tokens


def smart_lowercase_tokens(c: Column) -> Column:
    """Lower case but for capitals of two letters or more and for capitalised words after the first."""

    def one(w: Column, i: Column) -> Column:
        keep = w.rlike(r"^\p{Lu}{2,}$") | (w.rlike(r"^\p{Lu}") & (i > 0))
        return F.when(keep, w).otherwise(F.lower(w))

    return F.array_join(F.transform(tokens(c), one), " ")


def normalize_tokens(
    c: Column, *, unicode_form: str | None = None, accents: bool = False, lower: bool = True, smart_case: bool = False,
    remove_punctuation: bool = False, remove_digits: bool = False,
) -> Column:
    """Unicode form, accents, case, punctuation and digits as asked for, in this order; then white space as single spaces."""
    if unicode_form:
        c = normalizer(unicode_form)(c)
    if accents:
        c = remove_accents(c)
    if lower:
        c = smart_lowercase_tokens(c) if smart_case else F.lower(c)
    if remove_punctuation:
        c = F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " ")
    if remove_digits:
        c = F.regexp_replace(c, r"\d+", "")
    return strip(F.regexp_replace(c, r"\s+", " "))


def compression_ratio(token_count: Column, char_count: Column) -> Column:
    return F.when(char_count > 0, token_count / char_count).otherwise(F.lit(0.0))


def subword_ratio(words: Column) -> Column:
    parts = F.size(F.filter(words, lambda t: t.startswith("##") | t.startswith("▁") | t.startswith("Ġ")))
    return F.when(F.size(words) > 0, parts / F.size(words)).otherwise(F.lit(0.0))


def exploded(texts: DataFrame, text_col: str) -> DataFrame:
    return texts.select(F.explode(tokens(F.col(text_col))).alias("token"))


def token_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return exploded(texts, text_col).groupBy("token").agg(F.count("*").alias("n"))


def token_distribution(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Totals and length statistics of all tokens, from the counts of lengths."""
    counts = token_counts(texts, text_col)
    size = F.length("token")
    per_length = counts.groupBy(size.alias("len")).agg(F.sum("n").alias("n"), F.count("*").alias("unique_n"))
    return per_length.agg(
        F.sum("n").alias("total_tokens"),
        F.sum("unique_n").alias("unique_tokens"),
        F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 6).alias("mean_length"),
        F.round(F.percentile("len", 0.5, F.col("n")), 6).alias("median_length"),
        F.max("len").alias("max_length"),
        F.min("len").alias("min_length"),
        F.round(
            F.sqrt(F.sum(F.col("len") * F.col("len") * F.col("n")) / F.sum("n") - F.pow(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 2)), 6
        ).alias("std_length"),
    )


def top_tokens(texts: DataFrame, k: int = 10, text_col: str = "text") -> DataFrame:
    """The most frequent tokens; ties go by token."""
    best = token_counts(texts, text_col).orderBy(F.desc("n"), "token").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "token")))  # k rows


def oov_ratio(texts: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """Tokens, tokens outside the vocabulary (distinct ``token``), and their ratio."""
    counts = token_counts(texts, text_col)
    known = vocabulary.select("token").distinct().withColumn("known", F.lit(1))
    return counts.join(known, "token", "left").agg(
        F.sum("n").alias("tokens"),
        F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("unknown"),
        F.round(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("oov_ratio"),
    )
