"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import p01_near_duplicates as p01
from corpusloom.llm import p02_split_oversized as p02
from corpusloom.llm import p03_quality as p03
from corpusloom.llm import p04_lookalikes as p04
from corpusloom.llm import p05_language as p05
from corpusloom.llm import p06_encoding as p06
from corpusloom.llm import p07_scan_noise as p07
from corpusloom.llm import p08_packing as p08
from corpusloom.llm import p09_leakage as p09
from corpusloom.llm import p10_truncated as p10
from corpusloom.runtime import checkpoint, collect_small, table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    members, links = p01.near_duplicates(
        table(spark, base, "text_chunks"), width=3, threshold=0.6, min_words=20, rows=5, bands=42
    )
    return p01.duplicate_pairs(members, links)


def p1_groups(spark: SparkSession, base: str) -> DataFrame:
    members, links = p01.near_duplicates(table(spark, base, "text_chunks"))
    return p01.duplicate_groups(members, checkpoint(links))


def _limited(spark: SparkSession, base: str) -> DataFrame:
    return p02.with_limits(table(spark, base, "text_chunks"), table(spark, base, "text_processing_configs"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return p02.split_oversized(_limited(spark, base)).select("id").distinct()


def p2_pieces(spark: SparkSession, base: str) -> DataFrame:
    return p02.all_pieces(_limited(spark, base))


def _measured(spark: SparkSession, base: str) -> DataFrame:
    return p03.measured_texts(table(spark, base, "text_chunks"), table(spark, base, "common_words"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return p03.not_prose(_measured(spark, base))


def p3_statistics(spark: SparkSession, base: str) -> DataFrame:
    return _measured(spark, base)


def p3_documents(spark: SparkSession, base: str) -> DataFrame:
    return p03.document_statistics(_measured(spark, base))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return p04.lookalike_pairs(p04.look_groups(table(spark, base, "text_chunks")))


def p4_classes(spark: SparkSession, base: str) -> DataFrame:
    return p04.look_classes(p04.look_groups(table(spark, base, "text_chunks")))


def p4_forms(spark: SparkSession, base: str) -> DataFrame:
    """Every text once for each normalization that the configs name."""
    named = table(spark, base, "preprocessing_configs").select("unicode_normalization").where("unicode_normalization is not null").distinct()
    forms = tuple(sorted(r[0] for r in collect_small(named, 4)))  # there are four
    return p04.consistent_forms(table(spark, base, "text_chunks"), forms=forms)


def _segments(spark: SparkSession, base: str) -> DataFrame:
    return p05.language_segments(table(spark, base, "preprocessing_results"), table(spark, base, "common_words"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    found = p05.mislabelled(table(spark, base, "preprocessing_results"), p05.text_languages(_segments(spark, base)))
    return found.select(F.col("id").alias("result_id"), "lang")


def p5_segments(spark: SparkSession, base: str) -> DataFrame:
    return _segments(spark, base).withColumnRenamed("id", "result_id")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    found = p06.restored_texts(table(spark, base, "preprocessing_results")).where("affected")
    return found.select(F.col("id").alias("result_id")).distinct()


def p6_restored(spark: SparkSession, base: str) -> DataFrame:
    return p06.restored_texts(table(spark, base, "preprocessing_results")).where("affected").withColumnRenamed("id", "result_id")


def _pages(spark: SparkSession, base: str) -> DataFrame:
    return p07.page_texts(table(spark, base, "preprocessing_results"), table(spark, base, "text_chunks"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    pages = _pages(spark, base)
    noise, _ = p07.page_noise(pages, p07.frequent_forms(pages.select("text")))
    return p07.noisy_pages(noise)


def p7_paragraphs(spark: SparkSession, base: str) -> DataFrame:
    pages = _pages(spark, base)
    known = p07.frequent_forms(pages.select("text"))
    noise, headers = p07.page_noise(pages, known)
    texts = checkpoint(p07.scanned_pages(pages, noise))
    known = p07.with_contexts(texts.select("text"), known, pages.select("text"))
    return p07.repaired_paragraphs(texts, checkpoint(headers), known)


def _packed(spark: SparkSession, base: str) -> DataFrame:
    return p08.packed(p08.token_counts(table(spark, base, "documents")), table(spark, base, "pack_limits"))


def p8_assignment(spark: SparkSession, base: str) -> DataFrame:
    return _packed(spark, base).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, base: str) -> DataFrame:
    return p08.fill_report(_packed(spark, base), table(spark, base, "pack_limits"))


def p9_passages(spark: SparkSession, base: str) -> DataFrame:
    return p09.leaked_passages(table(spark, base, "documents"), table(spark, base, "eval_items"), least=13)


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return (
        p9_passages(spark, base)
        .select(F.col("doc").cast("bigint").alias("doc_id"), F.col("item").cast("bigint").alias("item_id"))
        .distinct()
    )


def p9_clean(spark: SparkSession, base: str) -> DataFrame:
    """The documents that are left when those with passages are removed."""
    return p09.without_leaks(table(spark, base, "documents"), p9_passages(spark, base)).select("doc_id")


def _truncated(spark: SparkSession, base: str) -> DataFrame:
    return p10.truncated(table(spark, base, "documents"), table(spark, base, "common_words"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return _truncated(spark, base).select(F.col("id").alias("doc_id")).distinct()


def p10_report(spark: SparkSession, base: str) -> DataFrame:
    return p10.truncation_report(table(spark, base, "documents"), _truncated(spark, base))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        p1_found, p1_groups, p2_found, p2_pieces, p3_found, p3_statistics, p3_documents, p4_found, p4_classes, p4_forms, p5_found, p5_segments,
        p6_found, p6_restored, p7_found, p7_paragraphs, p8_assignment, p8_fill, p9_found, p9_passages, p9_clean, p10_found, p10_report,
    )
    return {f.__name__: f for f in found}


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_LEAKS = f"""
        WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items),
        dk AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13), ik AS (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM dk), ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM ik)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""

#: What SQL can say about whole tables; the other operators are tested against brute force and invariants.
_ORACLES = {
    "p1_found": f"""
        WITH t AS (SELECT DISTINCT id, {_WORDS.format('content')} AS w FROM text_chunks WHERE content IS NOT NULL),
        c AS (SELECT w, min(id) AS rep FROM t WHERE len(w) >= 20 GROUP BY w),
        m AS (SELECT t.id, c.rep FROM t JOIN c USING (w)),
        s AS (SELECT DISTINCT rep, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT rep, w, unnest(range(1, len(w) - 1)) AS k FROM c)),
        z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
        p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
        l AS (SELECT p.a, p.b FROM p JOIN z x ON x.rep = p.a JOIN z y ON y.rep = p.b WHERE common >= 0.6 * (x.n + y.n - common) - 1e-9),
        f AS (SELECT x.id AS i, y.id AS j FROM l JOIN m x ON x.rep = l.a JOIN m y ON y.rep = l.b
              UNION SELECT x.id, y.id FROM m x JOIN m y ON x.rep = y.rep AND x.id < y.id)
        SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM f
    """,
    "p2_found": """
        SELECT DISTINCT t.id FROM text_chunks t
        JOIN text_processing_configs c ON c.config_id = coalesce(t.config_id, 'default')
        WHERE length(t.content) > c.chunk_size
    """,
    "p9_found": _LEAKS,
    "p9_clean": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_LEAKS}))",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
