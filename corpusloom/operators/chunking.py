"""Chunkers and chunk metrics.

The fixed, sentence and recursive chunkers depend on the cut before, so each text is cut
in an Arrow batch; the token chunker has a closed form and stays in the JVM. Blank and
null texts give no chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.config import ChunkSettings, ConfigurationError, recommended
from corpusloom.functions.text import clean_text, strip, tokens
from corpusloom.runtime import spread

_CHUNKS = "chunk_index int, start_char int, end_char int, content string"
_SPACE = " \t\n\r\x0b\x0c"
_SENTENCE_GAP = re.compile(r"(?<=[.!?])[ \t\n\r\x0b\x0c]+(?=[A-Z])")


def fixed_windows(text: str, s: ChunkSettings, compat_tail: bool = False) -> list[tuple[int, int, str]]:
    """Windows of at most ``chunk_size`` characters that end at a space where there is one."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + s.chunk_size, n)
        if end < n and text[end] not in _SPACE:
            space = text.rfind(" ", start, end)
            if space > start:
                end = space
        content = text[start:end].strip(_SPACE)
        if len(content) >= s.min_chunk_size:
            out.append((start, end, content))
        if end == n and not compat_tail:
            break
        start = max(start + 1, end - s.chunk_overlap)
    return out


def sentence_groups(text: str, s: ChunkSettings) -> list[tuple[int, int, str]]:
    """Whole sentences up to ``chunk_size``; the last ones that fit ``chunk_overlap`` begin the next chunk."""
    found, at = [], 0
    for m in (*_SENTENCE_GAP.finditer(text), None):
        piece = text[at : m.start() if m else len(text)]
        bare = piece.strip(_SPACE)
        if len(bare) >= 10:
            found.append((at + len(piece) - len(piece.lstrip(_SPACE)), bare))
        at = m.end() if m else at
    out, i, length, first = [], 0, 0, 0
    for i, (_, bare) in enumerate(found):
        if i > first and length + len(bare) > s.chunk_size:
            out.append((first, i))
            keep, j = 0, i
            while j > first and keep + len(found[j - 1][1]) <= s.chunk_overlap:
                j -= 1
                keep += len(found[j][1])
            first, length = j, keep
        length += len(bare)
    if found:
        out.append((first, len(found)))
    chunks = []
    for a, b in out:
        content = " ".join(x for _, x in found[a:b])
        chunks.append((found[a][0], min(len(text), found[a][0] + len(content)), content))
    return chunks


def recursive_pieces(text: str, s: ChunkSettings, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[tuple[int, int, str]]:
    """Cut at the first separator that occurs, its parts cut at the next ones where too long, then merged up to the size with overlap."""

    def cut(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if b - a <= s.chunk_size:
            return [(a, b)]
        sep = next(((k, x) for k, x in enumerate(separators[level:], level) if x == "" or text.find(x, a, b) >= 0), (len(separators), ""))
        if sep[1] == "":
            return [(k, min(b, k + s.chunk_size)) for k in range(a, b, s.chunk_size)]
        parts, at = [], a
        while (hit := text.find(sep[1], at, b)) >= 0:
            parts.append((at, hit + len(sep[1])))
            at = hit + len(sep[1])
        if at < b:
            parts.append((at, b))
        return [y for x in parts for y in cut(*x, sep[0] + 1)]

    if not text.strip():
        return []
    parts, out, first = cut(0, len(text), 0), [], 0
    for k in range(len(parts)):
        if parts[k][1] - parts[first][0] > s.chunk_size:
            out.append((parts[first][0], parts[k - 1][1]))
            end = parts[k - 1][1]
            first = k
            while first > 0 and end - parts[first - 1][0] <= s.chunk_overlap and parts[k][1] - parts[first - 1][0] <= s.chunk_size:
                first -= 1
    out.append((parts[first][0], parts[-1][1]))
    return [(a, b, text[a:b]) for a, b in out]


def _chunker(cut: Callable[[str], list[tuple[int, int, str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and text.strip(_SPACE):
                    for k, (a, b, content) in enumerate(cut(text)):
                        ids.append(i)
                        rows.append((k, a, b, content))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *columns], ["id", "chunk_index", "start_char", "end_char", "content"])

    return run


def _chunks(texts: DataFrame, id_col: str, text_col: str, cut) -> DataFrame:
    kind = dict(texts.dtypes)[id_col]
    return spread(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(_chunker(cut), f"id {kind}, {_CHUNKS}")


def fixed_chunks(texts: DataFrame, s: ChunkSettings | None = None, *, id_col: str = "doc_id", text_col: str = "text", compat_tail: bool = False) -> DataFrame:
    s = s or ChunkSettings()
    return _chunks(texts, id_col, text_col, lambda t: fixed_windows(t, s, compat_tail))


def sentence_chunks(texts: DataFrame, s: ChunkSettings | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    s = s or ChunkSettings()
    return _chunks(texts, id_col, text_col, lambda t: sentence_groups(t, s))


def recursive_chunks(
    texts: DataFrame, s: ChunkSettings | None = None, *, separators: tuple[str, ...] = ("\n\n", "\n", " ", ""), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    s = s or ChunkSettings(1000, 100, 50)
    return _chunks(texts, id_col, text_col, lambda t: recursive_pieces(t, s, separators))


def token_chunks(texts: DataFrame, s: ChunkSettings | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of white-space tokens, as many as fill ``chunk_size`` characters on average; all in column expressions."""
    s = s or ChunkSettings()
    words = tokens(F.col(text_col))
    t = texts.select(F.col(id_col).alias("id"), words.alias("words"), F.length(text_col).alias("n")).where("size(words) > 0")
    count = F.size("words")
    average = F.col("n") / count
    t = t.withColumns({
        "target": F.greatest(F.lit(1), F.floor(s.chunk_size / average)).cast("int"),
        "back": F.floor(s.chunk_overlap / average).cast("int"),
    })
    step = F.greatest(F.lit(1), F.col("target") - F.col("back"))
    last = F.greatest(F.lit(0), F.ceil((count - F.col("target")) / F.col("step"))).cast("int")
    t = t.withColumn("step", step)

    def window(k: Column) -> Column:
        start = (k * F.col("step")).cast("int")
        return F.struct(
            start.alias("start_token"), F.least(count, start + F.col("target")).cast("int").alias("end_token"),
            F.array_join(F.slice("words", start + 1, F.col("target")), " ").alias("content"),
        )

    windows = F.filter(F.transform(F.sequence(F.lit(0), last), window), lambda w: F.length(w["content"]) >= s.min_chunk_size)
    return t.select("id", F.posexplode(windows).alias("chunk_index", "w")).select("id", "chunk_index", "w.start_token", "w.end_token", "w.content")


CHUNKERS = {"fixed": fixed_chunks, "sentence": sentence_chunks, "token": token_chunks, "recursive": recursive_chunks}


def chunker(name: str):
    if name not in CHUNKERS:
        raise ConfigurationError(f"no chunker {name}; there are {sorted(CHUNKERS)}")
    return CHUNKERS[name]


def recommended_chunks(texts: DataFrame, kind: str = "general", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks by the chunker and settings that suit a kind of document."""
    name, s = recommended(kind)
    return chunker(name)(texts, s, id_col=id_col, text_col=text_col)


def chunk_id(document: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%04d", document.cast("string"), index)


def with_overlaps(chunks: DataFrame) -> DataFrame:
    """Characters each chunk shares with the next one; null on the last."""
    w = W.partitionBy("id").orderBy("chunk_index")
    return chunks.withColumn("overlap_with_next", F.greatest(F.lit(0), F.col("end_char") - F.lead("start_char").over(w)))


_PAGES_A_BLOCK = 1024


def page_offsets(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, offset): how many chunks stand before a page, from (document_id, page_number, n).

    Pages are summed within blocks and blocks within documents, so that a document of very many pages is spread over tasks.
    """
    p = pages.withColumn("block", F.floor(F.col("page_number") / _PAGES_A_BLOCK))
    blocks = p.groupBy("document_id", "block").agg(F.sum("n").alias("m"))
    over = W.partitionBy("document_id").orderBy("block")
    before = blocks.select("document_id", "block", (F.sum("m").over(over) - F.col("m")).alias("before"))
    within = W.partitionBy("document_id", "block").orderBy("page_number")
    return (
        p.withColumn("inside", F.sum("n").over(within) - F.col("n")).join(before, ["document_id", "block"])
        .select("document_id", "page_number", (F.col("before") + F.col("inside")).alias("offset"))
    )


def with_global_index(chunks: DataFrame) -> DataFrame:
    """One running index over the pages of a document."""
    within = W.partitionBy("document_id", "page_number").orderBy("chunk_index", "id")
    counts = chunks.groupBy("document_id", "page_number").agg(F.count("*").alias("n"))
    placed = chunks.withColumn("_place", F.row_number().over(within) - 1).join(page_offsets(counts), ["document_id", "page_number"])
    return placed.withColumn("global_index", (F.col("offset") + F.col("_place")).cast("int")).drop("_place", "offset")


def page_chunks(
    pages: DataFrame, s: ChunkSettings | None = None, *, method: str = "recursive", clean: bool = True, extra: dict[str, Column] | None = None
) -> DataFrame:
    """The chunks of (document_id, page_number, text): pages in their order, blank ones skipped, with one index over the document.

    Each chunk has its id, its offsets in the (cleaned) page and ``source_info``: document, page and the entries of ``extra``. A page that comes
    more than once counts once, with its least text.
    """
    text = clean_text(F.col("text")) if clean else F.col("text")
    once = pages.where("document_id is not null and page_number is not null").groupBy("document_id", "page_number").agg(F.min("text").alias("text"))
    key = F.struct(F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number"))
    cut = chunker(method)(once.select(F.to_json(key).alias("key"), text.alias("text")).where(strip(F.col("text")) != ""), s, id_col="key", text_col="text")
    place = F.from_json("id", "document_id string, page_number int")
    flat = cut.select(place.alias("p"), "chunk_index", "start_char", "end_char", "content").select("p.*", "chunk_index", "start_char", "end_char", "content", F.lit("").alias("id"))
    numbered = with_global_index(flat)
    entries = {"document_id": F.col("document_id"), "page_number": F.col("page_number").cast("string"), **(extra or {})}
    return numbered.select(
        chunk_id(F.col("document_id"), F.col("global_index")).alias("id"), "document_id", "page_number", F.col("global_index").alias("chunk_index"),
        "start_char", "end_char", "content", F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]).alias("source_info"),
    )


def chunk_quality(c: Column, min_chunk_size: int = 100) -> Column:
    n, bare = F.length(c), strip(c)
    blank = (n - F.length(bare)) / n
    words = F.size(tokens(c))
    first, last = F.substring(bare, 1, 1), F.substring(bare, -1, 1)
    score = (
        F.lit(1.0)
        * F.when(n < min_chunk_size, 0.5).otherwise(1.0)
        * F.when(blank > 0.3, F.lit(1.0) - blank).otherwise(1.0)
        * F.when(c.rlike(r"[.!?]"), 1.1).otherwise(1.0)
        * F.when((words > 1) & first.rlike(r"[a-z]"), 0.9).otherwise(1.0)
        * F.when((words > 1) & last.rlike(r"[a-zA-Z]"), 0.9).otherwise(1.0)
    )
    return F.when(bare == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def validate_chunks(chunks: DataFrame, chunk_size: int = 1000, min_chunk_size: int = 50) -> DataFrame:
    """Counts, lengths and warnings over all chunks; valid without a warning."""
    n = F.length("content")
    out = chunks.agg(
        F.count("content").alias("chunks"), F.sum(n).alias("characters"), F.round(F.avg(n), 6).alias("avg_length"),
        F.min(n).alias("min_length"), F.max(n).alias("max_length"),
        F.count_if(n < min_chunk_size).alias("too_short"), F.count_if(n > 1.5 * chunk_size).alias("too_long"),
        F.count_if(strip(F.col("content")) == "").alias("blank"),
    )
    return out.withColumn("valid", (F.col("too_short") == 0) & (F.col("too_long") == 0) & (F.col("blank") == 0))
