"""Page sources: files, page texts and their metadata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.runtime import spread

_ASCII_SPACE = " \t\n\x0b\f\r"
Extractor = Callable[[bytes], list[str | Exception]]


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def file_info(files: DataFrame) -> DataFrame:
    """Path, name, size and time of files, without the contents, which are not read."""
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size_bytes"), "modificationTime")


def has_header(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def file_errors(path: Column, size: Column, *, max_mb: int = 100, content: Column | None = None) -> Column:
    """What is wrong with a file: no path, another extension, empty or too large, or, where its content is given, without the header."""
    found = [
        F.when(path.isNull() | (strip(path) == ""), "no path"),
        F.when(~F.lower(path).endswith(".pdf"), "not a PDF file"),
        F.when(size <= 0, "empty file"),
        F.when(size > max_mb * 1024 * 1024, f"larger than {max_mb} MB"),
    ]
    if content is not None:
        found.append(F.when(~F.coalesce(has_header(content), F.lit(False)), "no PDF header"))
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def validated(files: DataFrame, *, max_mb: int = 100, with_content: bool = False) -> tuple[DataFrame, DataFrame]:
    """The files that can be read, and the others as (path, error), one row for each error: an input of many files goes on without them."""
    checked = files.withColumn("errors", file_errors(F.col("path"), F.col("length"), max_mb=max_mb, content=F.col("content") if with_content else None))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.select("path", F.explode("errors").alias("error"))


def valid_files(files: DataFrame, max_mb: int = 100) -> DataFrame:
    return validated(files, max_mb=max_mb)[0]


def extract_pages(files: DataFrame, extract: Extractor) -> DataFrame:
    """(document_id, page_number, text, error): a page that fails is empty and carries its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    pages = extract(content)
                except Exception as e:
                    pages = [e]
                for k, page in enumerate(pages, 1):
                    failed = isinstance(page, Exception)
                    out.append((name, k, "" if failed else page, str(page) if failed else None))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            columns = [pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["document_id", "page_number", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "document_id string, page_number int, text string, error string")


def text_pages(content: bytes) -> list[str | Exception]:
    """The extractor for plain text: form feeds part the pages."""
    return list(content.decode("utf-8", "replace").split("\f"))


def whole_texts(pages: DataFrame) -> DataFrame:
    """(document_id, text): the pages of each document in order, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def clean_metadata(metadata: Column) -> Column:
    """Keys in lower case, values stripped, blank ones dropped."""
    stripped = F.transform_values(metadata, lambda _, v: strip(v))
    kept = F.map_filter(stripped, lambda _, v: v.isNotNull() & (v != ""))
    return F.transform_keys(kept, lambda k, _: F.lower(k))


def document_metadata(metadata: Column, page_count: Column, content: Column) -> Column:
    """The cleaned entries of a document and what follows from it: pages, kind, version of the format and encryption."""
    head = F.decode(F.substring(content, 1, 8), "ISO-8859-1")
    derived = F.create_map(
        F.lit("page_count"), page_count.cast("string"), F.lit("is_pdf"), has_header(content).cast("string"),
        F.lit("pdf_version"), F.regexp_extract(head, r"%PDF-(\d\.\d)", 1), F.lit("is_encrypted"), F.contains(content, F.lit(b"/Encrypt")).cast("string"),
    )
    kept = F.map_filter(derived, lambda _, v: v.isNotNull() & (v != ""))
    return F.map_concat(F.map_filter(F.coalesce(clean_metadata(metadata), F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(kept), k)), kept)


def remove_running_lines(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = 3, min_lines: int = 10) -> DataFrame:
    """(id, text, lines_removed): texts without the short lines that occur ``threshold`` times or more in them.

    Texts of few lines stay, null texts are null; each row is a text of its own, so nothing is shuffled.
    """
    kind = dict(texts.dtypes)[id_col]

    def one(text: str | None) -> tuple[str | None, int]:
        lines = text.split("\n") if text else []
        if len(lines) < min_lines:
            return text, 0
        bare = [x.strip(_ASCII_SPACE) for x in lines]
        times = Counter(x for x in bare if x and len(x) < 100)
        kept = [x for x, b in zip(lines, bare) if times[b] < threshold]
        return "\n".join(kept), len(lines) - len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["id", "text", "lines_removed"]
            )

    return spread(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, text string, lines_removed bigint")
