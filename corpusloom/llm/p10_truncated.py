"""Problem 10: text cut off by field limits.

Method: per source, column and measure (characters, bytes, and both without a mark of the
cut), a histogram of the lengths of different texts without terminal punctuation. A length is a limit of that source
if it holds more texts than chance gives to one of so many lengths: the lengths of about the same
size say how many to expect, Chernoff's bound how likely more are, and the number of lengths tested is
allowed for. The texts at a limit are cut. Cuts in transfer fall at any length, so the
last line is judged as well, and reported apart: prose without its end, a line ending in a function word or in a broken
word, an unfinished entry in a list of sentences, or an open end before a blank is cut; a closing line that
other documents share, a title, a table row or a list entry is complete.

Scale: one map reduces each text without terminal punctuation to its lengths, its last words and what
its last line looks like; texts aren't shuffled. A second map counts, within the tasks first, how often
these last words stand elsewhere, as words, as first words of blocks and as beginnings of
longer blocks. The words looked for go to the tasks if they are few, else all are counted and the join selects.
Every document looks its words up as rows of (kind, word), so that documents without one take no part and a word that
ends many is met by unique counts.

Defined results: null and blank texts aren't cut; a null source is a source of its
own; repeated rows give one result; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import broadcast_if_small, checkpoint, collect_small, spread

_BLANKS = " \t\r\n\u00a0"
_MARK = re.compile(r"\s*(?:\.\.\.|\u2026|\[(?:\.\.\.|\u2026)\]|\((?:more|continued|cont\.?)\)|\[(?:more|truncated|cut)\]|<truncated>|\ufffd)$")
_TERMINAL = re.compile("[.!?\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\\]]*$")
_MARKER = re.compile(r"\s*(?:[-*\u2022\u25aa\u2013\u2014\u00b7+]|\d+[.)]|\[\d+\]|[a-z]\))\s+")
_BUILT = re.compile(
    r"\t|\||;\S|\S {3,}\S|^ {2,}|[{}<=\\]|\S>|\(.*\):|^\d{4}-\d{2}-\d{2}|\u00bb|^[\w.-]{2,}:(?:\s|$)|^--|^#|,(?:[\w./-]*[A-Za-z][\w./-]*|-)(?:,|$)|(?:,[\w./-]+){2,}$|^\S*/\S*$|\.{4,}",
    re.A,
)
_FEW_WORDS = 6
_TAIL = 40  # characters looked at for a mark or an end
_COUNT_AT = 300_000
_SOUGHT = 200_000  # words that go to the tasks
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS = re.compile("(?:[^\\W\\d_]|[\u0300-\u036f'\u2019])+")
_LAST_WORD = re.compile("(?:^|[\\s'\u2019\u201c(])([^\\W\\d_]+)$")
_DIGITS = re.compile(r"\d+")
_BLANK = re.compile(r"\n\s*\n")


def core_of(text: str) -> tuple[str, str]:
    """A text without blanks at its end, and also without a mark of a cut."""
    trimmed = text.rstrip(_BLANKS)
    return trimmed, trimmed[:-_TAIL] + _MARK.sub("", trimmed[-_TAIL:])


def masked(words: list[str]) -> str:
    """Digits as 0 and the first of several words as X: closing lines differ only there."""
    out = [_DIGITS.sub("0", w) for w in words]
    return " ".join(["X", *out[1:]] if len(out) > 1 else out)


_LENGTHS = ("chars", "bytes", "chars without mark", "bytes without mark")
_FLAGS = ("marked", "blank_after", "short", "built", "title", "upper", "wordy", "dangling", "unfinished")
_KEYS = ("tail", "first", "line", "mask")  # what is looked up


def _ending(text: str, trimmed: str, core: str, function: frozenset[str]) -> tuple:
    """Lengths, flags and words of an open end."""
    at = core.rfind("\n")
    line = core[at + 1 :]
    before = core[core.rfind("\n", 0, max(0, at)) + 1 : at] if at >= 0 else ""
    block = _BLANK.split(core)[-1].split()
    words = _WORDS.findall(" ".join(block))
    n = len(words)
    last = _LAST_WORD.search(line)
    tail = last.group(1) if last and last.group(1)[0].islower() else None
    listed = bool(_MARKER.match(line))
    whole = " ".join(block)
    short = len(block) <= _FEW_WORDS
    flags = (
        core != trimmed, text != trimmed, short and n <= _FEW_WORDS, listed or bool(_BUILT.search(line)),
        not any(w[0].islower() for w in words) and n <= 8, whole.upper() == whole and n > 8,
        any(w.lower() in function for w in words), tail is not None and tail.lower() in function,
        listed and bool(_MARKER.match(before)) and bool(_TERMINAL.search(before)),
    )
    lengths = (len(text), len(text.encode("utf-8", "surrogatepass")), len(core), len(core.encode("utf-8", "surrogatepass")))
    keys = (tail, block[0] if block else None, whole if short else None, masked(block) if short else None)
    return (xxhash.xxh3_64_intdigest(core) >> 1, *lengths, *flags, *keys)


def open_ends(texts: DataFrame, function_words: frozenset[str]) -> DataFrame:
    """(id, source, column, look, lengths, flags, keys) of the texts without terminal punctuation, from (id, source, column, text)."""
    kinds = [pa.int64()] * (1 + len(_LENGTHS)) + [pa.bool_()] * len(_FLAGS) + [pa.string()] * len(_KEYS)
    names = ["look", *[f"m{k}" for k in range(len(_LENGTHS))], *_FLAGS, *_KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for k, text in enumerate(batch.column(3).to_pylist()):
                if text and text.strip():
                    trimmed, core = core_of(text)
                    if not _TERMINAL.search(core[-_TAIL:]):
                        kept.append(k)
                        rows.append(_ending(text, trimmed, core, function_words))
            columns = list(zip(*rows)) or [()] * len(names)
            place = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(place) for c in range(3)], *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["id", "source", "column", *names]
            )

    schema = f"id {dict(texts.dtypes)['id']}, source string, column string, look bigint, " + ", ".join(
        [*[f"m{k} bigint" for k in range(len(_LENGTHS))], *[f"{f} boolean" for f in _FLAGS], *[f"{k} string" for k in _KEYS]]
    )
    return spread(texts).mapInArrow(run, schema).dropDuplicates(["id", "column"])


def limits(ends: DataFrame, chance: float) -> DataFrame:
    """(source, column, measure, at) of the lengths that hold more different texts than chance gives to any."""
    measures = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(f"m{k}").alias("at")) for k, name in enumerate(_LENGTHS)]))
    sizes = ends.select("source", "column", "look", measures.alias("m")).select("source", "column", "look", "m.measure", "m.at").distinct()
    of = ["source", "column", "measure"]
    counted = sizes.groupBy(*of, "at").agg(F.count("*").alias("n"))
    # lengths of about the same size: a quarter of the octave, less the length itself
    band = F.floor(F.log(F.greatest(F.col("at"), F.lit(2))) / F.log(F.lit(1.25)))
    wide = F.greatest(F.lit(1.0), 0.25 * F.pow(F.lit(1.25), F.col("band")))
    by_band = counted.groupBy(*of, band.alias("band")).agg(F.sum("n").alias("all"), F.count("*").alias("lengths"))
    tests = by_band.groupBy(*of).agg(F.sum("lengths").alias("tests"))
    n = F.col("n")
    expected = (F.col("all") - n + 1) / wide
    surprise = n * F.log(n / expected) - n + expected  # -log of the bound on the chance of n or more
    return (
        counted.withColumn("band", band).join(broadcast_if_small(by_band), [*of, "band"]).join(broadcast_if_small(tests), of)
        .where((n > expected) & (surprise > F.log(F.col("tests") / F.lit(chance))))
        .select(*of, "at")
    )


def _elsewhere(sought: dict[str, set[str]] | None):
    """Counts of what texts hold, as (kind, key, n): words before their last one, first words of blocks of some length, and beginnings of longer blocks."""
    wanted = sought or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = {}
        tails, firsts, lines, masks = (wanted.get(k) for k in _KEYS)

        def add(kind: str, key: str) -> None:
            counts[kind, key] = counts.get((kind, key), 0) + 1

        def flush() -> pa.RecordBatch:
            kinds, keys = zip(*counts) if counts else ((), ())
            batch = pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(list(counts.values()), pa.int64())], ["kind", "key", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                core = core_of(text)[1]
                words = _LETTERS.findall(core)
                if words and core.endswith(words[-1]):
                    words.pop()
                for w in set(words) if tails is None else tails.intersection(words):
                    counts["tail", w] = 1
                for block in _BLANK.split(core):
                    ws = block.split(maxsplit=_FEW_WORDS + 1)
                    if len(ws) > _FEW_WORDS and (firsts is None or ws[0] in firsts):
                        add("first", ws[0])
                    for k in range(1, min(len(ws), _FEW_WORDS + 1)):
                        start = " ".join(ws[:k])
                        if lines is None or start in lines:
                            add("line", start)
                        if masks is None or (mask := masked(ws[:k])) in masks:
                            add("mask", masked(ws[:k]) if masks is None else mask)
            if len(counts) > _COUNT_AT:
                yield flush()
        yield flush()

    return run


def _looked_up(ends: DataFrame) -> DataFrame:
    """(id, column, kind, key) of what each end looks up."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in _KEYS])
    return ends.select("id", "column", "look", F.explode(F.filter(pairs, lambda x: x["key"].isNotNull())).alias("p")).select("id", "column", "look", "p.kind", "p.key")


def truncated(
    records: DataFrame,
    function_words: DataFrame,
    *,
    id_col: str = "doc_id",
    text_cols: tuple[str, ...] = ("text",),
    source_col: str = "source",
    chance: float = 1e-3,
    opening: float = 3.0,
) -> DataFrame:
    """(id, column, source, at_limit, why) of the cut texts; ``at_limit`` are those found by the histograms, the others by their last line.

    ``chance``: how likely a source without limits may have one found; ``opening``: how many times
    more blocks than ends a word begins that opens sentences.
    """
    column = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in text_cols])).alias("c")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("(none)")).alias("source")
    texts = records.select(F.col(id_col).alias("id"), source, column).select("id", "source", "c.column", "c.text").where(F.col("text").rlike(r"\S"))
    common = frozenset(r.word for r in collect_small(function_words.select("word").where("word is not null").distinct(), 10_000))
    ends = checkpoint(open_ends(texts, common))
    found = limits(ends, chance)
    measures = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(f"m{k}").alias("at")) for k, name in enumerate(_LENGTHS)]))
    at_limit = checkpoint(
        ends.select("id", "column", "source", measures.alias("m")).select("id", "column", "source", "m.measure", "m.at")
        .join(broadcast_if_small(checkpoint(found)), ["source", "column", "measure", "at"])
        .select("id", "column").distinct().withColumn("at_limit", F.lit(True))
    )
    looked = checkpoint(_looked_up(ends).join(broadcast_if_small(at_limit), ["id", "column"], "left"))
    # how many different texts end so, and how many of them off the limits
    free = F.count_distinct(F.when(F.col("at_limit").isNull(), F.col("look")))
    ending = checkpoint(looked.groupBy("kind", "key").agg(F.count_distinct("look").alias("ends"), free.alias("free")))
    sought = ending.select("kind", "key").limit(_SOUGHT + 1).collect()
    wanted = {k: {r.key for r in sought if r.kind == k} for k in _KEYS} if len(sought) <= _SOUGHT else None
    elsewhere = spread(texts.select("text")).mapInArrow(_elsewhere(wanted), "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    known = checkpoint(ending.join(elsewhere, ["kind", "key"], "left").select("kind", "key", "ends", "free", F.coalesce("n", F.lit(0)).alias("n")))

    def of(kind: str, found: Column, name: str = "is") -> Column:
        return F.max(F.when(F.col("kind") == kind, found)).alias(f"{name}_{kind}")

    shared = (F.col("ends") >= 2) & (F.col("ends") >= F.col("n"))
    at_any_length = (F.col("free") >= 2) & (2 * F.col("free") > F.col("ends")) & (F.col("free") >= F.col("n"))
    per = (
        looked.join(broadcast_if_small(known), ["kind", "key"]).groupBy("id", "column")
        .agg(of("tail", F.col("n") > 0), of("first", F.col("n") > opening * F.col("ends")), of("line", shared), of("mask", shared),
             of("line", at_any_length, "free"), of("mask", at_any_length, "free"))
    )
    judged = ends.join(per, ["id", "column"], "left").join(at_limit, ["id", "column"], "left")
    yes = {k: F.coalesce(F.col(f"is_{k}"), F.lit(False)) for k in _KEYS}
    # a closing line that mostly ends texts off the limits is whole where it meets one
    whole = F.col("short") & (F.coalesce("free_line", F.lit(False)) | F.coalesce("free_mask", F.lit(False)))
    limit = F.coalesce("at_limit", F.lit(False)) & ~whole
    closing = F.col("short") & (yes["line"] | yes["mask"])
    title = F.col("title") & ~yes["first"]
    why = (
        F.when(F.col("marked"), "mark")
        .when(limit, "limit")
        .when(F.col("tail").isNotNull() & ~yes["tail"] & ~closing, "broken word")
        .when(F.col("dangling"), "function word")
        .when(F.col("unfinished"), "unfinished entry")
        .when(F.col("blank_after") & ~closing, "blank after an open end")
        .when(~F.col("built") & ~closing & ~title & (F.col("wordy") | F.col("upper") | yes["first"]), "prose")
    )
    return judged.select("id", "column", "source", limit.alias("at_limit"), why.alias("why")).where("why is not null")


def truncation_report(records: DataFrame, found: DataFrame, *, source_col: str = "source") -> DataFrame:
    """Per source: texts, cut texts and their share; those at a limit and those told by their last line only, apart."""
    per = records.select(F.coalesce(F.col(source_col).cast("string"), F.lit("(none)")).alias("source")).groupBy("source").agg(F.count("*").alias("texts"))
    cut = found.groupBy("source").agg(
        F.count_distinct("id").alias("cut"), F.count_distinct(F.when(F.col("at_limit"), F.col("id"))).alias("cut_at_limit")
    )
    none = F.lit(0)
    return per.join(cut, "source", "left").select(
        "source", "texts", F.coalesce("cut", none).alias("cut"), F.coalesce("cut_at_limit", none).alias("cut_at_limit"),
        (F.coalesce("cut", none) - F.coalesce("cut_at_limit", none)).alias("cut_by_last_line"), F.round(F.coalesce("cut", none) / F.col("texts"), 6).alias("share"),
    )
