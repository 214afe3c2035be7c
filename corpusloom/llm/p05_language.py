"""Problem 5: missing or wrong document language labels.

Method: rank-order profiles. A language's profile is its most frequent n-grams
(one to three characters, words padded) in the order of their frequency. A
sentence's own n-grams are ranked by frequency, and the sum of the differences of rank
(out-of-place distance) says how far it is from each profile; the nearest is its
language, and the lead over the second nearest its confidence. Texts garbled by a wrong
decoding are judged in their restored form.

Profiles are fitted on a bounded sample: of the labelled rows whose frequent words agree
with their label, ``sample_rows`` for each language, in the order of a hash of the id,
besides the frequent words themselves.

Scale: a map over the rows; the n-grams of all sentences of an Arrow batch are counted
and ranked together in flat arrays. Only the profiles (a few hundred n-grams for each
language) go to the tasks.

Defined results: null, blank and too short texts have no segment; a text without a
complete sentence is one segment; ties go to the first language by name;
repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.p06_encoding import restore
from corpusloom.runtime import collect_small, spread

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "ru")
PROFILE = 400
_SYMBOLS = 128
_SENTENCE = re.compile(r"[^.!?]*[.!?]+[\"'”’»)\]]*(?=\s|$)|[^.!?]*[.!?]+|[^.!?]+$", re.S)
_BREAK = re.compile(r"\n\s*\n")
_WORDS = re.compile(r"(?<![\w-])[^\W\d_]{2,}(?![\w-])")
_QUOTED = re.compile(r"[“\"«„][^“”\"«»\n]{0,60}[”\"»“]")


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, complete) of the sentences of a text; a blank line ends one, too."""
    out, at = [], 0
    for part in (*_BREAK.finditer(text), None):
        end = part.start() if part else len(text)
        for m in _SENTENCE.finditer(text, at, end):
            if m.end() > m.start():
                tail = m.group().rstrip("\"'”’»)] \n\t")
                out.append((m.start(), m.end(), tail[-1:] in ".!?" and tail != ""))
        at = part.end() if part else at
    merged: list[tuple[int, int, bool]] = []
    for s in out:  # a point within a word or number doesn't end a sentence
        if merged and merged[-1][1] == s[0] and not text[s[0] : s[0] + 1].isspace():
            merged[-1] = (merged[-1][0], s[1], s[2])
        else:
            merged.append(s)
    return merged


class Profiles:
    """Ranked n-grams of the languages as lookup tables over a small alphabet."""

    def __init__(self, counts: dict[str, Counter]):
        letters = Counter()
        for c in counts.values():
            for gram, n in c.items():
                for ch in gram.strip("_"):
                    letters[ch] += n
        self.languages = sorted(counts)
        self.symbol = np.zeros(0x501, np.int32)  # the last one stands for all beyond
        for k, (ch, _) in enumerate(letters.most_common(_SYMBOLS - 2)):
            if ord(ch) < 0x500:
                self.symbol[ord(ch)] = k + 1
        ranked = {}
        for lang in self.languages:
            top = sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:PROFILE]
            ranked[lang] = {g: r for r, (g, _) in enumerate(top)}
        grams = sorted({g for r in ranked.values() for g in r})
        self.rank = np.full((len(self.languages), len(grams)), PROFILE, np.float32)
        for j, lang in enumerate(self.languages):
            for g, r in ranked[lang].items():
                self.rank[j, grams.index(g)] = r
        self.tables = [np.full(_SYMBOLS**n, -1, np.min_scalar_type(-len(grams) - 1)) for n in (1, 2, 3)]
        for k, g in enumerate(grams):
            code = 0
            for ch in g:
                code = code * _SYMBOLS + (0 if ch == "_" else int(self.symbol[ord(ch)]) if ord(ch) < 0x500 else 0)
            self.tables[len(g) - 1][code] = k

    def distances(self, texts: list[str]) -> np.ndarray:
        """Mean out-of-place distance of each text's n-grams from each profile."""
        out = np.full((len(texts), len(self.languages)), float(PROFILE), np.float32)
        joined = "\n".join(texts).lower()
        if len(joined) != sum(map(len, texts)) + max(0, len(texts) - 1):  # lowering changed a length
            texts = [t.lower() for t in texts]
            joined = "\n".join(texts)
        if not texts or not joined:
            return out
        v = self.rank.shape[1]
        code = np.zeros(len(joined) + 2, np.int32)
        code[1:-1] = self.symbol.take(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), mode="clip")
        bounds = np.arange(len(texts) + 1) * v
        owner = np.zeros(len(code), np.int32 if bounds[-1] < 2**31 else np.int64)  # as the first key of the text
        owner[1:] = np.repeat(bounds[:-1], [len(t) + 1 for t in texts])
        keys = []
        pair = code[:-1] * _SYMBOLS + code[1:]
        triple = pair[:-1] * _SYMBOLS + code[2:]
        for table, grams, mid in ((self.tables[0], code, owner), (self.tables[1], pair, owner[1:]), (self.tables[2], triple, owner[1:-1])):
            found = table.take(grams)
            good = np.flatnonzero(found >= 0)
            keys.append(mid.take(good) + found.take(good))
        keys = np.concatenate(keys)
        if not len(keys):
            return out
        keys.sort()
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        count = np.diff(edges)
        keys = keys.take(edges[:-1])
        ends = np.searchsorted(keys, bounds.astype(keys.dtype))
        who = np.flatnonzero(np.diff(ends))
        first, size = ends[who], np.diff(ends)[who]
        gram = keys - np.repeat(bounds[who].astype(keys.dtype), size)
        # equal counts share their mean rank: a text's n-grams are numbered by how many have each count, highest first
        top = np.maximum.reduceat(count, first)
        slot = np.repeat(np.cumsum(top), size) - count
        same = np.bincount(slot, minlength=top.sum())
        place = np.cumsum(same) - (same + 1) / 2 - np.repeat(first, top)
        rank = place.astype(np.float32).take(slot)
        for j, theirs in enumerate(self.rank):
            r = theirs.take(gram)
            away = np.abs(r - rank) - PROFILE
            away *= r < PROFILE  # an n-gram that the profile lacks is PROFILE away
            out[who, j] = (np.add.reduceat(away, first) + PROFILE * size) / size
        return out


def count_ngrams(text: str, into: Counter) -> None:
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f"_{word}_"
        into.update(word)
        into.update(padded[i : i + 2] for i in range(len(padded) - 1))
        into.update(padded[i : i + 3] for i in range(len(padded) - 2))


def label_language(label: Column) -> Column:
    """The language a label names: any case, with or without a region after ``-`` or ``_``."""
    base = F.lower(F.split(F.trim(label), "[-_]")[0])
    return F.when(base.isin(*LANGUAGES), base)


def fit_profiles(records: DataFrame, common_words: DataFrame, *, text_col: str, label_col: str, id_col: str, sample_rows: int = 300) -> Profiles:
    frequent: dict[str, set[str]] = {}
    for r in collect_small(common_words.select("lang", "word"), 20_000):
        frequent.setdefault(r.lang, set()).add(r.word)
    counts = {lang: Counter() for lang in frequent}
    labelled = records.select(
        F.col(id_col).alias("id"), label_language(F.col(label_col)).alias("lang"), F.col(text_col).alias("text")
    ).where("lang is not null and length(text) >= 80")
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # a hashed thousandth-wise sieve keeps the ranked part small on large tables
    total = max(1, labelled.count())
    keep = min(1.0, 40.0 * sample_rows * len(LANGUAGES) / total)
    sieved = labelled.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < F.lit(int(keep * 1_000_000)))
    sample = sieved.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_rows).select("lang", "text").collect()
    for r in sample:
        text, _, affected = restore(r.text)
        words = re.findall(r"[^\W\d_]+", text.lower())
        hits = {lang: sum(w in f for w in words) for lang, f in frequent.items()}
        if not affected and hits.get(r.lang, 0) and hits[r.lang] == max(hits.values()):
            count_ngrams(text, counts[r.lang])
    for lang, words in frequent.items():
        for word in words:
            count_ngrams(word, counts[lang])
    return Profiles(counts)


_SEGMENTS = "id bigint, start int, end int, complete boolean, lang string, confidence double"


def _enough(text: str, start: int, end: int, words: int) -> bool:
    """Whether a stretch of a text has as many words; those beyond aren't looked for."""
    return words < 1 or next(islice(_WORDS.finditer(text, start, end), words - 1, None), None) is not None


def _judged(sentence: str, min_words: int) -> str:
    """A sentence without short quotations, if enough is left of it."""
    bare, quoted = _QUOTED.subn(" ", sentence)
    return bare if quoted and _enough(bare, 0, len(bare), min_words) else sentence


def _judge(profiles: Profiles, min_chars: int, min_words: int, lead: float):
    langs = profiles.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_all, texts_all = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(ids_all), 400):
                rows = [(i, t) for i, t in zip(ids_all[lo : lo + 400], texts_all[lo : lo + 400]) if t and len(t) >= min_chars and t.strip()]
                if not rows:
                    continue
                texts = [restore(t)[0] for _, t in rows]
                whole = profiles.distances(texts)
                parts, spans, of = [], [], []
                for k, text in enumerate(texts):
                    found = [s for s in sentences(text) if _enough(text, *s[:2], min_words)]
                    for s in found or [(0, len(text), False)]:
                        parts.append(_judged(text[s[0] : s[1]], min_words))
                        spans.append(s)
                        of.append(k)
                d = profiles.distances(parts)
                best = d.argmin(axis=1)
                two = np.partition(d, 1, axis=1)[:, :2]
                margin = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-6)
                main = whole.argmin(axis=1)
                near = d[np.arange(len(d)), main[of]]
                # a sentence leaves its text's language only if it is clearly nearer another one
                stays = (near - d.min(axis=1)) < lead * near
                chosen = np.where(stays, main[of], best)
                confidence = np.where(chosen == best, margin, 0.0)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.float64()]
                columns = [
                    [rows[k][0] for k in of], [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans],
                    [langs[c] for c in chosen], [round(float(x), 6) for x in confidence],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "start", "end", "complete", "lang", "confidence"])

    return run


def language_segments(
    records: DataFrame,
    common_words: DataFrame,
    *,
    id_col: str = "result_id",
    text_col: str = "original_text",
    label_col: str = "language",
    min_chars: int = 20,
    min_words: int = 4,
    lead: float = 0.18,
    sample_rows: int = 300,
) -> DataFrame:
    """(id, start, end, complete, lang, confidence) of every sentence, places in the restored text."""
    profiles = fit_profiles(records, common_words, text_col=text_col, label_col=label_col, id_col=id_col, sample_rows=sample_rows)
    src = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return spread(src).mapInArrow(_judge(profiles, min_chars, min_words, lead), _SEGMENTS)


def text_languages(segments: DataFrame) -> DataFrame:
    """(id, langs, confidence): the languages with a complete sentence; without one, that of the longest segment."""
    size = F.col("end") - F.col("start")
    per = segments.groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("complete"), F.col("lang")))).alias("whole"),
        F.max_by("lang", size).alias("longest"),
        F.round(F.sum(F.col("confidence") * size) / F.sum(size), 6).alias("confidence"),
    )
    return per.select("id", F.when(F.size("whole") > 0, F.col("whole")).otherwise(F.array("longest")).alias("langs"), "confidence")


def mislabelled(records: DataFrame, languages: DataFrame, *, id_col: str = "result_id", label_col: str = "language") -> DataFrame:
    """(id, lang) of the rows whose label is missing or wrong or whose text is mixed, one for each language."""
    labels = records.select(F.col(id_col).cast("bigint").alias("id"), label_language(F.col(label_col)).alias("label"))
    bad = (F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("langs")[0])
    return labels.join(languages, "id").where(bad).select("id", F.explode("langs").alias("lang")).distinct()
