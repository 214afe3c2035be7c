"""Problem 3: per-document text quality statistics.

Method: robust Mahalanobis distance. Statistics are computed for every text and brought to
scales on which prose spreads evenly (shares by the arcsine of their root, lengths by the
logarithm). For each language, and for all together, the mean and covariance of prose are
fitted by the minimum covariance determinant: from several starts, the half of the texts
nearest to the centre is kept and mean and covariance are estimated anew until they settle;
of the starts, the fit of the least determinant stays and is reweighted by the texts that lie
within it. A share counted over few words or lines is itself uncertain, and by the law
of total variance the mean of this uncertainty is part of the covariance, so that no
statistic has a spread of zero. A language's fit is shrunk towards the common one by shares
that follow from the data: little with many texts, wholly with none.

A text isn't prose if its squared distance is beyond the chi-square quantile of ``tail``. The
distance is the sum of the statistics' contributions, none of them negative: the squares
of the coordinates that are uncorrelated and each as near to its statistic as can be.

Scale: one map computes the statistics, which are a few numbers a row and are checkpointed; each
step of the fit is one map over them, whose tasks yield sums by language, start and
class of distance, so a few thousand rows are shuffled whatever the corpus. No text is
shuffled.

Defined results: null and blank texts have no statistics; a text with too few common
words to tell its language is measured against the prose of all languages; repeated rows of an id count once in the
found ids; without texts there are no distances.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import words_of
from corpusloom.runtime import checkpoint, collect_small, spread

NAMES = (
    "common_share",  # words that are frequent words of the text's language
    "sentence_share",  # characters in lines or paragraphs that end like sentences
    "built_share",  # characters in lines built as list entries, table rows, records or code
    "symbol_ratio",  # characters that are neither letters, digits, white space nor plain punctuation
    "comma_ratio",  # commas and semicolons before a blank, for each word
    "mean_word_length",
)
_LINE = 80  # characters that count as one case of a share of lines
_PLAIN = ".,;:!?'\"()-–—…’‘“”¿¡«»„°€"
_MARKER = re.compile(r"\s*(?:[-*•▪–—·+]|\d{1,3}[.)]|\[\d+\]|[a-z]\)|\d+(?:\.\d+)+)\s+(?=\S)")
# each on its own, as one pattern with all as alternatives is ten times slower
_SIGNS = tuple(re.compile(x).search for x in (r"[\t|{}<>=\\»]", r";\S", r"\(.*\):$", r",\S+,\S", r", \d+, \d+"))
_PLACES = tuple(re.compile(x).match for x in (r" {2,}\S|\d{4}-\d{2}-\d{2}|[\w.-]{2,}:(?:\s|$)", r"\S*/\S*/\S*$", r"\S*\w[/\\]\w\S*$"))
_GAPS = re.compile(r"(?<=[^\s.!?;:,/–—-]) {2,}\S|(?<=\S) {4,}\S")
_VERSION = re.compile(r"\d+\.\d+\.\d+$")
_ENDS = re.compile(r"[.!?…:;]+[\"'”’»)\]]*$")
_DISTINCT = 4  # frequent words that tell a language
_WIDE = re.compile("[\uff01-\uff5e]")
_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_SEPARATOR = re.compile(r"[,;](?=\s)")
_TERMINAL = re.compile(r"[.!?]+[\"'”’»)\]]*(?:\s|$)")


class FrequentWords:
    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in rows})
        bit = {lang: 1 << k for k, lang in enumerate(self.languages)}
        self.mask: dict[str, int] = {}
        for lang, word in rows:
            self.mask[word] = self.mask.get(word, 0) | bit[lang]


def _char_classes(texts: list[str]) -> np.ndarray:
    """Counts of letters, digits, white space, plain punctuation and symbols of each text."""
    table = np.full(0x3000, 4, np.int8)
    for o in range(0x3000):
        c = chr(o)
        table[o] = 0 if c.isalpha() else 1 if c.isdigit() else 2 if c.isspace() else 3 if c in _PLAIN else 4
    for o in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060):  # accents and invisible characters
        table[o] = 0
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(points < 0x3000, table[np.minimum(points, 0x2FFF)], np.where(points < 0xFF00, 0, 4))
    wide = (points >= 0xFF01) & (points < 0xFF5F)
    kind = np.where(wide, table[np.where(wide, points - 0xFEE0, 0)], kind)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(owner * 5 + kind, minlength=5 * len(texts)).reshape(-1, 5)


def _built(line: str) -> bool:
    """Whether a line looks like a table row, a record, a path or code."""
    return (
        any(f(line) for f in _SIGNS) or any(f(line) for f in _PLACES) or "...." in line
        or bool("  " in line and _GAPS.search(line)) or bool(line[-1:].isdigit() and _VERSION.search(line))
    )


def line_shares(text: str) -> tuple[float, float]:
    """Shares of characters in sentence-like paragraphs and in built lines."""
    total = sentence = built = 0
    run: list[str] = []

    def close() -> None:
        nonlocal sentence, run
        if run:
            whole = " ".join(run)
            if _TERMINAL.search(whole):
                sentence += max(m.end() for m in _TERMINAL.finditer(whole))
        run = []

    for line in text.split("\n"):
        bare = line.strip()
        total += len(bare)
        if not bare:
            close()
        elif _built(line.rstrip()) or _MARKER.match(line):
            close()
            if _ENDS.search(bare) and len(bare) > 60 and not _built(bare):
                sentence += len(bare)  # an entry that is a sentence
            else:
                built += len(bare)
        else:
            run.append(bare)
    close()
    total = max(1, total)
    return min(1.0, sentence / total), built / total


def _statistics(frequent: FrequentWords):
    get, langs = frequent.mask.get, frequent.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in batch.columns)) if r[2] and r[2].strip()]
            if not rows:
                continue
            ids, owners, texts = zip(*rows)
            texts = tuple(t.translate(_NARROW) if not t.isascii() and _WIDE.search(t) else t for t in texts)  # letter for letter
            classes = _char_classes(list(texts))
            out = np.zeros((len(rows), len(NAMES)))
            lang: list[str | None] = []
            count = np.zeros(len(rows), np.int64)
            for k, text in enumerate(texts):
                words = words_of(text)
                n = max(1, len(words))
                masks = Counter(map(get, words))
                masks.pop(None, None)
                hits = [sum(c for m, c in masks.items() if m >> j & 1) for j in range(len(langs))] if masks else [0]
                best = max(range(len(hits)), key=hits.__getitem__)
                told = masks and len({w for w in words if w in frequent.mask}) >= min(_DISTINCT, n)
                lang.append(langs[best] if told else None)
                count[k] = len(words)
                lettered = len(words) - sum(map(str.isdigit, words))
                out[k] = (hits[best] / n, *line_shares(text), 0, len(_SEPARATOR.findall(text)) / n, min(20.0, classes[k, 0] / max(1, lettered)))
            out[:, 3] = classes[:, 4] / np.maximum(1, classes.sum(axis=1) - classes[:, 2])
            columns = [pa.array(ids, pa.string()), pa.array(owners, pa.string()), pa.array(lang, pa.string())]
            columns += [pa.array([len(t) for t in texts], pa.int32()), pa.array(count, pa.int32())]
            columns += [pa.array(out[:, j]) for j in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "document_id", "lang", "chars", "words", *NAMES])

    return run


def text_statistics(records: DataFrame, common_words: DataFrame, *, id_col: str = "id", text_col: str = "content", document_col: str = "document_id") -> DataFrame:
    """(id, document_id, lang, chars, words, ...) of all texts that aren't blank."""
    rows = [(r.lang, r.word) for r in collect_small(common_words.select("lang", "word").where("word is not null"), 20_000)]
    numbers = ", ".join(f"{n} double" for n in NAMES)
    src = records.select(F.col(id_col).cast("string"), F.col(document_col).cast("string"), F.col(text_col))
    return spread(src).mapInArrow(_statistics(FrequentWords(rows)), f"id string, document_id string, lang string, chars int, words int, {numbers}")


def coordinates(x: np.ndarray, chars: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The statistics on scales where prose spreads evenly, and the variance of each as counted over so few words or lines."""
    w = np.maximum(1.0, words)
    lines = chars / _LINE
    cases = np.column_stack([w, lines, lines, w])
    shares = np.clip((x[:, :4] * cases + 0.5) / (cases + 1), 0, 1)
    at = np.column_stack([2 * np.arcsin(np.sqrt(shares)), np.sqrt(x[:, 4] + 0.5 / w), np.log(x[:, 5] + 0.5)])
    return at, np.column_stack([1 / (cases + 2), 1 / (4 * w), 1 / (4 * w)])  # logarithms of word lengths spread by about a half


def chi_square(x: float, degrees: int) -> float:
    """The share of a chi-square sample up to ``x``."""
    a, x = degrees / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < share else (low, middle)
    return high


def _consistent(share: float) -> float:
    """Brings the covariance of the nearest ``share`` of a normal sample to that of the whole."""
    return share / chi_square(chi_square_quantile(share, len(NAMES)), len(NAMES) + 2)


class ProseFit:
    """Mean and covariance of prose for one language, or for all."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray, texts: float = 0.0):
        self.mean, self.covariance, self.texts = mean, covariance, texts
        self.spread = np.sqrt(np.diag(covariance))
        values, vectors = np.linalg.eigh(covariance / np.outer(self.spread, self.spread))
        self.apart = (vectors * np.maximum(values, 1e-9) ** -0.5) @ vectors.T / self.spread[:, None]

    def contributions(self, at: np.ndarray) -> np.ndarray:
        """Squares of the uncorrelated coordinates nearest to the statistics; their sum is the squared distance."""
        return ((at - self.mean) @ self.apart) ** 2

    def log_determinant(self) -> float:
        return float(np.linalg.slogdet(self.covariance)[1])


_EDGES = np.geomspace(1e-2, 1e5, 96)  # of classes of squared distance
_DIM = len(NAMES)
_TRI = np.triu_indices(_DIM)
_SUMS = 1 + 2 * _DIM + len(_TRI[0])  # texts, coordinates, their products, their variances
_VIEWS = (np.tanh, lambda z: z / np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True)))


def _read(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def numbers(name: str) -> np.ndarray:
        return batch.column(names.index(name)).to_numpy(zero_copy_only=False)

    at, unsure = coordinates(np.column_stack([numbers(n) for n in NAMES]), numbers("chars"), numbers("words"))
    return at, unsure, np.array(batch.column(names.index("lang")).to_pylist(), object)


def _sums(statistics: DataFrame, fits: dict[tuple[str, int], ProseFit], edges: np.ndarray, views: bool = False) -> dict[tuple[str, int], np.ndarray]:
    """Sums of the texts of each fit by class of their distance from it; of their views, if asked, which are on the fit's scale."""
    columns = [f"s{j}" for j in range(_SUMS)]
    names = ["lang", "chars", "words", *NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {key: np.zeros((len(edges) + 1, _SUMS)) for key in fits}
        for batch in batches:
            at, unsure, lang = _read(batch, names)
            of = {g: slice(None) if g == "*" else lang == g for g in {g for g, _ in fits}}
            for (g, k), fit in fits.items():
                x, v = at[of[g]], unsure[of[g]]
                if not len(x):
                    continue
                d = fit.contributions(x).sum(axis=1)
                if views:
                    x = _VIEWS[k]((x - fit.mean) / fit.spread)
                kind = np.searchsorted(edges, d)
                order = np.argsort(kind, kind="stable")
                rows = np.column_stack([np.ones(len(x)), x, x[:, _TRI[0]] * x[:, _TRI[1]], v])[order]
                first = np.flatnonzero(np.diff(kind[order], prepend=-1))
                total[g, k][kind[order][first]] += np.add.reduceat(rows, first)
        keys = [(g, k, b) for (g, k), t in total.items() for b in np.flatnonzero(t[:, 0])]
        rows = np.array([total[g, k][b] for g, k, b in keys]).reshape(-1, _SUMS)
        kinds = (pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([key[j] for key in keys], kind) for j, kind in enumerate(kinds)], *[pa.array(rows[:, j]) for j in range(_SUMS)]], ["g", "k", "b", *columns]
        )

    schema = "g string, k int, b int, " + ", ".join(f"{c} double" for c in columns)
    out = {key: np.zeros((len(edges) + 1, _SUMS)) for key in fits}
    by_class = statistics.select(*names).mapInArrow(run, schema).groupBy("g", "k", "b").agg(*[F.sum(c).alias(c) for c in columns])
    for r in by_class.collect():  # at most languages x starts x classes
        out[r.g, r.k][r.b] = r[3:]
    return out


def _nearest(sums: np.ndarray, share: float) -> np.ndarray:
    """The sums of the nearest share of the texts; of the class it ends in, the part that is needed."""
    n = sums[:, 0]
    before = np.cumsum(n) - n
    return (np.clip((share * n.sum() - before) / np.maximum(n, 1), 0, 1)[:, None] * sums).sum(axis=0)


def _matrix(triangle: np.ndarray) -> np.ndarray:
    m = np.zeros((_DIM, _DIM))
    m[_TRI] = triangle
    return m + np.triu(m, 1).T


def _estimate(sums: np.ndarray, scale: float = 1.0) -> ProseFit:
    """Mean and covariance of what was summed: the scatter of the texts and the mean of their uncertainty."""
    n = max(sums[0], 1e-9)
    mean = sums[1 : 1 + _DIM] / n
    scatter = _matrix(sums[1 + _DIM : -_DIM] / n) - np.outer(mean, mean)
    return ProseFit(mean, scatter * scale + np.diag(sums[-_DIM:] / n), sums[0])


def _starts(statistics: DataFrame) -> dict[tuple[str, int], ProseFit]:
    """Three starts for each language and for all: quartiles, and correlations of the squashed and of the directions."""
    columns = ["chars", "words", *NAMES]
    parts = [F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in columns]
    quartiles = statistics.where("lang is not null").groupBy("lang").agg(*parts).unionByName(statistics.agg(F.lit("*").alias("lang"), *parts)).collect()
    first = {}
    for r in quartiles:
        if r.chars is None:
            continue
        x = np.array([r[c] for c in columns], float).T  # a row for each quartile
        at, unsure = coordinates(x[:, 2:], np.full(3, x[1, 0]), np.full(3, x[1, 1]))
        first[r.lang, 0] = ProseFit(at[1], np.diag(((at[2] - at[0]) / 1.349) ** 2 + unsure[1]))
    fits = dict(first)
    for (g, k), sums in _sums(statistics, {(g, k): f for (g, _), f in first.items() for k in range(len(_VIEWS))}, np.empty(0), True).items():
        fit = first[g, 0]
        seen = _matrix(sums[0, 1 + _DIM : -_DIM] / max(1, sums[0, 0]))
        seen = seen / max(1e-9, np.trace(seen) / _DIM) + np.diag(np.full(_DIM, 1 / (1 + sums[0, 0])))
        fits[g, k + 1] = ProseFit(fit.mean, seen * np.outer(fit.spread, fit.spread))
    return fits


def _shrunk(fits: dict[str, ProseFit]) -> dict[str, ProseFit]:
    """Each language's fit, as far as its number of texts tells it from the common one."""
    common, own = fits["*"], {g: f for g, f in fits.items() if g != "*"}
    means = np.array([f.mean for f in own.values()])
    between = means.var(axis=0, ddof=1) if len(own) > 1 else np.zeros(_DIM)
    out = {"*": common}
    for g, f in own.items():
        s, n = f.covariance, max(1.0, f.texts)
        noise = (np.outer(np.diag(s), np.diag(s)) + s**2).sum() / n  # variance of the entries of a covariance of n texts
        share = min(1.0, noise / max(1e-12, ((s - common.covariance) ** 2).sum()))
        weight = between / np.maximum(1e-12, between + np.diag(s) / n)
        out[g] = ProseFit(weight * f.mean + (1 - weight) * common.mean, share * common.covariance + (1 - share) * s, f.texts)
    return out


def fit_prose(statistics: DataFrame, *, min_chars: int = 80, nearest: float = 0.5, steps: int = 6, within: float = 0.9999) -> dict[str, ProseFit]:
    """A robust fit for each language that occurs, and one for all under ``*``.

    ``nearest``: share of the texts that a step keeps; ``within``: share of prose that the final fit
    is to hold, so that rare kinds of prose count in its covariance.
    """
    long = statistics.where(F.col("chars") >= min_chars)
    fits = _starts(long)
    if not fits:
        return {}
    for _ in range(steps):
        before = {key: f.log_determinant() for key, f in fits.items()}
        fits = {key: _estimate(_nearest(s, nearest)) for key, s in _sums(long, fits, _EDGES).items()}
        if all(abs(f.log_determinant() - before[key]) < 1e-2 for key, f in fits.items()):
            break
    best = {g: min((f for (h, _), f in fits.items() if h == g), key=ProseFit.log_determinant) for g in {g for g, _ in fits}}
    best = {(g, 0): ProseFit(f.mean, f.covariance * _consistent(nearest), f.texts) for g, f in best.items()}
    cut = np.array([chi_square_quantile(within, _DIM)])
    for _ in range(2):
        best = {key: _estimate(s[0], _consistent(within)) if s[0, 0] else best[key] for key, s in _sums(long, best, cut).items()}
    return _shrunk({g: f for (g, _), f in best.items()})


def distances(statistics: DataFrame, fits: dict[str, ProseFit]) -> DataFrame:
    """The statistics with the squared ``distance`` and its contributions, ``by_<statistic>``."""
    names = list(statistics.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _, lang = _read(batch, names)
            part = np.zeros_like(at)
            for g in set(lang):
                of = lang == g
                part[of] = fits.get(g, fits["*"]).contributions(at[of])
            more = [pa.array(part.sum(axis=1)), *[pa.array(part[:, j]) for j in range(len(NAMES))]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "distance", *[f"by_{n}" for n in NAMES]])

    if not fits:
        return statistics.withColumns({c: F.lit(None).cast("double") for c in ("distance", *[f"by_{n}" for n in NAMES])})
    schema = ", ".join(f"{n} {t}" for n, t in statistics.dtypes) + ", distance double" + "".join(f", by_{n} double" for n in NAMES)
    return statistics.mapInArrow(run, schema)


def measured_texts(records: DataFrame, common_words: DataFrame, **columns: str) -> DataFrame:
    """Statistics, distance and contributions of all texts."""
    statistics = checkpoint(text_statistics(records, common_words, **columns))
    return distances(statistics, fit_prose(statistics))


#: The share of normally spread prose that may lie beyond the limit.
TAIL = 1e-6


def limit(tail: float = TAIL) -> float:
    """The squared distance beyond which a text isn't prose."""
    return chi_square_quantile(1 - tail, len(NAMES))


def not_prose(measured: DataFrame, *, min_chars: int = 80, tail: float = TAIL) -> DataFrame:
    return measured.where((F.col("chars") >= min_chars) & (F.col("distance") > limit(tail))).select("id").distinct()


def document_statistics(measured: DataFrame, *, tail: float = TAIL) -> DataFrame:
    """Per document: texts, characters, mean statistics weighted by characters, share of characters in texts that aren't prose."""
    w = F.col("chars")
    once = measured.dropDuplicates(["id"])
    return once.groupBy("document_id").agg(
        F.count("*").alias("texts"), F.sum(w).alias("chars"), F.sum("words").alias("words"),
        *[F.round(F.sum(F.col(n) * w) / F.sum(w), 6).alias(n) for n in NAMES],
        F.round(F.sum(F.when(F.col("distance") > limit(tail), w).otherwise(0)) / F.sum(w), 6).alias("not_prose_share"),
    )
