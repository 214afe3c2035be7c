"""Problem 7: noise in text from scanned pages.

Method: words are grouped by their confusable-glyph skeleton (``rn`` and ``m``, ``1``
and ``l``, ``c`` and ``e``); the frequent forms of a group are the supported ones, and a
rare form that differs from one glyph by glyph, seen in a text, is a misreading. Where several supported
forms fit it, the one that stands most often beside the same neighbours in the corpus takes its place. Lines at the top and foot of the pages
of one document, with digits masked and glyphs reduced to their skeleton, that
come again on other pages are running headers, also where left and right pages differ, and
so are lines with a number set apart that runs on with the pages; lines of a bare number,
also a Roman one, are page numbers. A scanned page is stored whole, so documents whose pages stand as several chunks
weren't scanned. Words broken over a line end are joined if the whole is a known
word. Paragraphs are then continued over page ends with SQL windows.

Scale: words are counted in the tasks before they are shuffled; the frequent forms go to the
tasks if they were counted as at most ``forms`` words, else each text is joined with those that share
a skeleton with its words; of the pages, only edge lines are
shuffled, and counted with map-side combining. The windows of the repair
run over blocks of pages, and a second window over the blocks, so a document with a third
of all pages is spread over many tasks.

Defined results: rows without text, document or page are no pages; a page in both tables
counts once; repeated rows change nothing; codes of letters and digits, inner hyphens
and line wrapping aren't noise.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.runtime import broadcast_if_small, checkpoint, spread

# accents on their own and invisible characters stand within words
_WITHIN = "\u0300-\u036f\u00ad\u200b-\u200f\u2060-\u2064\ufeff"
_TOKEN = re.compile(rf"(?<![\w\-!|=/.{_WITHIN}])[^\W_](?:[^\W_]|[!|](?=[^\W\d_]))*(?![\w\-=/{_WITHIN}])")
_TWO_SCRIPTS = re.compile(r"[a-z].*[\u0370-\u04ff]|[\u0370-\u04ff].*[a-z]", re.I)
_LETTERED = re.compile(r"\b[^\W_]*[^\W\d_][^\W_]*")
_LETTERS = re.compile(r"[^\W\d_]")
_BROKEN = re.compile(r"([^\W\d_]+)([-¬‐­])[ \t]*\n[ \t]*([^\W\d_]+)")
_HYPHEN_END = re.compile(r"[-¬‐­][ \t]*\n")  # found faster than the words about it
_MIXED = re.compile(r"(?<![\w\-=/.])[a-zà-ÿ]+[0-9!][a-zà-ÿ]{2,}(?![\w\-=/])")
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = re.compile(
    r"^[^\w\s]*\s*(?:(?:page|seite|página|pagina|pág\.?|p\.|стр\.?|blz\.?)\s*)?"
    rf"(?:\d{{1,5}}(?:\s*(?:of|/|von|de|di|van|sur|из)\s*\d{{1,5}})?|{_ROMAN}(?!\.))\s*[^\w\s]*$",
    re.I,
)
_TAIL_NUMBER = re.compile(r"^\s*\d{1,5}\s{2,}(?=\D)|(?<=\S)\s{2,}\d{1,5}\s*$")
_COUNT_AT = 300_000
_EDGE = 2  # lines at the top and foot that may be page numbers
_HEADS = 4  # and that may be headers
_DOUBT = 10  # misreadings taken to stand in clean texts only, while few were seen

# Glyphs that scanning confuses, each brought to one of its class.
_SINGLES = str.maketrans({"0": "o", "1": "i", "!": "i", "|": "i", "l": "i", "ı": "i", "5": "s", "9": "g", "6": "h", "8": "h", "b": "h", "e": "c", "f": "t", "2": "z"})
_SPELLED = str.maketrans({"m": "rn", "w": "vv", "d": "ci", "u": "ii", "h": "ii"})
_PAIRS = {"rn": "m", "vv": "w", "cl": "d", "c1": "d", "c!": "d", "c|": "d"}


def skeleton(word: str) -> str:
    """The same for all words that differ by confused glyphs: single glyphs first, then those like two spelled out."""
    return word.lower().translate(_SINGLES).translate(_SPELLED)


def _glyphs(word: str, at: int) -> list[tuple[int, str]]:
    """What stands at a place of a word, read as one glyph or as one that looks like two: (end, glyph)."""
    one = word[at].translate(_SINGLES)
    found = [(at + 1, "u" if one == "h" else one)]
    two = word[at : at + 2]
    if two in _PAIRS:
        found.append((at + 2, _PAIRS[two]))
    elif two.translate(_SINGLES) == "ii":
        found.append((at + 2, "u"))
    return found


def confusable(a: str, b: str) -> bool:
    """Whether two words of one skeleton differ glyph by glyph, so not by a swap (talbe) or confusions of confusions (che, die)."""
    ends, done = [(0, 0)], set()
    while ends:
        i, j = ends.pop()
        if (i, j) in done:
            continue
        done.add((i, j))
        if i == len(a) or j == len(b):
            if i == len(a) and j == len(b):
                return True
            continue
        ends += [(k, m) for k, x in _glyphs(a, i) for m, y in _glyphs(b, j) if x == y]
    return False


def _most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the forms of each skeleton, the count of the most frequent one confusable with it."""
    for batch in batches:
        rows = []
        for s, forms in zip(*(c.to_pylist() for c in batch.columns)):
            forms.sort(key=lambda x: -x["n"])
            for x in forms:
                most = next(y["n"] for y in forms if y is x or confusable(x["form"], y["form"]))
                rows.append((x["form"], s, x["n"], x["clean"], most))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["form", "skeleton", "n", "clean", "most"]
        )


def marred(text: str) -> bool:
    """Whether a text shows scan noise that needs no vocabulary: a broken line end, a page number, digits among letters."""
    return bool((_HYPHEN_END.search(text) and _BROKEN.search(text)) or _MIXED.search(text)) or any(_NUMBER.match(x) for x in edge_lines(text))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    clean: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = [w for w in seen if len(w) > 1 and w.isalpha() and not _TWO_SCRIPTS.search(w)]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.string()), pa.array([skeleton(w) for w in words], pa.string()),
                pa.array([seen[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64()),
            ],
            ["form", "skeleton", "n", "clean"],
        )
        seen.clear()
        clean.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words = _TOKEN.findall(text.lower())
                seen.update(words)
                if not marred(text):
                    clean.update(words)
        if len(seen) > _COUNT_AT:
            yield flush()
    yield flush()


def _beyond(share: Column, by_chance: float, n: Column, p: float) -> Column:
    """Whether ``n`` cases reach a share above ``by_chance`` with a chance of at most ``p`` (Chernoff's bound)."""
    if by_chance >= 1:
        return F.lit(False)
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - by_chance))).otherwise(0.0)
    return (share > by_chance) & (n * (share * F.log(share / by_chance) + rest) >= -math.log(p))


def frequent_forms(texts: DataFrame, *, least: int = 12, ratio: float = 12.0, clean_share: float = 0.6, forms: int = 60_000) -> dict[str, int] | DataFrame:
    """The supported forms and their counts.

    Supported is a form that is frequent and no rare variant within its skeleton, or one
    that stands mostly in texts without other scan noise. A rare variant of three letters or more
    must stand there more often than chance gives it to any of so many misreadings: their
    mean share of such texts is ``by_chance``. More than ``forms`` come as a table (form, skeleton, n).
    """
    words = (
        texts.mapInArrow(_counts, "form string, skeleton string, n bigint, clean bigint")
        .groupBy("form", "skeleton").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))
    )
    words = words.where(F.col("n") >= 4)
    alike = words.groupBy("skeleton").agg(F.collect_list(F.struct("form", "n", "clean")).alias("forms"))
    frequent = (F.col("n") >= least) & (F.col("n") * ratio > F.col("most"))
    ordinary = F.col("clean") >= F.greatest(F.lit(4), clean_share * F.col("n"))
    words = checkpoint(alike.mapInArrow(_most, "form string, skeleton string, n bigint, clean bigint, most bigint"))
    rare = (F.col("n") * ratio <= F.col("most")) & (F.length("form") >= 3)
    share = F.col("clean") / F.col("n")
    seen = words.where(rare).agg(F.count("*").alias("count"), F.coalesce(F.sum(share), F.lit(0.0)).alias("shares")).first()
    by_chance = (_DOUBT + seen["shares"]) / (_DOUBT + seen["count"])
    kept = words.where(frequent | (ordinary & (~rare | _beyond(share, by_chance, F.col("n"), 0.01 / (1 + seen["count"])))))
    kept = kept.select("form", "skeleton", "n")
    few = kept.limit(forms + 1).collect()
    return {r.form: r.n for r in few} if len(few) <= forms else checkpoint(kept)


def _beside(matches: list[re.Match], k: int) -> tuple[str, str]:
    """The words before and after a word."""
    return matches[k - 1].group().lower() if k else "", matches[k + 1].group().lower() if k + 1 < len(matches) else ""


class Reader:
    """Judges and repairs pages against the supported forms."""

    def __init__(self, known: dict[str, int]):
        self.known = known
        self.alike: dict[str, list[str]] = {}
        for w in sorted((w for w in known if " " not in w), key=lambda w: (known[w], w), reverse=True):
            self.alike.setdefault(skeleton(w), []).append(w)  # the most frequent comes first

    def fitting(self, token: str) -> list[str]:
        """The supported forms that a token may be a misreading of, the most frequent first."""
        low = token.lower()
        if len(low) < 2 or low in self.known or not _LETTERS.search(low) or _TWO_SCRIPTS.search(low):
            return []
        if not low.isalpha() and sum(map(str.isalpha, low)) < len(low) / 2:
            return []
        return [w for w in self.alike.get(skeleton(low), ()) if confusable(low, w)]

    def misread(self, token: str, left: str = "", right: str = "") -> str | None:
        """The supported form that a token is a misreading of, by its neighbours where several fit."""
        fits = self.fitting(token)
        if not fits:
            return None
        good = fits[0]
        if len(fits) > 1:
            beside = [self.known.get(f"{left} {w}", 0) + self.known.get(f"{w} {right}", 0) for w in fits]
            good = fits[beside.index(max(beside))]
        if token[0].isupper() or (token.isupper() and len(token) > 1):
            return good.upper() if token.isupper() and len(good) > 1 and not token[0].isdigit() else good[:1].upper() + good[1:]
        return good

    def whole(self, m: re.Match) -> str | None:
        """The word that a line end broke, or None if its hyphen belongs to it."""
        joined = m.group(1) + m.group(3)
        if joined.lower() in self.known or self.misread(joined):
            return joined
        if m.group(2) != "-":
            return joined
        parts = m.group(1).lower() in self.known and m.group(3).lower() in self.known
        return None if parts or m.group(3)[0].isupper() else joined

    def broken(self, text: str) -> bool:
        return bool(_HYPHEN_END.search(text)) and any(self.whole(m) for m in _BROKEN.finditer(text))

    def misreadings(self, text: str) -> list[tuple[str, str]]:
        return [(m.group(), good) for m, good in self._misread_at(text)]

    def _misread_at(self, text: str) -> Iterator[tuple[re.Match, str]]:
        known = self.known
        if not any(t not in known and self.misread(t) for t in set(_TOKEN.findall(text.lower()))):
            return  # nothing to place
        matches = list(_TOKEN.finditer(text))
        first, last = len(text) - len(text.lstrip()), len(text.rstrip())
        for k, m in enumerate(matches):
            t = m.group()
            if t.lower() in known:
                continue
            if t.isalpha() and (m.end() == last or (m.start() == first and t[0].islower())):
                continue  # the rest of a word that a page or chunk cut
            good = self.misread(t, *_beside(matches, k))
            if good and (len(t) > 3 or self.supported([x.group() for x in matches[max(0, k - 1) : k + 2]])):
                yield m, good

    def supported(self, around: list[str]) -> bool:
        """Whether a short token stands beside a longer known word, as in a sentence; in dumps it doesn't."""
        return any(len(t) > 2 and t.lower() in self.known for t in around)

    def joined(self, text: str) -> str:
        return _BROKEN.sub(lambda m: self.whole(m) or m.group(), text)

    def corrected(self, text: str) -> str:
        out, at = [], 0
        for m, good in self._misread_at(text):
            out += [text[at : m.start()], good]
            at = m.end()
        return "".join(out) + text[at:]


def looked_up(text: str) -> set[str]:
    """The forms that a reader of a text looks up, or whose skeletons it does: words, broken words and their parts."""
    words = {t.lower() for t in _TOKEN.findall(text)} | set(_TOKEN.findall(text.lower()))
    for m in _BROKEN.finditer(text) if _HYPHEN_END.search(text) else ():
        words.update(x.lower() for x in (m.group(1), m.group(3), m.group(1) + m.group(3)))
    return words


def _pairs_of(text: str) -> Iterator[str]:
    words = _TOKEN.findall(text.lower())
    return (f"{a} {b}" for a, b in zip(words, words[1:]))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(key, s) for key, text in zip(*(c.to_pylist() for c in batch.columns)) for s in {skeleton(w) for w in (*looked_up(text), *_pairs_of(text))}]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["key", "skeleton"])


def _ambiguous(known: dict[str, int] | None):
    """The pairs of neighbours that could tell which of several forms a misreading stands for, as (form, skeleton)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = None if known is None else Reader(known)
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            found: set[str] = set()
            for text, reader in zip(values[0], _readers(fixed, values)):
                if all(t in reader.known for t in set(_TOKEN.findall(text.lower()))):
                    continue
                matches = list(_TOKEN.finditer(text))
                for k, m in enumerate(matches):
                    fits = reader.fitting(m.group())
                    if len(fits) > 1:
                        left, right = _beside(matches, k)
                        found.update(p for w in fits for p in ([f"{left} {w}"] if left else []) + ([f"{w} {right}"] if right else []))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([skeleton(p) for p in found], pa.string())], ["form", "skeleton"])

    return run


def _pair_counts(wanted: set[str] | None):
    sought = None if wanted is None else {tuple(p.split(" ")) for p in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(map(" ".join, counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["form", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    words = _TOKEN.findall(text.lower())
                    pairs = zip(words, words[1:])
                    counts.update(pairs if sought is None else filter(sought.__contains__, pairs))
            if len(counts) > _COUNT_AT:
                yield flush()
        yield flush()

    return run


def with_contexts(texts: DataFrame, known: dict[str, int] | DataFrame, corpus: DataFrame, *, most: int = 200_000) -> dict[str, int] | DataFrame:
    """The supported forms, and besides them how often the pairs of words occur in the corpus that tell which form a misreading in ``texts`` stands for.

    Up to ``most`` pairs go to the tasks; beyond them all pairs are counted and joined, and the forms become a table.
    """
    needed = checkpoint(with_forms(texts, known).mapInArrow(_ambiguous(_sent(known)), "form string, skeleton string").distinct())
    few = needed.select("form").limit(most + 1).collect()
    wanted = {r.form for r in few} if len(few) <= most else None
    if not few:
        return known
    counts = corpus.mapInArrow(_pair_counts(wanted), "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n"))
    if isinstance(known, dict):
        if wanted is not None:
            return known | {r.form: r.n for r in counts.collect()}
        known = texts.sparkSession.createDataFrame([(w, skeleton(w), n) for w, n in known.items()], "form string, skeleton string, n bigint")
    return checkpoint(known.select("form", "skeleton", "n").unionByName(counts.join(needed, "form").select("form", "skeleton", "n")))


def with_forms(texts: DataFrame, known: dict[str, int] | DataFrame) -> DataFrame:
    """``texts`` with the supported forms that each may need as a last column, where they are a table."""
    if isinstance(known, dict):
        return texts
    keyed = texts.withColumn("key", F.md5("text"))
    wanted = keyed.select("key", "text").mapInArrow(_skeletons, "key string, skeleton string").distinct()
    listed = wanted.join(known, "skeleton").groupBy("key").agg(F.collect_list(F.struct("form", "n")).alias("forms"))
    return keyed.join(listed, "key", "left").select(*texts.columns, "forms")


def _sent(known: dict[str, int] | DataFrame) -> dict[str, int] | None:
    return known if isinstance(known, dict) else None


def _readers(fixed: Reader | None, columns: list[list]) -> Iterator[Reader]:
    """A reader for each row: the fixed one, or one of the row's own forms."""
    return repeat(fixed) if fixed else (Reader({x["form"]: x["n"] for x in forms or ()}) for forms in columns[-1])


def mask(line: str) -> str:
    """A line as it compares with the same header on another page."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "#", skeleton_text(_TAIL_NUMBER.sub("", line)))).strip()


def header_keys(line: str, page: int) -> list[str]:
    """What makes an edge line the same header as another page's: its mask, and how far a number set apart runs ahead of the page."""
    words = _LETTERED.findall(line)
    title = 3 * sum(w[0].islower() for w in words) <= len(words)  # prose that comes again isn't one
    keys = [m] if title and not line.endswith((".", "?")) and (m := mask(line)) not in ("", "#") else []
    apart = _TAIL_NUMBER.search(line)
    if apart and (m := _TAIL_NUMBER.sub("", line)) and _LETTERS.search(m):
        keys.append(f"@{int(apart.group()) - page}")
    return keys


def skeleton_text(line: str) -> str:
    return re.sub(r"[^\W_]+", lambda m: "#" if m.group().isdigit() else skeleton(m.group()), line)


def edge_lines(text: str, edge: int = _EDGE, longest: int = 100) -> list[str]:
    """The first and last lines of a page that could be a header or number: short."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    edges = lines[:edge] + lines[max(edge, len(lines) - edge) :]
    return [x for x in edges if len(x) < longest] if len(lines) > 1 else []


def head_lines(text: str) -> list[str]:
    return edge_lines(text, _HEADS, 200)


_FEATURES = "document_id string, page_number int, look bigint, broken boolean, misread int, sure boolean, numbered boolean, edges array<string>"


def _features(known: dict[str, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = None if known is None else Reader(known)
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            docs, pages, texts = values[:3]
            look, broken, misread, sure, numbered, edges = [], [], [], [], [], []
            for page, text, reader in zip(pages, texts, _readers(fixed, values)):
                lines = edge_lines(text)
                look.append(xxhash.xxh3_64_intdigest(text) >> 1)
                broken.append(reader.broken(text))
                found = [t for t, _ in reader.misreadings(text)]
                misread.append(len(found))
                sure.append(any(len(t) > 2 or not t.isalpha() for t in found))  # two letters may be a foreign word
                numbered.append(any(_NUMBER.match(x) for x in lines))
                edges.append(list(dict.fromkeys(k for x in head_lines(text) for k in header_keys(x, page))))
            columns = [pa.array(docs, pa.string()), pa.array(pages, pa.int32()), pa.array(look, pa.int64()), pa.array(broken), pa.array(misread, pa.int32())]
            columns += [pa.array(sure), pa.array(numbered), pa.array(edges, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["document_id", "page_number", "look", "broken", "misread", "sure", "numbered", "edges"])

    return run


def page_texts(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, page_number, part, text) of the pages of both tables."""
    a = results.select("document_id", "page_number", F.lit(-1).alias("part"), F.col("original_text").alias("text"))
    b = chunks.select("document_id", "page_number", F.coalesce("chunk_index", F.lit(0)).alias("part"), F.col("content").alias("text"))
    return spread(a.unionByName(b).where("document_id is not null and page_number is not null and text is not null"))


def page_noise(pages: DataFrame, known: dict[str, int] | DataFrame, *, header_share: float = 0.25, whole_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Noise of each page, and the headers of each document as (document_id, line).

    ``whole`` is the share of a document's pages that stand as one text; only documents stored by
    the page (at least ``whole_share``) have headers, as the edges of a chunk are no edges of a page.
    """
    src = pages.select("document_id", "page_number", "text")
    per = checkpoint(with_forms(src, known).mapInArrow(_features(_sent(known)), _FEATURES))
    page = per.groupBy("document_id", "page_number").agg(
        (F.min("look") == F.max("look")).alias("one"),
        F.max("broken").alias("broken"), F.max("misread").alias("misread"), F.max("sure").alias("sure"), F.max("numbered").alias("numbered"),
    )
    total = page.groupBy("document_id").agg(
        F.count("*").alias("pages"),
        F.avg(F.col("one").cast("double")).alias("whole"),
        F.avg((F.col("broken") | F.col("numbered") | F.col("sure")).cast("double")).alias("noisy"),
    )
    lines = per.select("document_id", "page_number", F.explode("edges").alias("line")).distinct()
    headers = (
        lines.groupBy("document_id", "line").agg(F.count("*").alias("n"))
        .where("n >= 2")
        .join(total.where(F.col("whole") >= whole_share), "document_id")
        .where(F.col("n") >= header_share * F.col("pages"))
        .select("document_id", "line")
    )
    headed = lines.join(headers, ["document_id", "line"]).select("document_id", "page_number", F.lit(True).alias("header")).distinct()
    noise = (
        page.join(headed, ["document_id", "page_number"], "left")
        .join(total.select("document_id", "whole", "noisy"), "document_id")
        .withColumn("header", F.coalesce("header", F.lit(False)))
    )
    return noise, headers


def noisy_pages(noise: DataFrame, *, whole_share: float = 0.8) -> DataFrame:
    """The pages with noise, of documents stored by the page; two letters misread count beside surer noise only."""
    some = F.col("broken") | F.col("numbered") | F.col("header") | ((F.col("misread") > 0) & (F.col("noisy") > 0))
    return noise.where(some & (F.col("whole") >= whole_share)).select("document_id", "page_number").distinct()


_PARAGRAPHS = "document_id string, page_number int, paragraphs array<string>"
_EDITED = "document_id string, page_number int, text string, lines array<string>"


def _stripped(reader: Reader, page: int, text: str, drop: set[str]) -> str:
    edges, heads = set(edge_lines(text)), set(head_lines(text))

    def goes(line: str) -> bool:
        return bool(line in edges and _NUMBER.match(line)) or (line in heads and not drop.isdisjoint(header_keys(line, page)))

    return "\n".join(x for x in text.split("\n") if not goes(x.strip()))


def _joined(reader: Reader, page: int, text: str, drop: set[str]) -> str:
    return reader.joined(text)


def _corrected(reader: Reader, page: int, text: str, drop: set[str]) -> str:
    return reader.corrected(text)


def _edited(known: dict[str, int] | None, *steps: Callable[[Reader, int, str, set[str]], str], split: bool = False):
    """The texts after these steps, as they are or split into paragraphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = None if known is None else Reader(known)
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            docs, pages, texts, headers = values[:4]
            out = []
            for page, text, lines, reader in zip(pages, texts, headers, _readers(fixed, values)):
                for step in steps:
                    text = step(reader, page, text, set(lines or ()))
                out.append(text)
            columns = [pa.array(docs, pa.string()), pa.array(pages, pa.int32())]
            if split:
                found = [[p for p in (re.sub(r"\s+", " ", x).strip() for x in re.split(r"\n\s*\n", text)) if p] for text in out]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.string()))], ["document_id", "page_number", "paragraphs"])
            else:
                columns += [pa.array(out, pa.string()), pa.array(headers, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["document_id", "page_number", "text", "lines"])

    return run


def _page_paragraphs(texts: DataFrame, known: dict[str, int] | DataFrame) -> DataFrame:
    """The repaired paragraphs of (document_id, page_number, text, lines).

    As each step changes the words, a table of forms is joined anew for the next one.
    """
    if isinstance(known, dict):
        return texts.mapInArrow(_edited(known, _stripped, _joined, _corrected, split=True), _PARAGRAPHS)
    texts = texts.mapInArrow(_edited({}, _stripped), _EDITED)
    texts = with_forms(texts, known).mapInArrow(_edited(None, _joined), _EDITED)
    return with_forms(texts, known).mapInArrow(_edited(None, _corrected, split=True), _PARAGRAPHS)


def scanned_pages(pages: DataFrame, noise: DataFrame) -> DataFrame:
    """(document_id, page_number, text) of all pages of the documents that have noisy ones; a page that stands in both tables, or was delivered again, comes once."""
    scanned = checkpoint(noisy_pages(noise).select("document_id").distinct())
    parts = pages.join(broadcast_if_small(scanned), "document_id").groupBy("document_id", "page_number", "part").agg(F.min("text").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))  # the parts of one page
    return parts.groupBy("document_id", "page_number").agg(ordered.alias("parts")).select(
        "document_id", "page_number",
        F.when(F.col("parts")[0]["part"] < 0, F.col("parts")[0]["text"]).otherwise(F.array_join(F.transform("parts", lambda x: x["text"]), "\n\n")).alias("text"),
    )


def repaired_paragraphs(texts: DataFrame, headers: DataFrame, known: dict[str, int] | DataFrame, *, block: int = 64) -> DataFrame:
    """(document_id, first_page, paragraph, text): the paragraphs of scanned pages, continued over page ends."""
    listed = headers.groupBy("document_id").agg(F.collect_set("line").alias("lines"))  # a few for each document
    done = (
        _page_paragraphs(texts.join(listed, "document_id", "left").select("document_id", "page_number", "text", "lines"), known)
        .select("document_id", "page_number", F.posexplode("paragraphs").alias("at", "text"))
    )
    place = F.struct("page_number", "at")
    blocks = done.withColumn("block", F.floor(F.col("page_number") / block))
    in_block = W.partitionBy("document_id", "block").orderBy("page_number", "at")
    over_blocks = W.partitionBy("document_id").orderBy("block")
    # what ended the block before, from one row for each block
    ends = blocks.groupBy("document_id", "block").agg(F.max_by("text", place).alias("last_text"))
    carried = ends.select("document_id", "block", F.lag("last_text").over(over_blocks).alias("carried"))
    before = F.coalesce(F.lag("text").over(in_block), F.col("carried"))
    marked = blocks.join(carried, ["document_id", "block"]).withColumn("before", before).withColumn(
        "begins",
        F.col("before").isNull() | (F.col("at") > 0) | F.col("before").rlike(r"[.!?:][\"'”’)]*$") | ~F.col("text").rlike(r"^\p{Ll}"),
    )
    opened = marked.withColumn("start", F.last(F.when(F.col("begins"), place), ignorenulls=True).over(in_block))
    last_start = marked.groupBy("document_id", "block").agg(F.max(F.when(F.col("begins"), place)).alias("opened_here"))
    inherited = last_start.select(
        "document_id", "block", F.last("opened_here", ignorenulls=True).over(over_blocks.rowsBetween(W.unboundedPreceding, -1)).alias("inherited")
    )
    return (
        opened.join(inherited, ["document_id", "block"])
        .withColumn("start", F.coalesce("start", "inherited"))
        .groupBy("document_id", "start")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "at", "text"))), lambda x: x["text"]), " ").alias("text"))
        .select("document_id", F.col("start.page_number").alias("first_page"), F.col("start.at").alias("paragraph"), "text")
    )
