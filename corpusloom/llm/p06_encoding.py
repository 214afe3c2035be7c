"""Problem 6: garbled text from a wrong character encoding.

Method: best-first search. From a garbled run the search goes on along the operations
"encode in one code page, decode in another" and "unescape", always from the
cheapest text reached so far; texts already seen are not visited again. The cost of
a text is how implausible its characters are: letters of the eight languages and
common signs are cheap, control characters, box drawings, stray symbols and capitals
within words are dear. The cheapest text reached replaces the run if it is cheaper by
a margin and a decoding lies on its path.

Runs of unusual characters and escapes are searched one by one (each task remembers
the runs it has met, of which there are few); decoding and unescaping shorten a run, so the search ends when no
new text can be reached. Cyrillic sentences and words of Latin letters that stand for Cyrillic ones,
whose single-byte mix-ups only swap letters, are searched along all pairs of code pages. A further step
must bring more the longer the path, so the search ends when even the plainest text at the next step
would score worse than the best one found.

Scale: a map over the rows, without a shuffle; plain ASCII without escapes is passed through.

Defined results: null and empty texts aren't affected; U+FFFD and what is left of a sequence that lost a byte are affected, and not
restorable; a plain entity or escape without a wrong decoding isn't affected;
repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import spread

# Code pages tried; unusual letters of Western languages and Russian letters, by frequency.
WRONG_PAGES = ("cp1252", "latin-1", "cp437", "mac-roman", "cp1251", "cp850", "cp1250", "koi8-r", "cp866", "mac-cyrillic", "iso8859-15")
LATIN_PAGES = ("cp1252", "mac-roman", "cp437", "cp850")
CYRILLIC_PAGES = ("cp1251", "koi8-r", "cp866", "mac-cyrillic", "iso8859-5")
WESTERN = "€éáóíàèüäöñãçêúßùâôîõìòïëœ’“”–—…°¿¡ûÜÄÖÉÁÀÇÃÈÊÚÍÓÕÒÙÏÔÎÂÑÌ"
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"

_ESCAPE = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}"
_RUN = re.compile(rf"(?:[^\x00-\x7f]+|{_ESCAPE})+")
_UNUSUAL = re.compile(r"[^\x00-\x7f][^\x00-\x7f]*")  # the runs of a text without escapes
_BACKSLASH = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_MULTI = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_CYRILLIC = re.compile(r"[\u0400-\u045f]")
_SENTENCE = re.compile(r"[^.!?\n]+")
# left over when a byte was lost: the first characters of two- and three-byte sequences
_REMNANT = re.compile(r"â€|â\u0080|‚Ä|ΓÇ|[ÃÂ](?=[^\w\s\"'’”)]|\s(?=[a-z])|$)|(?<=[a-z])[ÃÂ](?![A-ZÀ-Ý])|[├√](?=[^\s─-▟])|[\u0080-\u009f]")
_REMNANT_SIGN = re.compile(r"[âÃÂ‚Γ├√\u0080-\u009f]")  # what a remnant begins with
_COMMON = "‘’“”„‚–—…€•°¿¡«»™‐‑№" + "\u00a0\u00ad\u2009\u202f"
_MARGIN = 0.9
_PLAIN = 1.12  # what a letter costs on average in plain Russian, at most


def _byte_map(page: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b  # undefined bytes pass as controls
    return out


_TO_BYTE = {page: _byte_map(page) for page in {*WRONG_PAGES, *LATIN_PAGES, *CYRILLIC_PAGES}}


@lru_cache(4096)
def _char_cost(c: str) -> float:
    o = ord(c)
    if o < 128:
        return 0.0
    if c in _COMMON:
        return 1.0
    if c in WESTERN:
        return 1.0
    if 0xC0 <= o <= 0xFF and c not in "×÷ÐðÞþ":
        return 1.7
    if 0x410 <= o <= 0x44F or c in "ёЁ":
        return 1.0
    if 0xFB00 <= o <= 0xFB06:
        return 1.2
    if o == 0xFFFD:
        return 8.0
    if 0x80 <= o <= 0x9F:
        return 4.0
    return 2.5 if o < 0x500 else 3.0


def run_cost(text: str) -> float:
    """Implausibility of the unusual characters of a text; escapes are dear as they stand."""
    cost = sum(map(_char_cost, text))
    cost += 1.5 * len(re.findall(_ESCAPE, text))
    for a, b in zip(text, text[1:]):
        if a.isupper() and ord(a) > 127 and not (b.isalpha() or b.isspace()):
            cost += 0.5
    return cost


def _from_utf8(text: str, page: str) -> str:
    """Sequences of ``page`` characters whose bytes are UTF-8, decoded; the rest as it is."""
    to_byte = _TO_BYTE[page]
    out, i, n = [], 0, len(text)
    while i < n:
        raw = bytearray()
        j = i
        while j < n and text[j] in to_byte:
            raw.append(to_byte[text[j]])
            j += 1
        if j == i:
            out.append(text[i])
            i += 1
            continue
        at = 0
        for m in _MULTI.finditer(bytes(raw)):
            try:
                good = m.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out.append(text[i + at : i + m.start()])
            out.append(good)
            at = m.end()
        out.append(text[i + at : j])
        i = j
    return "".join(out)


def _unescaped(text: str) -> str:
    return html.unescape(_numeric(_BACKSLASH.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)), text)))


def _numeric(text: str) -> str:
    """Numeric entities of C1 controls stay what they say, unlike in HTML."""
    return re.sub(r"&#(12[89]|1[345]\d);", lambda m: chr(int(m.group(1))), text)


def _search(start: str, steps, cost) -> tuple[str, tuple[str, ...]]:
    """Best-first search for the cheapest text that can be reached; its path of operations."""
    seen = {start}
    queue = [(cost(start), 0, start, ())]
    best = queue[0]
    order = 0
    while queue:
        here = heapq.heappop(queue)
        if here[0] < best[0] - 1e-9:
            best = here
        for name, to in steps(here[2]):
            if to not in seen:
                seen.add(to)
                order += 1
                heapq.heappush(queue, (cost(to), order, to, (*here[3], name)))
    return best[2], best[3]


def _run_steps(text: str):
    if "&" in text or "\\" in text:
        yield "unescape", _unescaped(text)
    if not text.isascii():
        for page in WRONG_PAGES:
            yield f"{page}>utf-8", _from_utf8(text, page)


@lru_cache(50_000)
def restore_run(run: str) -> tuple[str, tuple[str, ...]]:
    text, path = _search(run, _run_steps, run_cost)
    if any(">" in p for p in path) and run_cost(text) <= run_cost(run) - _MARGIN and all(_char_cost(c) <= 1.7 or c in run for c in text):
        return text, path
    return run, ()


_RANK = {c: k / 8 for k, c in enumerate(RUSSIAN)}


@lru_cache(4096)
def _letter_cost(c: str) -> tuple[float, float, bool]:
    """What a character costs, what it costs more within a word, and whether a word goes on after it."""
    if c.isalpha() and ord(c) > 127:
        return _RANK.get(c.lower(), 4.5), 0.7 if c.isupper() else 0.0, True
    return 0.0 if ord(c) < 128 else _char_cost(c) * 1.5, 0.0, c.isalpha()


def letters_cost(text: str) -> float:
    """Implausibility of a sentence as Russian: rare letters, capitals within words, other letters."""
    cost, inside = 0.0, False
    for alone, within, goes_on in map(_letter_cost, text):
        cost += alone
        if inside:
            cost += within
        inside = goes_on
    return cost


def _transcoded(text: str, a: str, b: str) -> str:
    """The unusual characters of ``text`` as the bytes of page ``a``, read in page ``b``."""
    to_byte, out = _TO_BYTE[a], []
    for c in text:
        byte = to_byte.get(c)
        try:
            out.append(c if byte is None else bytes([byte]).decode(b))
        except UnicodeDecodeError:
            out.append(c)
    return "".join(out)


_LATIN_RANK = {c: k / 20 for k, c in enumerate(WESTERN)}
_LOOKALIKE = set("АВЕЅІЈКМНОРСТУХаеорсухіѕј")
#: Cyrillic letters inside Latin words, short ones on their own, and a sign before an amount
_STRAY = re.compile(r"(?<=[A-Za-zÀ-ÿ])[\u0400-\u04ff]+|[\u0400-\u04ff]+(?=[A-Za-zÀ-ÿ])|(?<![\u0400-\u04ff])[\u0400-\u04ff\u2500-\u259f]{1,2}(?![\u0400-\u04ff])|[\u0402](?=\d)")
_PAGES = (*CYRILLIC_PAGES, *LATIN_PAGES)
_SWAPS = tuple((a, b) for a in _PAGES for b in _PAGES if a != b)
_ALPHABET = "".join(sorted({c for page in _PAGES for c in _TO_BYTE[page]}))
_PLACE = {c: k for k, c in enumerate(_ALPHABET)}
_MOVES = np.array([[_PLACE[_transcoded(c, a, b)] for c in _ALPHABET] for a, b in _SWAPS], np.int32)
#: words of unusual characters that Latin pages have, but for dashes, quotation marks and the like
_LATIN_SIGNS = "".join(sorted({c for page in LATIN_PAGES for c in _TO_BYTE[page]} - set(_COMMON)))
_WEST_WORDS = re.compile(rf"[^\x00-\x7f\s]*[{re.escape(_LATIN_SIGNS)}]{{4}}[^\x00-\x7f]*(?:[\s,.;:–—-]+[^\x00-\x7f\s]+)*")
_STRETCH = re.compile(r"[^\x00-\x7f]+(?:[\s,.;:-]+[^\x00-\x7f]+)*")
_ODD = re.compile(rf"[{re.escape(_LATIN_SIGNS)}]{{4}}")


def _western_cost(text: str) -> float:
    return sum(_LATIN_RANK.get(c, 4.0) for c in text if ord(c) > 127)


def _cost_table(cost) -> np.ndarray:
    """What each character of the alphabet costs at the begin of a word and within one."""
    return np.array([[cost(c) for c in _ALPHABET], [cost("я" + c) - cost("я") for c in _ALPHABET]])


class Swaps:
    """Best-first search along single-byte mix-ups, which take each character to another whatever stands beside it.

    A path of d steps is taken if the cost falls below ``first * further ** (d - 1)`` of what it was. ``plain`` is what a letter costs in
    the plainest text, so that no path goes on that couldn't be taken any more; a text of at most ``good`` a letter comes before all others.
    """

    def __init__(self, cost, plain: float, good: float, first: float, further: float):
        self.table, self.plain, self.good, self.first, self.further = _cost_table(cost), plain, good, first, further

    def trust(self, steps: int) -> float:
        return self.first * self.further ** (steps - 1) if steps else 1.0

    def __call__(self, text: str) -> tuple[str, tuple[str, ...]]:
        met: dict[tuple[int, int], int] = {}
        before = ""
        for c in text:
            if c in _PLACE:
                key = (_PLACE[c], int(before.isalpha()))
                met[key] = met.get(key, 0) + 1
            before = c
        if not met:
            return text, ()
        at, inside = np.array(list(met), np.int32).T
        count = np.array(list(met.values()))
        least, order = self.plain * count.sum(), 0
        score = float((self.table[inside, at] * count).sum())
        best: tuple[float, tuple[int, ...]] = (score, ())
        other = best
        seen = {at.tobytes()}
        queue = [(score, 0, at, ())]
        while queue:
            _, _, at, path = heapq.heappop(queue)
            steps = len(path) + 1
            if least / self.trust(steps) >= min(best[0], other[0]):
                continue
            after = _MOVES[:, at]
            costs = (self.table[inside, after] * count).sum(axis=1)
            scores = costs / self.trust(steps)
            good = costs <= self.good * count.sum()
            fine, rest = np.where(good, scores, np.inf), np.where(good, np.inf, scores)
            k = int(fine.argmin())
            if fine[k] < best[0] - 1e-9:
                best = (float(fine[k]), (*path, k))
            k = int(rest.argmin())
            if rest[k] < other[0] - 1e-9:
                other = (float(rest[k]), (*path, k))
            if least / self.trust(steps + 1) >= min(best[0], other[0]):
                continue  # no text beyond these could be taken
            for op in np.argsort(scores, kind="stable"):
                key = after[op].tobytes()
                if key not in seen:
                    seen.add(key)
                    order += 1
                    heapq.heappush(queue, (float(scores[op]), order, after[op], (*path, int(op))))
        found = best[1] or other[1]
        for op in found:
            text = _transcoded(text, *_SWAPS[op])
        return text, tuple(">".join(_SWAPS[op]) for op in found)


_AS_RUSSIAN = Swaps(letters_cost, 0.9, 1.25, 0.75, 0.65)
_AS_WESTERN = Swaps(_western_cost, 0.5, 2.0, 1.0, 0.1)  # a few strays don't tell more than one step


def _restore_letters(text: str) -> tuple[str, tuple[str, ...]]:
    """Single-byte mix-ups: they turn letters into other letters, one for one."""
    paths: tuple[str, ...] = ()
    if _CYRILLIC.search(text) and re.search("[A-Za-z]", text):
        stray = "".join(_STRAY.findall(text))
        if stray and not set(stray) <= _LOOKALIKE and len(stray) > 0.3 * len(_CYRILLIC.findall(text)):
            out, path = _AS_WESTERN(stray)
            if path and _western_cost(out) <= 2.0 * len(stray):
                text = _STRAY.sub(lambda m: _swapped(m.group(), path), text)
                paths += path

    def western(m: re.Match) -> str:
        nonlocal paths
        s = m.group()
        if len(set(s)) < 4:
            return s  # a ruled line
        out, path = _AS_RUSSIAN(s)
        n = len(_CYRILLIC.findall(out))
        if path and n >= 4 and letters_cost(out) < 1.6 * n:
            paths += path
            return out
        return s

    def sentence(m: re.Match) -> str:
        nonlocal paths
        s = m.group()
        n = len(_CYRILLIC.findall(s))
        before = letters_cost(s)
        if n < 4 or before < 1.35 * n:
            return s
        out, path = _AS_RUSSIAN(s)
        if path and letters_cost(out) < _AS_RUSSIAN.trust(len(path)) * before:
            paths += path
            return out
        return s

    def stretch(m: re.Match) -> str:
        if not _ODD.search(m.group()):
            return m.group()
        out = western(m)
        return out if out != m.group() else _WEST_WORDS.sub(western, out)  # only a part of it may be garbled

    text = _STRETCH.sub(stretch, text)
    if _CYRILLIC.search(text):
        text = _SENTENCE.sub(sentence, text)
    return text, paths


def _swapped(text: str, path: tuple[str, ...]) -> str:
    for step in path:
        text = _transcoded(text, *step.split(">"))
    return text


def restore(text: str) -> tuple[str, tuple[str, ...], bool]:
    """The restored text, the operations on the way, and whether the text was affected."""
    if text.isascii() and "&" not in text and "\\" not in text:
        return text, (), False
    fixed, path = _restore_runs(text)
    signs = " ".join(_runs(fixed))  # each run once tells what kinds of characters there are
    if _CYRILLIC.search(signs) or _ODD.search(signs):
        swapped, ops = _restore_letters(fixed)
        n = len(_CYRILLIC.findall(swapped))
        if path and n and letters_cost(swapped) > _PLAIN * n:  # what looked like sequences of bytes may have been letters
            first, ops_first = _restore_letters(text)
            other, path_other = _restore_runs(first)
            if ops_first and letters_cost(other) < letters_cost(swapped):
                swapped, path, ops = other, ops_first, path_other
        if swapped != fixed:
            signs = swapped
        fixed, path = swapped, (*path, *ops)
    path = tuple(dict.fromkeys(path))
    affected = bool(path) or "\ufffd" in fixed or bool(_REMNANT_SIGN.search(signs) and _REMNANT.search(fixed))
    return fixed, path, affected


_kept: set[str] = set()  # runs met in this task that stay as they are


def _runs(text: str) -> set[str]:
    return set((_RUN if "&" in text or "\\" in text else _UNUSUAL).findall(text))


def _restore_runs(text: str) -> tuple[str, tuple[str, ...]]:
    new = _runs(text) - _kept
    stay = [run for run in new if not restore_run(run)[1]]
    if len(_kept) > 50_000:
        _kept.clear()
    _kept.update(stay)
    if len(stay) == len(new):
        return text, ()
    path: dict[str, None] = {}

    def one(m: re.Match) -> str:
        out, ops = restore_run(m.group())
        path.update(dict.fromkeys(ops))
        return out

    return _RUN.sub(one, text), tuple(path)


_RESTORED = "id bigint, affected boolean, restored string, operations array<string>"


def _restorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            if text is None:
                rows.append((False, None, []))
            else:
                fixed, path, affected = restore(text)
                rows.append((affected, fixed, list(path)))
        kinds = [pa.bool_(), pa.string(), pa.list_(pa.string())]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], ["id", "affected", "restored", "operations"])


def restored_texts(records: DataFrame, *, id_col: str = "result_id", text_col: str = "original_text") -> DataFrame:
    """Every record's (id, affected, restored, operations)."""
    src = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return spread(src).mapInArrow(_restorer, _RESTORED)
