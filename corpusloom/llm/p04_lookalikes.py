"""Problem 4: visually identical text with different characters.

Method: confusables skeleton. A text is decomposed, every character is replaced by
the prototype it looks like (or by nothing, when it cannot be seen), and the
result is decomposed again. Texts with equal skeletons look the same. The look-alike table has the classes of the public
confusables data for the letters of Latin, Greek, Cyrillic, Armenian, Cherokee and Coptic, besides hyphens, spaces,
quotation marks, invisible characters and whatever is compatible with plain letters: ligatures, wide forms, mathematical and letter-like signs.

``consistent_form`` turns a text into one readable form: look-alike letters take the
script of their word, invisible characters go, special spaces become spaces,
and the result gets the Unicode normalization form asked for.

Scale: a map yields a 128-bit key of skeleton and text for each row, which is checkpointed, so that texts
are read once; the shuffle moves keys, not texts. Groups with only one spelling are dropped by a pre-aggregated
minimum and maximum before members are joined, so a hot group of plain copies
costs nothing; members of a hot look of several spellings are paired in blocks (``pairs.py``), and ``look_classes``
has one row for each of them instead of pairs.

Defined results: null and blank texts belong to no group; repeated rows of one id count
once; case, digits, wording, line breaks and real accents keep texts apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import pairs
from corpusloom.runtime import broadcast_if_small, checkpoint, spread

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԚԜаеѕіјорсухһԁԛԝѵҽ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYQWaesijopcyxhdqwve"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονιϲ"
GREEK_AS = "ABEZHIKMNOPTYXCjovic"
# Letters that look like Latin ones beside them, but are plain letters of their own script.
WEAK = "гӀӏѡүЬԌѴαρυγσϱϒϜϝ"
WEAK_AS = "rIlwybGVapuyopYFf"
# Armenian, Cherokee, Coptic and other Latin letters, and the plain letters they look like.
ARMENIAN = "ՍՕՏհոռսցօգզաք"
ARMENIAN_AS = "UOShnnugoqqwf"
CHEROKEE = "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏎᏏᏒᏔᏙᏚᏞᏟᏢᏦᏧᏩᏳᏴ"
CHEROKEE_AS = "DRTiyAJEWMHYGhZ4bRWVSLCPKdGGB"
COPTIC = "ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥⲅ"
COPTIC_AS = "ABHIKMNOPCTYXopcr"
LATIN = "ıɡſɑɩɪʋʏɣᴄᴏᴜᴠᴡᴢꜱ"
LATIN_AS = "igsaiiuyycouvwzs"
HYPHENS = "\u2010\u2011\u2012\u2013\u2212\ufe63\uff0d\u02d7\u2043"
APOSTROPHES = "\u2018\u2019\u201b\u02bc\u2032\uff07"
QUOTES = "\u201c\u201d\u201f\u2033\uff02"
SPACES = "\u00a0\u2002\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
)
_LETTERS = ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (WEAK, WEAK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (COPTIC, COPTIC_AS), (LATIN, LATIN_AS))


def _table() -> dict[int, str]:
    t = {ord(c): "-" for c in HYPHENS} | {ord(c): " " for c in SPACES} | {ord(c): "" for c in INVISIBLE}
    t |= {ord(c): "'" for c in APOSTROPHES} | {ord(c): '"' for c in QUOTES}
    t |= {c: "" for r in (range(0xFE00, 0xFE10), range(0xE0000, 0xE0080), range(0xE0100, 0xE01F0)) for c in r}  # variation selectors and tags
    t |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if c not in t}  # wide forms
    for s, d in _LETTERS:
        t |= {ord(a): b for a, b in zip(s, d, strict=True)}
    # ligatures, Roman numerals, letter-like and mathematical signs look like the letters and digits they are compatible with
    signs = (0x2026, *range(0x2100, 0x2150), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0x1D400, 0x1D800))
    for c in signs:
        plain = unicodedata.normalize("NFKD", chr(c))
        if c not in t and plain != chr(c) and (c == 0x2026 or plain.isalnum()):
            t[c] = "".join(t.get(ord(x), x) for x in plain)
    return t


PROTOTYPES = _table()


def skeleton(text: str) -> str:
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(PROTOTYPES))


_OWN = set(CYRILLIC + GREEK + WEAK + ARMENIAN + CHEROKEE + COPTIC)  # letters of words that may be in their own script
_KEEP = {c: s for c, s in PROTOTYPES.items() if chr(c) not in _OWN}
_STRONG = {ord(a): b for s, d in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS)) for a, b in zip(s, d)}
_TO_LATIN = {ord(a): b for s, d in _LETTERS[:-1] for a, b in zip(s, d)}
_TO_CYRILLIC = {ord(b): a for a, b in zip(CYRILLIC, CYRILLIC_AS) if "\u0410" <= a <= "\u044f"}
_TO_CYRILLIC |= {ord(g): _TO_CYRILLIC[ord(b)] for g, b in zip(GREEK, GREEK_AS) if ord(b) in _TO_CYRILLIC}
_WORD = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_ONLY_CYRILLIC = re.compile(r"[\u0400-\u04ff]")
_ONLY_GREEK = re.compile("[" + "".join(chr(c) for c in range(0x391, 0x3CA) if chr(c) not in GREEK + WEAK and chr(c).isalpha()) + "]")
_ONLY_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
_SHARED = set(CYRILLIC) | set(GREEK) | {chr(c) for c in _TO_CYRILLIC}


def consistent_form(text: str, form: str = "NFC") -> str:
    """One form for all texts of one look, normalized to ``form``.

    A word's letters take the script of those that only one script has, or that of the text where it has none; letters that
    merely resemble Latin ones do so only beside Latin letters.
    """
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_KEEP))

    def leaning(s: str) -> int:
        s = "".join(c for c in s if c not in _SHARED and c not in WEAK)
        return len(_ONLY_CYRILLIC.findall(s)) - len(_ONLY_LATIN.findall(s))

    whole = leaning(text)
    greek = not whole and bool(_ONLY_GREEK.search(text))

    def one_script(m: re.Match) -> str:
        own = leaning(m.group())
        if not own and (greek or _ONLY_GREEK.search(m.group())):
            return m.group()
        if (own or whole) > 0:
            return m.group().translate(_TO_CYRILLIC)
        return m.group().translate(_TO_LATIN if own else _STRONG)

    return unicodedata.normalize(form, _WORD.sub(one_script, text))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, looks, spellings = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i is None or not text:
                continue
            look = skeleton(text)
            if not look.strip():
                continue
            ids.append(i)
            looks.append(xxhash.xxh3_128_digest(look))
            spellings.append(looks[-1] if look == text else xxhash.xxh3_128_digest(text))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(looks, pa.binary()), pa.array(spellings, pa.binary())], ["id", "look", "spelling"]
        )


def look_groups(records: DataFrame, *, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, look, spelling) of the records whose look has more than one spelling."""
    src = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    keys = checkpoint(spread(src).mapInArrow(_keys, "id string, look binary, spelling binary"))
    mixed = keys.groupBy("look").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("look")
    return keys.join(broadcast_if_small(checkpoint(mixed)), "look").select("id", "look", "spelling").distinct()


def lookalike_pairs(groups: DataFrame) -> DataFrame:
    """Pairs of ids of one look and different spelling, smaller id first."""
    groups = checkpoint(groups)
    hot = pairs.hot_groups(groups.groupBy("look").agg(F.count("*").alias("n")), "look")
    met = pairs.cell_pairs(pairs.in_cells(groups, "look", "id", hot), "look", "id")
    return met.where("spelling_a <> spelling_b").select("id_a", "id_b").distinct()


def look_classes(groups: DataFrame) -> DataFrame:
    """(id, look_id, spelling_id, spellings, members): one row for each record whose look has several spellings, and the numbers of its look."""
    groups = checkpoint(groups)
    sizes = groups.groupBy("look").agg(F.count_distinct("spelling").alias("spellings"), F.count_distinct("id").alias("members"))
    return groups.join(sizes, "look").select("id", F.hex("look").alias("look_id"), F.hex("spelling").alias("spelling_id"), "spellings", "members")


def consistent_forms(records: DataFrame, *, forms: tuple[str, ...] = ("NFC",), id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, form, consistent): every record's text in one form for each normalization; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else consistent_form(t, "NFD") for t in batch.column(1).to_pylist()]
            for form in forms:
                out = [t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([form] * len(out), pa.string()), pa.array(out, pa.string())], ["id", "form", "consistent"])

    src = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return spread(src).mapInArrow(run, "id string, form string, consistent string")
