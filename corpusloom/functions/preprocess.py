"""Preprocessing steps, presets, quality score and type of a text, as column expressions."""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.text import normalizer, strip, tokens

# Patterns of the steps.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
TAG = r"<[^>]+>"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
CITATION = r"\[[0-9,\s-]+\]|\([A-Za-z]+\s+et\s+al\.?,?\s+[0-9]{4}\)"
CODE = r"```[\s\S]*?```|`[^`]+`"
HEADING = r"(?m)^#{1,6}\s+"
LINK = r"\[([^\]]+)\]\([^\)]+\)"
PUNCTUATION = r"[!?]{2,}|[.]{3,}"

# Contractions and their long forms.
CONTRACTIONS = {
    "ain't": "is not", "aren't": "are not", "can't": "cannot", "couldn't": "could not", "didn't": "did not", "doesn't": "does not",
    "don't": "do not", "hadn't": "had not", "hasn't": "has not", "haven't": "have not", "he'd": "he would", "he'll": "he will",
    "he's": "he is", "i'd": "i would", "i'll": "i will", "i'm": "i am", "i've": "i have", "isn't": "is not", "it'd": "it would",
    "it'll": "it will", "it's": "it is", "let's": "let us", "shouldn't": "should not", "that's": "that is", "there's": "there is",
    "they'd": "they would", "they'll": "they will", "they're": "they are", "they've": "they have", "we'd": "we would", "we're": "we are",
    "we've": "we have", "weren't": "were not", "what's": "what is", "where's": "where is", "who's": "who is", "won't": "will not", "wouldn't": "would not",
    "you'd": "you would", "you'll": "you will", "you're": "you are", "you've": "you have",
}

# Words that give a text its type, first match first.
TYPES = (
    ("academic", ("abstract", "methodology", "conclusion", "references")),
    ("code", ("function", "class", "import", "return")),
    ("legal", ("plaintiff", "defendant", "court", "legal")),
    ("medical", ("patient", "diagnosis", "treatment", "medical")),
    ("social_media", ("@", "#", "lol", "omg")),
)


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


@F.pandas_udf(StringType())
def unescape_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, " ")


def mask_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " [URL] ")


def mask_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, " [EMAIL] ")


def mask_phones(c: Column) -> Column:
    return F.regexp_replace(c, PHONE, " [PHONE] ")


def remove_citations(c: Column) -> Column:
    return F.regexp_replace(c, CITATION, "")


def mask_code(c: Column) -> Column:
    return F.regexp_replace(c, CODE, " [CODE] ")


def strip_markdown(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, HEADING, ""), LINK, "$1")


def calm_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, ".")


def expand_contractions(c: Column) -> Column:
    """Known contractions in full, words joined by one space.

    A word is known by its lower case without marks at its ends; the long form takes a capital where the
    word begins with one. What isn't a letter or digit in a replaced word, its apostrophe included, is put behind it.
    """
    table = F.create_map(*[F.lit(x) for pair in CONTRACTIONS.items() for x in pair])

    def one(w: Column) -> Column:
        long = F.element_at(table, F.regexp_replace(F.lower(w), r"""^[.,!?;:"]+|[.,!?;:"]+$""", ""))
        shown = F.when(w.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(long, 1, 1)), F.substring(long, 2, 100))).otherwise(long)
        return F.when(long.isNull(), w).otherwise(F.concat(shown, F.regexp_replace(w, r"[a-zA-Z0-9]", "")))

    return F.array_join(F.transform(tokens(c), one), " ")


_CAPS = r"^\p{Lu}{2,}$"
_CAPITALISED = r"^\p{Lu}"


def smart_lowercase(c: Column) -> Column:
    """Lower case but for words in capitals and capitalised words within a sentence."""
    words = tokens(c)
    before = F.concat(F.array(F.lit(".")), words)  # each word's word before; one more than words, which the join leaves out

    def one(w: Column, before: Column) -> Column:
        return F.when(w.rlike(_CAPS) | (w.rlike(_CAPITALISED) & ~before.rlike(r"[.!?]$")), w).otherwise(F.lower(w))

    return F.array_join(F.zip_with(words, before, one), " ")


def collapse_whitespace(c: Column, preserve_paragraphs: bool = True) -> Column:
    """Runs of white space as one space, blank lines included (as observed, paragraphs don't survive)."""
    c = F.regexp_replace(c, r"\n{3,}", "\n\n") if preserve_paragraphs else F.regexp_replace(c, r"\n+", " ")
    return strip(F.regexp_replace(c, r"\s{2,}", " "))


@F.pandas_udf(StringType())
def remove_accents(texts: pd.Series) -> pd.Series:
    import unicodedata

    def one(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        return "".join(ch for ch in unicodedata.normalize("NFD", t) if unicodedata.category(ch) != "Mn")

    return texts.map(one)


def custom(c: Column, patterns: list[tuple[str, str]]) -> Column:
    for pattern, to in patterns:
        c = F.regexp_replace(c, pattern, to)
    return c


def quality_score(
    c: Column, *, min_length: int = 10, max_length: int = 100_000, min_words: int = 3, max_repetition: float = 0.3, min_letters: float = 0.5
) -> Column:
    """Between 0 and 1: length, words, share of letters, repetition and sentence ends."""
    n, words = F.length(c), tokens(c)
    count = F.size(words)
    alpha = F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / n
    repetition = F.lit(1.0) - F.size(F.array_distinct(words)) / count
    score = (
        F.lit(1.0)
        * F.when(n < min_length, 0.5).otherwise(1.0)
        * F.when(n > max_length, 0.8).otherwise(1.0)
        * F.when(count < min_words, 0.6).otherwise(1.0)
        * F.when(alpha < min_letters, alpha / min_letters).otherwise(1.0)
        * F.when((count > 1) & (repetition > max_repetition), F.lit(1.0) - repetition).otherwise(1.0)
        * F.when(c.rlike(r"[.!?]"), 1.1).otherwise(1.0)
    )
    return F.when(strip(c) == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def text_type(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit("general")
    for name, words in reversed(TYPES):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


@dataclass(frozen=True)
class Settings:
    """Which steps run; the order is fixed."""

    fix_encoding: bool = True
    unicode_form: str | None = "NFKC"
    urls: bool = True
    emails: bool = True
    phones: bool = True
    citations: bool = False
    code: bool = False
    punctuation: bool = True
    contractions: bool = False
    smart_case: bool = False
    lower_case: bool = False
    accents: bool = False
    whitespace: bool = True
    patterns: list[tuple[str, str]] = field(default_factory=list)


def preset(level: str = "standard", text_type: str = "general") -> Settings:
    """The steps of a level; ``custom`` starts from the standard ones."""
    s = Settings()
    if level == "minimal":
        s = replace(s, urls=False, emails=False)
    elif level == "aggressive":
        s = replace(s, citations=True, code=True, contractions=True, lower_case=True)
    elif level not in ("standard", "custom"):
        raise ValueError(f"unknown level {level}")
    if text_type == "academic":
        s = replace(s, citations=False, smart_case=s.lower_case, lower_case=False)
    elif text_type == "code":
        s = replace(s, code=False, punctuation=False, lower_case=False)
    elif text_type == "social_media":
        s = replace(s, contractions=True, punctuation=True)
    return s


def _steps(s: Settings) -> list[tuple[str, Callable[[Column], Column]]]:
    """The steps after the repair of the encoding, in their order, by the names they are reported with."""
    form = s.unicode_form
    found = [
        (form, "unicode_normalized", lambda c: normalizer(form)(c)),
        (True, "non_printable_removed", strip_control),
        (True, "html_cleaned", lambda c: strip_tags(unescape_entities(c))),
        (s.urls, "urls_removed", mask_urls), (s.emails, "emails_removed", mask_emails), (s.phones, "phones_removed", mask_phones),
        (s.citations, "citations_removed", remove_citations), (s.code, "code_blocks_removed", mask_code),
        (True, "markdown_cleaned", strip_markdown),
        (s.punctuation, "punctuation_normalized", calm_punctuation), (s.contractions, "contractions_expanded", expand_contractions),
        (s.smart_case, "smart_lowercase", smart_lowercase), (s.lower_case, "lowercase", F.lower),
        (s.accents, "accents_removed", remove_accents), (s.whitespace, "whitespace_normalized", collapse_whitespace),
    ]
    found += [(True, "custom_pattern_applied", lambda c, p=p: custom(c, [p])) for p in s.patterns]
    return [(name, step) for on, name, step in found if on]


def preprocess(c: Column, s: Settings | None = None) -> Column:
    s = s or Settings()
    if s.fix_encoding:
        c = F.make_valid_utf8(c)
    for _, step in _steps(s):
        c = step(c)
    return strip(c)


def preprocess_results(texts: DataFrame, s: Settings | None = None, *, text_col: str = "original_text", level: str = "standard") -> DataFrame:
    """The rows with ``processed_text``, ``quality_score``, ``text_type``, ``transformations`` and ``metadata``.

    A null or blank text has an empty processed text, the quality 0, no type and the one transformation ``empty_input``. Columns
    of these names are replaced.
    """
    s = s or Settings()
    text = F.col(text_col)
    blank = F.coalesce(strip(text) == "", F.lit(True))
    done = texts.withColumn("processed_text", F.when(blank, F.lit("")).otherwise(preprocess(text, s)))
    after = F.col("processed_text")
    names = F.array(*[F.lit(n) for n, _ in _steps(s)])
    if s.fix_encoding:
        names = F.when(F.make_valid_utf8(text) != text, F.concat(F.array(F.lit("encoding_fixed")), names)).otherwise(names)
    n, m = F.length(text), F.length(after)
    done = done.withColumn("transformations", F.when(blank, F.array(F.lit("empty_input"))).otherwise(names))
    metadata = F.struct(
        n.alias("original_length"), m.alias("processed_length"), (m / n).alias("compression_ratio"), F.size(tokens(after)).alias("word_count"),
        F.regexp_count(after, F.lit("[.!?]")).alias("sentence_count"), F.lit(level).alias("preprocessing_level"), F.size("transformations").alias("transformations_count"),
    )
    return done.withColumns({
        "quality_score": F.when(blank, F.lit(0.0)).otherwise(quality_score(after)),
        "text_type": F.when(~blank, text_type(after)),
        "metadata": F.when(~blank, metadata),
    })
