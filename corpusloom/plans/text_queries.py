"""Queries over document texts: cleaning, preprocessing, tokens and chunking, with their SQL.

Most patterns never occur in the raw texts, so both sides append the same noise.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.config import ChunkSettings
from corpusloom.functions import preprocess as P
from corpusloom.functions import text as T
from corpusloom.functions import tokens as K
from corpusloom.operators import chunking
from corpusloom.sources import pages
from corpusloom.runtime import spread, table

NOISE = (
    "\n\n<b>Bold &amp; more</b>  see https://example.org/a?b=1 or mail a.b@example.org , call (555) 123-4567 !!!\n\n\n\n 42 \n\n"
    "Results [1, 2] by (Smith et al., 2020) ; it's fine, don't worry... Where's it? \"Who's there,\" he'd say. A bro-\nken word. `code` and ```x = 1```\n"
    "## Heading here\nA [label](http://example.org/x) for NASA and the European Union.\x07 “Quoted” – text… done"
)


# Fixed values of the SQL side, written out on their own so that a wrong value of the operators shows.
SQL_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
SQL_TAG = r"<[^>]+>"
SQL_URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
SQL_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
SQL_PHONE = r"(\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
SQL_CITATION = r"\[[0-9,\s-]+\]|\([A-Za-z]+\s+et\s+al\.?,?\s+[0-9]{4}\)"
SQL_CODE = r"```[\s\S]*?```|`[^`]+`"
SQL_HEADING = r"(?m)^#{1,6}\s+"
SQL_LINK = r"\[([^\]]+)\]\([^\)]+\)"
SQL_MARKS = r"[!?]{2,}|[.]{3,}"
SQL_NOT_PLAIN = r"""[^a-zA-Z0-9\s.,!?;:()\-"'\n]"""
SQL_ARTIFACTS = ((r"-\s*\n\s*", ""), (r"\s+([,.!?;:])", r"\1"), (r"([.!?])[ \t]+([A-Z])", r"\1 \2"), (r" {2,}", " "), (r"(?m)^\s*\d+\s*$", ""))
SQL_LONG_FORMS = """
    ain't=is not|aren't=are not|can't=cannot|couldn't=could not|didn't=did not|doesn't=does not|don't=do not|hadn't=had not|hasn't=has not|haven't=have not|
    he'd=he would|he'll=he will|he's=he is|i'd=i would|i'll=i will|i'm=i am|i've=i have|isn't=is not|it'd=it would|it'll=it will|it's=it is|let's=let us|
    shouldn't=should not|that's=that is|there's=there is|they'd=they would|they'll=they will|they're=they are|they've=they have|we'd=we would|we're=we are|
    we've=we have|weren't=were not|what's=what is|where's=where is|who's=who is|won't=will not|wouldn't=would not|you'd=you would|you'll=you will|
    you're=you are|you've=you have
"""
SQL_TYPES = (
    "academic: abstract methodology conclusion references", "code: function class import return", "legal: plaintiff defendant court legal",
    "medical: patient diagnosis treatment medical", "social_media: @ # lol omg",
)


def _sql(text: str) -> str:
    out = "'" + text.replace("'", "''") + "'"
    return out.replace("\x07", "' || chr(7) || '")


_N = f"(text || {_sql(NOISE)})"


def _docs(spark, base):
    return spread(table(spark, base, "documents").select("doc_id", "text"))


def _noisy(spark, base):
    return _docs(spark, base).select("doc_id", F.concat("text", F.lit(NOISE)).alias("text"))


def _hashed(make):
    """(doc_id, chars, hash) of a text expression over the noisy documents."""
    return lambda spark, base: _noisy(spark, base).select("doc_id", make(F.col("text")).alias("t")).select(
        "doc_id", F.length("t").alias("chars"), F.md5(F.encode("t", "UTF-8")).alias("hash")
    )


def _sql_hashed(expr: str) -> str:
    return f"WITH x AS (SELECT doc_id, {expr} AS t FROM documents) SELECT doc_id, length(t) AS chars, md5(t) AS hash FROM x"


def _rx(expr: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({expr}, {_sql(pattern)}, {_sql(to)}, '{flags}')"


def _strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def _artifacts(e: str) -> str:
    for pattern, to in SQL_ARTIFACTS:
        e = _rx(e, pattern, to)
    return e


def _literals(e: str) -> str:
    e = f"nfc_normalize({e})"
    for a, b in (("chr(8216)", "'"), ("chr(8217)", "'"), ("chr(8220)", '"'), ("chr(8221)", '"'), ("chr(8211)", "-"), ("chr(8212)", "--"), ("chr(8230)", "..."),
                 ("chr(160)", " "), ("chr(8203)", ""), ("chr(65279)", "")):
        e = f"replace({e}, {a}, {_sql(b)})"
    return e


def _whitespace(e: str) -> str:
    return f"""array_to_string(list_filter(list_transform(string_split({e}, chr(10) || chr(10)),
        lambda p: regexp_replace({_strip('p')}, '\\s+', ' ', 'g')), lambda p: p <> ''), chr(10) || chr(10))"""


def _clean(e: str) -> str:
    return _strip(_rx(_whitespace(_artifacts(_literals(e))), r"\n{3,}", "\n\n"))


def _tokens(e: str) -> str:
    return rf"list_filter(string_split_regex({_strip(e)}, '\s+'), lambda x: x <> '')"


def _sentences(e: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({e}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: length(s) > 10)"


_CLEAN = _clean(_N)
_LINES = "(length({0}) - length(replace({0}, chr(10), '')))"


def cleaning_stats(spark, base):
    d = _noisy(spark, base).withColumn("after", T.clean_text(F.col("text")))
    return d.select("doc_id", *[c.alias(n) for n, c in T.cleaning_stats(F.col("text"), F.col("after")).items()])


def sentences(spark, base):
    d = _docs(spark, base).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("at", "s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"), F.max(F.length("s")).alias("longest"))


def paragraphs(spark, base):
    return _docs(spark, base).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("at", "p")).select(
        "doc_id", "at", F.md5(F.encode("p", "UTF-8")).alias("hash")
    )


def text_statistics(spark, base):
    return _docs(spark, base).select("doc_id", *[c.alias(n) for n, c in T.text_statistics(F.col("text")).items()])


def header_footer_removal(spark, base):
    d = _docs(spark, base).select("doc_id", F.concat(F.lit("Head\n"), F.replace("text", F.lit(". "), F.lit(".\nHead\n")), F.lit("\nHead\nfoot")).alias("text"))
    return pages.remove_running_lines(d).select(F.col("id").alias("doc_id"), F.md5(F.encode("text", "UTF-8")).alias("hash"), "lines_removed")


def whole_document_text(spark, base):
    """Page texts put together; the parts of a page come in their order."""
    c = table(spark, base, "preprocessing_results").where("page_number is not null and original_text is not null")
    p = c.groupBy("document_id", "page_number").agg(F.min("original_text").alias("text"))
    return pages.whole_texts(p).select("document_id", F.length("text").alias("chars"), F.md5(F.encode("text", "UTF-8")).alias("hash"))


def pdf_metadata_cleanup(spark, base):
    c = table(spark, base, "processing_results").where("metadata is not null").dropDuplicates(["run_id"])
    noisy = F.map_concat(F.transform_keys("metadata", lambda k, _: F.upper(k)), F.create_map(F.lit("NOTE"), F.lit("  "), F.lit("Kind"), F.lit(" pdf ")))
    return c.select("run_id", F.explode(pages.clean_metadata(noisy)).alias("key", "value"))


def _files(spark, base):
    """The files of the runs; their sizes are made from their names, as the log has none."""
    files = table(spark, base, "processing_results").select(F.col("file_path").alias("path")).distinct()
    return files.withColumn("length", (F.length("path") - 12).cast("bigint") * 1024 * 1024)


def source_validation(spark, base):
    """What is wrong with which files; those without an error go on."""
    good, bad = pages.validated(_files(spark, base), max_mb=10)
    return bad.unionByName(good.select("path", F.lit("").alias("error")))


def source_file_info(spark, base):
    return pages.file_info(_files(spark, base).withColumn("modificationTime", F.lit(0))).select("path", "file_name", "file_size_bytes")


def text_quality(spark, base):
    return _docs(spark, base).select("doc_id", F.round(P.quality_score(F.col("text")), 6).alias("quality"))


def text_types(spark, base):
    return _docs(spark, base).groupBy(P.text_type(F.col("text")).alias("text_type")).agg(F.count("*").alias("n"))


_PLAIN_STEPS = P.Settings(fix_encoding=False, unicode_form=None)


def preprocess_metadata(spark, base):
    """The whole result of preprocessing; SQL has no NFKC, so the Unicode step is left out on both sides. One text in ten is blanked."""
    d = _noisy(spark, base).withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.lit("  ")).otherwise(F.col("text")))
    r = P.preprocess_results(d, _PLAIN_STEPS, text_col="text")
    m = F.col("metadata")
    return r.select(
        "doc_id", F.md5(F.encode("processed_text", "UTF-8")).alias("hash"), F.round("quality_score", 6).alias("quality"), "text_type",
        F.array_join("transformations", ",").alias("transformations"), m["original_length"].alias("original_length"), m["processed_length"].alias("processed_length"),
        F.round(m["compression_ratio"], 6).alias("compression_ratio"), m["word_count"].alias("words"), m["sentence_count"].alias("sentence_marks"),
        m["preprocessing_level"].alias("level"), m["transformations_count"].alias("steps"),
    )


def preprocess_standard(spark, base):
    return _hashed(lambda c: P.preprocess(c, P.preset("standard")))(spark, base)


def preprocess_aggressive(spark, base):
    return _hashed(lambda c: P.preprocess(c, P.preset("aggressive")))(spark, base)


def _vocabulary(spark, base):
    return table(spark, base, "eval_items").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()


def compression(spark, base):
    d = _docs(spark, base)
    return d.select("doc_id", F.round(K.compression_ratio(F.size(T.tokens(F.col("text"))), F.length("text")), 6).alias("ratio"))


def subwords(spark, base):
    marked = F.transform(T.tokens(F.col("text")), lambda t: F.when(F.length(t) > 7, F.concat(F.lit("##"), t)).otherwise(t))
    return _docs(spark, base).select("doc_id", F.round(K.subword_ratio(marked), 6).alias("ratio"))


_S = ChunkSettings(1000, 200, 100)


def fixed_chunks(spark, base):
    c = chunking.fixed_chunks(_docs(spark, base), _S)
    return c.select(F.col("id").alias("doc_id"), "chunk_index", "start_char", "end_char", F.md5(F.encode("content", "UTF-8")).alias("hash"))


def sentence_chunks(spark, base):
    c = chunking.sentence_chunks(_docs(spark, base), _S)
    return c.select(F.col("id").alias("doc_id"), "chunk_index", F.length("content").alias("chars"), F.md5(F.encode("content", "UTF-8")).alias("hash"))


def recommended_chunks(spark, base):
    c = chunking.recommended_chunks(_docs(spark, base), "general")
    return c.select(F.col("id").alias("doc_id"), "chunk_index", F.length("content").alias("chars"), F.md5(F.encode("content", "UTF-8")).alias("hash"))


def token_chunks(spark, base):
    c = chunking.token_chunks(_docs(spark, base), _S)
    return c.select(F.col("id").alias("doc_id"), "chunk_index", "start_token", "end_token", F.md5(F.encode("content", "UTF-8")).alias("hash"))


def recursive_chunks(spark, base):
    c = chunking.recursive_chunks(_docs(spark, base))
    return c.select(F.col("id").alias("doc_id"), "chunk_index", "start_char", "end_char", F.md5(F.encode("content", "UTF-8")).alias("hash"))


def chunk_overlap(spark, base):
    c = chunking.with_overlaps(chunking.fixed_chunks(_docs(spark, base), _S))
    return c.select(F.col("id").alias("doc_id"), "chunk_index", "overlap_with_next", chunking.chunk_id(F.col("id"), F.col("chunk_index")).alias("chunk_id"))


def _stored(spark, base):
    return table(spark, base, "text_chunks").where("content is not null").dropDuplicates(["id"])


def chunk_quality(spark, base):
    return _stored(spark, base).select("id", F.round(chunking.chunk_quality(F.col("content")), 6).alias("quality"))


def chunk_validation(spark, base):
    return chunking.validate_chunks(_stored(spark, base))


def global_chunk_index(spark, base):
    c = _stored(spark, base).where("document_id is not null and page_number is not null")
    return chunking.with_global_index(c).select("id", "document_id", "global_index")


def stored_pages(spark, base):
    return table(spark, base, "preprocessing_results").select("document_id", "page_number", F.col("original_text").alias("text"))


def page_chunks(spark, base):
    """Pages in their order, cut into windows, with one index over the document and their source."""
    c = chunking.page_chunks(stored_pages(spark, base), _S, method="fixed", clean=False)
    return c.select("id", "document_id", "page_number", "chunk_index", "start_char", "end_char", F.md5(F.encode("content", "UTF-8")).alias("hash"),
                    F.col("source_info")["document_id"].alias("source_document"), F.col("source_info")["page_number"].alias("source_page"))


_FIXED = rf"""
    WITH RECURSIVE src AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE {_strip('text')} <> ''),
    w AS (
        SELECT doc_id, 0 AS start, {{end0}} AS stop FROM src s, (SELECT 0 AS start) z
        UNION ALL
        SELECT doc_id, start, {{end1}} AS stop FROM (
            SELECT s.doc_id, s.text, s.n, greatest(w.start + 1, w.stop - 200) AS start FROM w JOIN src s USING (doc_id) WHERE w.stop < s.n) s
    ),
    c AS (SELECT w.doc_id, start, stop, {_strip('substr(text, start + 1, stop - start)')} AS content FROM w JOIN src USING (doc_id)),
    k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, start AS start_char, stop AS end_char, content
          FROM c WHERE length(content) >= 100)
"""
_STOP = r"""CASE WHEN {start} + 1000 >= n THEN n
    WHEN regexp_matches(substr(text, {start} + 1001, 1), '\s') THEN {start} + 1000
    WHEN instr(reverse(substr(text, {start} + 1, 1000)), ' ') BETWEEN 1 AND 999 THEN {start} + 1000 - instr(reverse(substr(text, {start} + 1, 1000)), ' ')
    ELSE {start} + 1000 END"""
_FIXED = _FIXED.replace("{end0}", _STOP.replace("{start}", "0")).replace("{end1}", _STOP.replace("{start}", "start"))

_PAGES = f"""WITH RECURSIVE pages AS (SELECT document_id, page_number, min(original_text) AS text FROM preprocessing_results
        WHERE document_id IS NOT NULL AND page_number IS NOT NULL GROUP BY ALL), """ + _FIXED.strip().removeprefix("WITH RECURSIVE ").replace(
    "SELECT doc_id, text, length(text) AS n FROM documents", "SELECT {'d': document_id, 'p': page_number} AS doc_id, text, length(text) AS n FROM pages"
) + """, g AS (SELECT doc_id.d AS document_id, doc_id.p AS page_number, row_number() OVER (PARTITION BY doc_id.d ORDER BY doc_id.p, chunk_index) - 1 AS chunk_index,
        start_char, end_char, content FROM k)"""
_PAGE_ID = "document_id || '_chunk_' || lpad(chunk_index::VARCHAR, 4, '0')"

_SENTENCE = rf"""
    WITH RECURSIVE p AS (
        SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)),
            lambda s: {_strip('s')}), lambda s: length(s) >= 10) AS ss FROM documents),
    src AS (SELECT doc_id, ss, len(ss) AS n FROM p WHERE len(ss) > 0),
    w AS (
        SELECT doc_id, 1 AS i, 1 AS a, length(ss[1]) AS size, 0 AS done_a, 0 AS done_b FROM src
        UNION ALL
        SELECT s.doc_id, w.i + 1,
            CASE WHEN w.size + length(s.ss[w.i + 1]) > 1000 THEN coalesce(list_min(list_filter(range(w.a, w.i + 1), lambda j: list_sum(list_transform(s.ss[j:w.i], lambda x: length(x))) <= 200)), w.i + 1) ELSE w.a END,
            length(s.ss[w.i + 1]) + CASE WHEN w.size + length(s.ss[w.i + 1]) > 1000
                THEN coalesce(list_max(list_filter(list_transform(range(w.a, w.i + 1), lambda j: list_sum(list_transform(s.ss[j:w.i], lambda x: length(x)))), lambda t: t <= 200)), 0) ELSE w.size END,
            CASE WHEN w.size + length(s.ss[w.i + 1]) > 1000 THEN w.a ELSE 0 END, CASE WHEN w.size + length(s.ss[w.i + 1]) > 1000 THEN w.i ELSE 0 END
        FROM w JOIN src s USING (doc_id) WHERE w.i < s.n
    ),
    g AS (
        SELECT doc_id, done_a AS a, done_b AS b FROM w WHERE done_b > 0
        UNION ALL SELECT w.doc_id, w.a, w.i FROM w JOIN src s USING (doc_id) WHERE w.i = s.n)
    SELECT g.doc_id, row_number() OVER (PARTITION BY g.doc_id ORDER BY a, b) - 1 AS chunk_index,
        length(array_to_string(ss[a:b], ' ')) AS chars, md5(array_to_string(ss[a:b], ' ')) AS hash FROM g JOIN src USING (doc_id)
"""

_TOKEN = rf"""
    WITH t AS (SELECT doc_id, {_tokens('text')} AS words, length(text) AS n FROM documents),
    s AS (SELECT doc_id, words, len(words) AS m, greatest(1, floor(1000 / (n::DOUBLE / len(words))))::BIGINT AS target,
        floor(200 / (n::DOUBLE / len(words)))::BIGINT AS back FROM t WHERE len(words) > 0),
    p AS (SELECT *, greatest(1, target - back) AS step FROM s),
    k AS (SELECT *, unnest(range(0, greatest(0, ceil((m - target)::DOUBLE / step))::BIGINT + 1)) AS k FROM p),
    c AS (SELECT doc_id, k, k * step AS start_token, least(m, k * step + target) AS end_token, array_to_string(words[k * step + 1:k * step + target], ' ') AS content FROM k)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, start_token, end_token, md5(content) AS hash
    FROM c WHERE length(content) >= 100
"""

_ALPHA = r"length(regexp_replace({}, '[^\p{L}]', '', 'g'))".replace("{}", "text")
_QUALITY = rf"""
    WITH t AS (SELECT doc_id, text, {_tokens('text')} AS w, length(text) AS n FROM documents),
    r AS (SELECT *, len(w) AS c, 1 - len(list_distinct(w))::DOUBLE / nullif(len(w), 0) AS rep, {_ALPHA}::DOUBLE / nullif(n, 0) AS alpha FROM t)
    SELECT doc_id, CASE WHEN {_strip('text')} = '' THEN 0.0 ELSE round(least(1.0, CASE WHEN n < 10 THEN 0.5 ELSE 1.0::DOUBLE END
        * CASE WHEN n > 100000 THEN 0.8 ELSE 1.0 END * CASE WHEN c < 3 THEN 0.6 ELSE 1.0 END * CASE WHEN alpha < 0.5 THEN alpha / 0.5 ELSE 1.0 END
        * CASE WHEN c > 1 AND rep > 0.3 THEN 1 - rep ELSE 1.0 END * CASE WHEN regexp_matches(text, '[.!?]') THEN 1.1 ELSE 1.0 END), 6) END AS quality FROM r
"""
_CHUNKQ = rf"""
    WITH t AS (SELECT DISTINCT id, content FROM text_chunks WHERE content IS NOT NULL),
    r AS (SELECT id, content, length(content) AS n, {_strip('content')} AS b, len({_tokens('content')}) AS c FROM t),
    s AS (SELECT *, (n - length(b))::DOUBLE / nullif(n, 0) AS blank FROM r)
    SELECT id, CASE WHEN b = '' THEN 0.0 ELSE round(least(1.0, CASE WHEN n < 100 THEN 0.5 ELSE 1.0::DOUBLE END
        * CASE WHEN blank > 0.3 THEN 1 - blank ELSE 1.0 END * CASE WHEN regexp_matches(content, '[.!?]') THEN 1.1 ELSE 1.0 END
        * CASE WHEN c > 1 AND regexp_matches(b, '^[a-z]') THEN 0.9 ELSE 1.0 END * CASE WHEN c > 1 AND regexp_matches(b, '[a-zA-Z]$') THEN 0.9 ELSE 1.0 END), 6) END AS quality FROM s
"""
_TYPE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in line.split()[1:]) + f" THEN '{line.split(':')[0]}'" for line in SQL_TYPES
) + " ELSE 'general' END"
_LONG = "CASE regexp_replace(lower(w), '^[.,!?;:\"]+|[.,!?;:\"]+$', '', 'g') " + " ".join(
    f"WHEN {_sql(x.strip().split('=')[0])} THEN {_sql(x.strip().split('=')[1])}" for x in SQL_LONG_FORMS.replace("\n", "").split("|")
) + " END"
_CONTRACT = rf"""CASE WHEN {_LONG} IS NULL THEN w ELSE CASE WHEN regexp_matches(w, '^\p{{Lu}}') THEN upper({_LONG}[1]) || {_LONG}[2:] ELSE {_LONG} END
    || regexp_replace(w, '[a-zA-Z0-9]', '', 'g') END"""
_SMART = rf"""array_to_string(list_transform({_tokens(_N)}, lambda w, i: CASE WHEN regexp_matches(w, '^\p{{Lu}}{{2,}}$')
    OR (regexp_matches(w, '^\p{{Lu}}') AND i > 1 AND NOT regexp_matches({_tokens(_N)}[i - 1], '[.!?]$')) THEN w ELSE lower(w) END), ' ')"""
_SMART_TOKENS = rf"""array_to_string(list_transform({_tokens(_N)}, lambda w, i: CASE WHEN regexp_matches(w, '^\p{{Lu}}{{2,}}$')
    OR (regexp_matches(w, '^\p{{Lu}}') AND i > 1) THEN w ELSE lower(w) END), ' ')"""
_COLLAPSE = _strip(_rx(_rx(_N, r"\n{3,}", "\n\n"), r"\s{2,}", " "))
_MASKED = f"replace({_rx(_N, SQL_CONTROL, '')}, '&amp;', '&')"
for _pattern, _to in (
    (SQL_TAG, " "), (SQL_URL, " [URL] "), (SQL_EMAIL, " [EMAIL] "), (SQL_PHONE, " [PHONE] "), (SQL_HEADING, ""), (SQL_LINK, r"\1"), (SQL_MARKS, "."), (r"\n{3,}", "\n\n"), (r"\s{2,}", " "),
):
    _MASKED = _rx(_MASKED, _pattern, _to)
_MASKED = _strip(_MASKED)
_REPEATED = "(1 - len(list_distinct(w))::DOUBLE / nullif(len(w), 0))"
_SCORE = f"""least(1.0, CASE WHEN n < 10 THEN 0.5 ELSE 1.0::DOUBLE END * CASE WHEN n > 100000 THEN 0.8 ELSE 1.0 END * CASE WHEN len(w) < 3 THEN 0.6 ELSE 1.0 END
    * CASE WHEN {_ALPHA}::DOUBLE / n < 0.5 THEN {_ALPHA}::DOUBLE / n / 0.5 ELSE 1.0 END * CASE WHEN len(w) > 1 AND {_REPEATED} > 0.3 THEN 1 - {_REPEATED} ELSE 1.0 END
    * CASE WHEN regexp_matches(text, '[.!?]') THEN 1.1 ELSE 1.0 END)"""
_HEADED = "('Head' || chr(10) || replace(text, '. ', '.' || chr(10) || 'Head' || chr(10)) || chr(10) || 'Head' || chr(10) || 'foot')"
_COUNTS = f"c AS (SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) GROUP BY token)"

QUERIES = {
    "clean_text": (_hashed(T.clean_text), _sql_hashed(_CLEAN)),
    "clean_text_flat": (_hashed(lambda c: T.clean_text(c, preserve_structure=False)), _sql_hashed(_strip(_rx(_artifacts(_literals(_N)), r"\s+", " ")))),
    "fix_artifacts": (_hashed(T.fix_artifacts), _sql_hashed(_artifacts(_N))),
    "unicode_literals": (_hashed(lambda c: T.literal_replacements(T.normalizer("NFC")(c))), _sql_hashed(_literals(_N))),
    "special_char_removal": (_hashed(T.remove_special_characters), _sql_hashed(_rx(_N, SQL_NOT_PLAIN, ""))),
    "page_text_cleanup": (_hashed(T.page_cleanup), _sql_hashed(
        f"array_to_string(list_filter(list_transform(string_split({_N}, chr(10)), lambda l: {_strip('l')}), lambda l: l <> ''), chr(10))")),
    "cleaning_stats": (cleaning_stats, f"""
        WITH x AS (SELECT doc_id, {_N} AS b, {_CLEAN} AS a FROM documents)
        SELECT doc_id, length(b) AS original_length, length(a) AS cleaned_length, greatest(0, {_LINES.format('b')} - {_LINES.format('a')}) AS lines_removed,
            greatest(0, length(b) - length(a)) AS characters_removed, round(CASE WHEN length(b) = 0 THEN 1.0 ELSE length(a)::DOUBLE / length(b) END, 6) AS compression_ratio FROM x"""),
    "sentences": (sentences, f"""
        WITH x AS (SELECT doc_id, unnest({_sentences('text')}) AS s FROM documents)
        SELECT doc_id, count(*) AS sentences, sum(length(s))::BIGINT AS chars, max(length(s)) AS longest FROM x GROUP BY doc_id"""),
    "paragraphs": (paragraphs, f"""
        WITH x AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda p: {_strip('p')}), lambda p: length(p) > 20) AS ps FROM documents)
        SELECT doc_id, unnest(range(0, len(ps))) AS at, md5(regexp_replace(unnest(ps), '\\n+', ' ', 'g')) AS hash FROM x"""),
    "text_statistics": (text_statistics, f"""
        WITH x AS (SELECT doc_id, text, len({_tokens('text')}) AS w, len({_sentences('text')}) AS s FROM documents)
        SELECT doc_id, length(text) AS characters, w AS words, {_LINES.format('text')} + 1 AS lines,
            len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {_strip('p')} <> '')) AS paragraphs, s AS sentences,
            CASE WHEN s > 0 THEN round(w::DOUBLE / s, 2) ELSE 0.0 END AS avg_words_per_sentence,
            CASE WHEN w > 0 THEN round(length(text)::DOUBLE / w, 2) ELSE 0.0 END AS avg_chars_per_word FROM x"""),
    "header_footer_removal": (header_footer_removal, f"""
        WITH x AS (SELECT doc_id, string_split({_HEADED}, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM x),
        c AS (SELECT *, {_strip('line')} AS bare, count(*) OVER (PARTITION BY doc_id, {_strip('line')}) AS times FROM l),
        d AS (SELECT *, n >= 10 AND bare <> '' AND length(bare) < 100 AND times >= 3 AS gone FROM c)
        SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS hash, sum(gone::INT)::BIGINT AS lines_removed FROM d GROUP BY doc_id"""),
    "whole_document_text": (whole_document_text, """
        WITH p AS (SELECT document_id, page_number, min(original_text) AS text FROM preprocessing_results
            WHERE page_number IS NOT NULL AND original_text IS NOT NULL GROUP BY ALL),
        w AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number, text) AS text FROM p GROUP BY document_id)
        SELECT document_id, length(text) AS chars, md5(text) AS hash FROM w"""),
    "pdf_metadata_cleanup": (pdf_metadata_cleanup, """
        WITH r AS (SELECT DISTINCT run_id, metadata FROM processing_results WHERE metadata IS NOT NULL),
        e AS (SELECT run_id, unnest(map_entries(metadata)) AS e FROM r),
        k AS (SELECT run_id, lower(e.key) AS key, trim(e.value) AS value FROM e UNION ALL SELECT run_id, 'kind', 'pdf' FROM r)
        SELECT run_id, key, value FROM k WHERE value IS NOT NULL AND value <> ''"""),
    "source_validation": (source_validation, """
        WITH f AS (SELECT DISTINCT file_path AS path, (length(file_path) - 12)::BIGINT * 1048576 AS size FROM processing_results),
        e AS (SELECT path, 'no path' AS error FROM f WHERE path IS NULL OR trim(path) = '' UNION ALL SELECT path, 'not a PDF file' FROM f WHERE NOT ends_with(lower(path), '.pdf')
            UNION ALL SELECT path, 'empty file' FROM f WHERE size <= 0 UNION ALL SELECT path, 'larger than 10 MB' FROM f WHERE size > 10 * 1048576)
        SELECT path, error FROM e UNION ALL SELECT path, '' FROM f WHERE path NOT IN (SELECT path FROM e WHERE path IS NOT NULL) AND path IS NOT NULL"""),
    "source_file_info": (source_file_info, """
        SELECT DISTINCT file_path AS path, string_split(file_path, '/')[-1] AS file_name, (length(file_path) - 12)::BIGINT * 1048576 AS file_size_bytes FROM processing_results"""),
    "control_chars": (_hashed(P.strip_control), _sql_hashed(_rx(_N, SQL_CONTROL, ""))),
    "html_strip": (_hashed(P.strip_tags), _sql_hashed(_rx(_N, SQL_TAG, " "))),
    "html_entities": (_hashed(P.unescape_entities), _sql_hashed(f"replace({_N}, '&amp;', '&')")),
    "mask_url": (_hashed(P.mask_urls), _sql_hashed(_rx(_N, SQL_URL, " [URL] "))),
    "mask_email": (_hashed(P.mask_emails), _sql_hashed(_rx(_N, SQL_EMAIL, " [EMAIL] "))),
    "mask_phone": (_hashed(P.mask_phones), _sql_hashed(_rx(_N, SQL_PHONE, " [PHONE] "))),
    "citations": (_hashed(P.remove_citations), _sql_hashed(_rx(_N, SQL_CITATION, ""))),
    "code_blocks": (_hashed(P.mask_code), _sql_hashed(_rx(_N, SQL_CODE, " [CODE] "))),
    "markdown_clean": (_hashed(P.strip_markdown), _sql_hashed(_rx(_rx(_N, SQL_HEADING, ""), SQL_LINK, r"\1"))),
    "punct_normalize": (_hashed(P.calm_punctuation), _sql_hashed(_rx(_N, SQL_MARKS, "."))),
    "contractions": (_hashed(P.expand_contractions), _sql_hashed(f"array_to_string(list_transform({_tokens(_N)}, lambda w: {_CONTRACT}), ' ')")),
    "smart_lowercase": (_hashed(P.smart_lowercase), _sql_hashed(_SMART)),
    "lowercase": (_hashed(F.lower), _sql_hashed(f"lower({_N})")),
    "accents_removed": (_hashed(P.remove_accents), _sql_hashed(f"strip_accents({_N})")),
    "whitespace_normalize": (_hashed(P.collapse_whitespace), _sql_hashed(_COLLAPSE)),
    "custom_patterns": (_hashed(lambda c: P.custom(c, [(r"\d+", "#"), (r"#(,#)+", "#")])), _sql_hashed(_rx(_rx(_N, r"\d+", "#"), r"#(,#)+", "#"))),
    "preprocess_metadata": (preprocess_metadata, f"""
        WITH x AS (SELECT doc_id, {_N} AS b, doc_id % 10 = 0 AS blank, {_MASKED} AS text FROM documents), y AS (SELECT doc_id, b, blank, text, {_tokens('text')} AS w, length(text) AS n FROM x)
        SELECT doc_id, md5(CASE WHEN blank THEN '' ELSE text END) AS hash, CASE WHEN blank THEN 0.0 ELSE round({_SCORE}, 6) END AS quality, CASE WHEN NOT blank THEN {_TYPE} END AS text_type,
            CASE WHEN blank THEN 'empty_input' ELSE 'non_printable_removed,html_cleaned,urls_removed,emails_removed,phones_removed,markdown_cleaned,punctuation_normalized,whitespace_normalized' END AS transformations,
            CASE WHEN NOT blank THEN length(b) END AS original_length, CASE WHEN NOT blank THEN n END AS processed_length, CASE WHEN NOT blank THEN round(n::DOUBLE / length(b), 6) END AS compression_ratio,
            CASE WHEN NOT blank THEN len(w) END AS words, CASE WHEN NOT blank THEN len(regexp_extract_all(text, '[.!?]')) END AS sentence_marks,
            CASE WHEN NOT blank THEN 'standard' END AS level, CASE WHEN NOT blank THEN 8 END AS steps FROM y"""),
    "preprocess_standard": (preprocess_standard, None),
    "preprocess_aggressive": (preprocess_aggressive, None),
    "text_quality_score": (text_quality, _QUALITY),
    "text_type": (text_types, f"SELECT {_TYPE} AS text_type, count(*) AS n FROM documents GROUP BY 1"),
    "whitespace_tokens": (lambda s, b: K.token_counts(_docs(s, b)), f"WITH {_COUNTS} SELECT token, n FROM c"),
    "token_distribution": (lambda s, b: K.token_distribution(_docs(s, b)), f"""
        WITH x AS (SELECT unnest({_tokens('text')}) AS t FROM documents)
        SELECT count(*) AS total_tokens, count(DISTINCT t) AS unique_tokens, round(avg(length(t)), 6) AS mean_length, round(quantile_cont(length(t), 0.5), 6) AS median_length,
            max(length(t)) AS max_length, min(length(t)) AS min_length, round(stddev_pop(length(t)), 6) AS std_length FROM x"""),
    "top_tokens": (lambda s, b: K.top_tokens(_docs(s, b)), f"WITH {_COUNTS} SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rank FROM c QUALIFY rank <= 10"),
    "oov_ratio": (lambda s, b: K.oov_ratio(_docs(s, b), _vocabulary(s, b)), f"""
        WITH {_COUNTS}, v AS (SELECT DISTINCT unnest({_tokens('text')}) AS token FROM eval_items)
        SELECT sum(n)::BIGINT AS tokens, (sum(n) FILTER (v.token IS NULL))::BIGINT AS unknown, round((sum(n) FILTER (v.token IS NULL))::DOUBLE / sum(n), 6) AS oov_ratio
        FROM c LEFT JOIN v USING (token)"""),
    "compression_ratio": (compression, f"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN len({_tokens('text')})::DOUBLE / length(text) ELSE 0.0 END, 6) AS ratio FROM documents"),
    "subword_ratio": (subwords, f"""
        SELECT doc_id, round(len(list_filter({_tokens('text')}, lambda t: length(t) > 7 OR starts_with(t, '##') OR starts_with(t, '▁') OR starts_with(t, 'Ġ')))::DOUBLE
            / nullif(len({_tokens('text')}), 0), 6) AS ratio FROM documents"""),
    "token_smart_lowercase": (_hashed(K.smart_lowercase_tokens), _sql_hashed(_SMART_TOKENS)),
    "token_normalize": (_hashed(lambda c: K.normalize_tokens(c, remove_punctuation=True, remove_digits=True)), _sql_hashed(
        _strip(_rx(_rx(_rx(f"lower({_N})", r"[^\p{L}\p{N}_\s]", " "), r"\d+", ""), r"\s+", " ")))),
    "token_normalize_accents": (_hashed(lambda c: K.normalize_tokens(c, accents=True, remove_punctuation=True)), _sql_hashed(
        _strip(_rx(_rx(f"lower(strip_accents({_N}))", r"[^\p{L}\p{N}_\s]", " "), r"\s+", " ")))),
    "embed_validate": (_hashed(T.for_embedding), _sql_hashed(
        f"CASE WHEN {_strip(_rx(_N, chr(92) + 's+', ' '))} = '' THEN '[EMPTY]' ELSE {_strip(_rx(_N, chr(92) + 's+', ' '))} END")),
    "previews": (_hashed(lambda c: T.preview(c, 300)), _sql_hashed(f"CASE WHEN length({_N}) > 300 THEN substr({_N}, 1, 300) || '...' ELSE {_N} END")),
    "fixed_chunks": (fixed_chunks, _FIXED + " SELECT doc_id, chunk_index, start_char, end_char, md5(content) AS hash FROM k"),
    "chunk_overlap": (chunk_overlap, _FIXED + """
        SELECT doc_id, chunk_index, greatest(0, end_char - lead(start_char) OVER (PARTITION BY doc_id ORDER BY chunk_index)) AS overlap_with_next,
            doc_id || '_chunk_' || lpad(chunk_index::VARCHAR, 4, '0') AS chunk_id FROM k"""),
    "sentence_chunks": (sentence_chunks, _SENTENCE),
    "recommended_chunks": (recommended_chunks, _SENTENCE),
    "token_chunks": (token_chunks, _TOKEN),
    "recursive_chunks": (recursive_chunks, None),
    "page_chunks": (page_chunks, _PAGES + f"""
        SELECT {_PAGE_ID} AS id, document_id, page_number, chunk_index, start_char, end_char, md5(content) AS hash, document_id AS source_document, page_number::VARCHAR AS source_page FROM g"""),
    "chunk_quality": (chunk_quality, _CHUNKQ),
    "chunk_validation": (chunk_validation, f"""
        WITH t AS (SELECT DISTINCT id, content FROM text_chunks WHERE content IS NOT NULL),
        a AS (SELECT count(*) AS chunks, sum(length(content))::BIGINT AS characters, round(avg(length(content)), 6) AS avg_length, min(length(content)) AS min_length,
            max(length(content)) AS max_length, count(*) FILTER (length(content) < 50) AS too_short, count(*) FILTER (length(content) > 1500) AS too_long,
            count(*) FILTER ({_strip('content')} = '') AS blank FROM t)
        SELECT *, too_short = 0 AND too_long = 0 AND blank = 0 AS valid FROM a"""),
    "global_chunk_index": (global_chunk_index, """
        WITH t AS (SELECT DISTINCT id, document_id, page_number, chunk_index FROM text_chunks WHERE content IS NOT NULL AND document_id IS NOT NULL AND page_number IS NOT NULL)
        SELECT id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_index, id) - 1 AS global_index FROM t"""),
}
