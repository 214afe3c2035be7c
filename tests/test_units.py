"""Small exact cases and invariants of the core operators."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.config import ChunkSettings, ConfigurationError, InvalidQueryError, SearchQuery, collection_name
from corpusloom.functions import preprocess as P
from corpusloom.functions import text as T
from corpusloom.functions import tokens as K
from corpusloom.operators import chunking, embedding, embedding_quality, filters, search, store
from corpusloom.plans import text_queries
from corpusloom.runtime import table
from corpusloom.sources import pages

TEXT = st.text(alphabet="ab .!?\nAB", max_size=400)


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t")).alias("o")).first()[0]


def test_cleaning(spark):
    assert one(spark, "bro-\nken  word ,\n\n 42 \n\n“x”", T.clean_text) == 'broken word,\n\n"x"'
    assert one(spark, None, T.clean_text) is None
    assert one(spark, "", T.clean_text) == ""
    assert one(spark, "   \n", T.for_embedding) == "[EMPTY]"


def test_token_metrics(spark):
    assert one(spark, ["hello", "##world", "▁test", "Ġtoken"], K.subword_ratio, "array<string>") == 0.75
    texts = spark.createDataFrame([("hello world unknown test",)], "text string")
    vocabulary = spark.createDataFrame([("hello",), ("world",), ("test",)], "token string")
    assert K.oov_ratio(texts, vocabulary).first().oov_ratio == 0.25
    d = K.token_distribution(spark.createDataFrame([("hello world hello test",)], "text string")).first()
    assert (d.total_tokens, d.unique_tokens, d.mean_length, d.max_length, d.min_length) == (4, 3, 4.75, 5, 4)
    assert K.top_tokens(spark.createDataFrame([("hello world hello test",)], "text string"), 1).first()[:2] == ("hello", 2)


def test_contractions_and_case(spark):
    assert one(spark, "don't. it's", P.expand_contractions) == "do not'. it is'"
    assert one(spark, "The NASA probe. Saw Mars", P.smart_lowercase) == "the NASA probe. saw Mars"


MESSY = (
    "Él Café of NASA. It\'s at https://e.org/a or a.b@e.org, call 555-123-4567!!! See [1, 2] (Smith et al., 2020) and `x = 1`... "
    "Don\'t  ask The Reader."
)


def by_hand(text, level, text_type):
    """The preset\'s steps one by one, by the reference\'s values."""
    aggressive = level == "aggressive"
    if level != "minimal":
        text = re.sub(P.EMAIL, " [EMAIL] ", re.sub(P.URL, " [URL] ", text))
    text = re.sub(P.PHONE, " [PHONE] ", text)
    if aggressive and text_type != "academic":
        text = re.sub(P.CITATION, "", text)
    if aggressive and text_type != "code":
        text = re.sub(P.CODE, " [CODE] ", text)
    if text_type != "code":
        text = re.sub(P.PUNCTUATION, ".", text)
    if aggressive or text_type == "social_media":
        text = " ".join({"It's": "It is'", "Don\'t": "Do not\'"}.get(w, w) for w in text.split())
    if aggressive and text_type == "academic":
        words = text.split()
        starts = [k == 0 or words[k - 1][-1] in ".!?" for k in range(len(words))]
        text = " ".join(w if re.fullmatch("[A-Z]{2,}", w) or (w[0].isupper() and not at) else w.lower() for w, at in zip(words, starts))
    elif aggressive and text_type != "code":
        text = text.lower()
    return re.sub(r"\s{2,}", " ", text).strip()


@pytest.mark.parametrize("level", ["minimal", "standard", "aggressive", "custom"])
def test_presets(spark, level):
    types = ["general", "academic", "technical", "legal", "medical", "code", "news", "social_media", "conversational"]
    row = spark.createDataFrame([(MESSY,)], "t string").select(*[P.preprocess(F.col("t"), P.preset(level, t)).alias(t) for t in types]).first()
    assert row.asDict() == {t: by_hand(MESSY, level, t) for t in types}
    with pytest.raises(ValueError):
        P.preset("none")


def test_preset_queries_give_every_column(spark, small):
    rows = text_queries.preprocess_aggressive(spark, small).collect()
    docs = {r.doc_id: r.text for r in table(spark, small, "documents").select("doc_id", "text").collect()}
    assert {r.doc_id for r in rows} == set(docs) and all((r.hash is None) == (docs[r.doc_id] is None) for r in rows)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_chunkers_slice_the_text(text):
    s = ChunkSettings(40, 10, 1)
    for a, b, content in chunking.fixed_windows(text, s):
        assert content == text[a:b].strip() and b - a <= 40
    covered = 0
    for a, b, content in chunking.recursive_pieces(text, s):
        assert content == text[a:b] and len(content) <= 40 and a <= covered
        covered = b
    assert covered == (len(text) if text.strip() else 0)
    for a, _, content in chunking.sentence_groups(text, s):
        assert text[a : a + 1] == content[:1]


def test_settings():
    with pytest.raises(ConfigurationError):
        ChunkSettings(100, 100)
    with pytest.raises(ConfigurationError):
        collection_name("a b")
    with pytest.raises(InvalidQueryError):
        SearchQuery((1.0,), 0)
    with pytest.raises(ConfigurationError):
        chunking.chunker("semantic")
    assert filters.parse_filter("page=3, author=x") == {"page": 3, "author": "x"}
    with pytest.raises(InvalidQueryError):
        filters.parse_filter("page")


def test_search(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, [1.0, 1.0], 1), (3, [0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = [(r.vec_id, r.score) for r in search.search(v, SearchQuery((1.0, 0.0), 4)).collect()]
    assert got == [(0, 1.0), (2, 0.707107), (1, 0.0), (3, None)]
    assert [r.vec_id for r in search.search(v, SearchQuery((1.0, 0.0), 4, "cosine", {"label": 1}, None, 0.5)).collect()] == [0, 2]
    assert [r.vec_id for r in search.similar(v, 0, 1).collect()] == [2]
    assert search.search_many(v, v.where("vec_id = 99")).count() == 0
    odd = v.unionByName(spark.createDataFrame([(4, [-1.0, 0.1], 1), (5, [1.0], 1), (6, None, 1)], v.schema))
    for block_values in (4_000_000, 4):  # one block of queries, and several that are shuffled
        got = [(r.query_id, r.vec_id, r["rank"]) for r in search.search_many(odd, odd.where("vec_id in (0, 3, 5)"), 9, block_values=block_values).collect()]
        assert sorted(got) == [(0, 1, 2), (0, 2, 1), (0, 4, 3)], "no vector without length or of another dimension asks or is found"
        two_sets = search.search_many(v, v.where("vec_id = 0"), 1, same_set=False, block_values=block_values)
        assert [(r.query_id, r.vec_id, r.score) for r in two_sets.collect()] == [(0, 0, 1.0)]


def test_search_many_blocks(spark, small):
    v = table(spark, small, "embeddings")
    q = v.where("vec_id % 50 = 0")
    whole = sorted(map(tuple, search.search_many(v, q, 5).collect()))
    assert whole == sorted(map(tuple, search.search_many(v, q, 5, block_values=320).collect())) and len(whole) == 50


def test_search_within(spark):
    c = spark.createDataFrame([("a", "d", 1, [1.0, 0.0]), ("b", "d", 2, [1.0, 0.1]), ("c", "e", 1, [1.0, 0.0])], "id string, document_id string, page_number int, embedding array<float>")
    q = SearchQuery((1.0, 0.0), 5, where={"id": {"$ne": "x"}})
    assert [r.id for r in search.similar_within(c, q, document="d").collect()] == ["a", "b"]
    assert [r.id for r in search.similar_within(c, q, document="d", page=2).collect()] == ["b"]


def test_quality_matrices(spark):
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(([1, 2, 0], [3, 4, 0], [5, 6, 0]))]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    d = embedding_quality.dimension_utilization(v).first()
    assert (d.zero, d.near_zero, d.low_variance, d.score) == (1, 1, 1, 0.0)
    far = spark.createDataFrame([(i, [0.1 * i, 0.1, 0.1], 0) for i in range(4)] + [(9, [10.0, 10.0, 10.0], 0)], "vec_id long, embedding array<float>, label int")
    assert embedding_quality.outliers(far).first().outliers == 1


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    for values in ([3.0], [1.0, 2.0], [5.0] * 50, list(rng.normal(size=500)), [0.0] * 300 + list(rng.random(300) ** 9)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        got = embedding_quality.exact_quantiles(df, "v", [0.0, 0.25, 0.75, 1.0], few=20)
        assert np.allclose(got, np.quantile(values, [0.0, 0.25, 0.75, 1.0]))
    assert embedding_quality.exact_quantiles(df.limit(0), "v", [0.5]) is None


def test_few_vectors(spark):
    v = spark.createDataFrame([(k, [float(k), 1.0], 0) for k in range(9)], "vec_id long, embedding array<float>, label int")
    assert {r.cluster for r in embedding_quality.clusters(v).collect()} == {0}
    assert embedding_quality.inter_cluster(v).first().pairs == 0
    assert embedding_quality.pairwise_cosine(v.limit(0)).first().vectors == 0


def test_preprocess_results(spark):
    rows = spark.createDataFrame([(1, "See https://e.org/a now."), (2, "  "), (3, None)], "k int, original_text string")
    got = {r.k: r for r in P.preprocess_results(rows, P.preset("standard")).collect()}
    assert got[1].processed_text == "See [URL] now." and got[1].transformations[0] == "unicode_normalized" and got[1].metadata.transformations_count == len(got[1].transformations)
    for k in (2, 3):
        assert (got[k].processed_text, got[k].quality_score, got[k].text_type, got[k].transformations) == ("", 0.0, None, ["empty_input"])


def test_running_lines(spark):
    text = "\n".join(["Head", "one", "Head ", "two", " Head", "three", "4", "5", "6", "7"])
    rows = spark.createDataFrame([(1, text), (1, "Head\nHead\nHead"), (2, None)], "doc_id int, text string")
    got = sorted((tuple(r) for r in pages.remove_running_lines(rows).collect()), key=str)
    assert got == [(1, "Head\nHead\nHead", 0), (1, "one\ntwo\nthree\n4\n5\n6\n7", 3), (2, None, 0)]


def test_page_chunks(spark):
    rows = [("d", 2, "second page here"), ("d", 1, "first page of all"), ("d", 3, "  "), ("d", 4, None), (None, 1, "lost"), ("e", 1, "other"), ("d", 1, "first page of all")]
    s = ChunkSettings(10, 0, 1)
    c = chunking.page_chunks(spark.createDataFrame(rows, "document_id string, page_number int, text string"), s, method="fixed", extra={"kind": F.lit("scan")})
    got = {r.id: r for r in c.collect()}
    assert [got[f"d_chunk_{k:04d}"].page_number for k in range(4)] == [1, 1, 2, 2] and set(got) == {*(f"d_chunk_{k:04d}" for k in range(4)), "e_chunk_0000"}
    assert got["d_chunk_0002"].source_info == {"document_id": "d", "page_number": "2", "kind": "scan"}
    assert [got[f"d_chunk_{k:04d}"].content for k in range(4)] == ["first page", "of all", "second", "page here"]
    e = embedding.embed_chunks(c, embedding.hash_embedder(8), model="m")
    assert e.count() == 5 and {(r.dimension, r.model) for r in e.collect()} == {(8, "m")}


def test_page_offsets_over_blocks(spark):
    rows = [("d", p, 1 + p % 3) for p in range(0, 5000, 7)]
    got = {r.page_number: r.offset for r in chunking.page_offsets(spark.createDataFrame(rows, "document_id string, page_number int, n long")).collect()}
    total = 0
    for _, p, n in rows:
        assert got[p] == total
        total += n


def test_back_off():
    import itertools

    def first(n, *a, **k):
        return list(itertools.islice(embedding.pauses(*a, **k), n))

    assert first(4, "fixed", 2.0) == [2, 2, 2, 2] and first(4, "linear", 1.0) == [1, 2, 3, 4]
    assert first(4, "exponential", 1.0, max_delay=5) == [1, 2, 4, 5] and first(6, "fibonacci", 1.0) == [1, 1, 2, 3, 5, 8]

    def denied(_):
        raise PermissionError

    with pytest.raises(PermissionError):
        embedding.with_retry(denied, 9, 100.0, final=(PermissionError,))(["x"])


def test_validated_files(spark):
    files = spark.createDataFrame([("a.pdf", 10, b"%PDF-1.7 x"), ("b.txt", 10, b"%PDF"), ("c.pdf", 0, b""), ("d.pdf", 3_000_000, b"none"), (None, 1, None)], "path string, length long, content binary")
    good, bad = pages.validated(files, max_mb=2, with_content=True)
    assert [r.path for r in good.collect()] == ["a.pdf"]
    assert {(r.path, r.error) for r in bad.collect()} >= {("b.txt", "not a PDF file"), ("c.pdf", "empty file"), ("d.pdf", "larger than 2 MB"), ("d.pdf", "no PDF header"), (None, "no path")}
    meta = files.limit(1).select(pages.document_metadata(F.create_map(F.lit("Title"), F.lit(" T ")), F.lit(3), F.col("content")).alias("m")).first().m
    assert meta == {"title": "T", "page_count": "3", "is_pdf": "true", "pdf_version": "1.7", "is_encrypted": "false"}


def test_stream_counts_each_chunk_once(spark, tmp_path):
    from corpusloom.streaming import ingest

    day = "timestamp'2024-01-10 00:00:00'"
    rows = spark.sql(f"select * from values ('a', {day}, 'xx'), ('a', {day}, 'xx'), ('b', {day}, null), ('c', null, 'y') as t(id, created_at, content)")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    for turn in (1, 2):  # the second run finds nothing new
        stream = ingest.first_deliveries(ingest.chunk_stream(spark, f"{tmp_path}/in"))
        out = ingest.run_to_end(stream, ingest.counts_by_month, "w", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        assert [(r.chunks, r.characters) for r in out.collect()] == [(2, 2)], turn


def test_store(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path), "things")
    rows = spark.createDataFrame([("a", "d1", 1, "x"), ("b", "d1", 2, "y"), ("c", "d2", 1, "z")], "id string, document_id string, page_number int, content string")
    c.add(rows)
    with pytest.raises(ConfigurationError):
        c.add(rows)
    c.upsert(rows.where("id = 'a'").withColumn("content", F.lit("new")))
    assert c.get("a").content == "new" and c.count() == 3
    assert c.delete_document("d1") == 2 and c.delete_document("d1") == 0
    assert store.list_collections(spark, str(tmp_path)) == ["things"]
    with pytest.raises(ConfigurationError):
        c.add(rows.limit(0))
    with pytest.raises(ConfigurationError):
        c.add(spark.createDataFrame([("q", "d3", 1, "x"), ("q", "d3", 1, "x")], rows.schema))
    before = c.versions()
    c.add(spark.createDataFrame([("e", "d2", 2, "w", 1.5)], "id string, document_id string, page_number int, content string, score double"))
    assert {r.id: r.score for r in c.read().collect()} == {"c": None, "e": 1.5} and c.read(before[-1]).count() == 1
    untouched = c._manifest()["buckets"]
    c.delete(spark.createDataFrame([("e",)], "id string"))
    c.delete_where({"page_number": 7})
    assert c.count() == 1 and len(untouched) == 1
    taken = c._manifest()
    with pytest.raises(ConfigurationError, match="someone else"):
        c._publish(taken)
    c.vacuum(1)
    assert len(c.versions()) == 1 and c.count() == 1
    c.clear()
    assert c.count() == 0 and c.exists()
    c.drop()
    assert not c.exists()


def test_layouts(spark):
    c = spark.createDataFrame([("a", "text", {"content": "other", "k": "v"}, [1.0])], "id string, content string, metadata map<string,string>, embedding array<float>")
    assert store.as_layout(c, "pinecone").first().metadata == {"content": "text", "k": "v"}
    assert store.as_layout(c, "qdrant").first().payload == {"content": "other", "k": "v"}
    assert store.as_layout(c, "weaviate").first().properties == {"content": "other", "k": "v"}
    assert tuple(store.as_layout(c, "chroma").first())[:2] == ("a", "text")
    assert store.as_layout(c, "milvus").first().fields == {"metadata_content": "other", "metadata_k": "v"}
    with pytest.raises(ConfigurationError):
        store.as_layout(c, "none")


def test_end_to_end_search_equals_brute_force(spark, small):
    from corpusloom.plans import store_queries

    rows = table(spark, small, "documents").select("doc_id", T.for_embedding(F.col("text")).alias("t")).orderBy("doc_id").collect()
    x = embedding.hash_embedder(64)()([r.t for r in rows]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.doc_id for r in rows])
    got = {}
    for r in store_queries.end_to_end_search(spark, small).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        score = np.round(x @ x[ids == q][0], 6)
        score[ids == q] = -9
        best = sorted(zip(-score, ids))[:3]
        assert [s for _, s in (found[k] for k in (1, 2, 3))] == pytest.approx([-s for s, _ in best], abs=2e-6)


def test_kmeans_keeps_every_vector(spark, small):
    v = table(spark, small, "embeddings")
    found = embedding_quality.clusters(v)
    assert found.select("vec_id").distinct().count() == v.count() and found.select("cluster").distinct().count() == 10


def test_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("one\ftwo".encode())
    (tmp_path / "b.txt").write_bytes(b"no")
    files = pages.valid_files(pages.read_files(spark, str(tmp_path)))
    got = [(r.document_id, r.page_number, r.text, r.error) for r in pages.extract_pages(files, pages.text_pages).orderBy("page_number").collect()]
    assert got == [("a", 1, "one", None), ("a", 2, "two", None)]

    def broken(_):
        raise ValueError("bad page")

    assert pages.extract_pages(files, broken).first().error == "bad page"
    assert pages.whole_texts(pages.extract_pages(files, pages.text_pages)).first().text == "one\n\ntwo"


def test_embedding(spark):
    t = spark.createDataFrame([(1, "a b"), (2, None), (3, "b a")], "id long, text string")
    got = {r.id: np.array(r.embedding) for r in embedding.embed_texts(t, embedding.hash_embedder(8)).collect()}
    assert np.allclose(got[1], got[3]) and abs(np.linalg.norm(got[2]) - 1) < 1e-6
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 2:
            raise OSError("later")
        return np.zeros((len(texts), 1))

    assert embedding.with_retry(flaky, 3, 0.0)(["x"]).shape == (1, 1)
    cache = spark.createDataFrame([("x",)], "key string")
    assert embedding.cache_misses(t, cache, "m").count() == 3
    found, fresh = embedding.cached_embeddings(t.where("text is not null"), cache.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), "m", embedding.hash_embedder(8))
    assert found.count() == fresh.count() == 2
