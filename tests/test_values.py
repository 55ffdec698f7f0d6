"""Known values of the single operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillfind.functions import fts, text, vectors
from quillfind.log import Logger
from quillfind.operators import embed, lsh
from quillfind.settings import Settings, model_dimensions, requires_reindex, search_delay_ms


def one(spark, column, **values):
    df = spark.range(1).select(*[v.alias(k) for k, v in values.items()])
    return df.select(column).head()[0]


def array(values, kind="double"):
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def test_normalize_and_quantize(spark):
    assert one(spark, vectors.l2_normalize(F.col("v")), v=array([3, 4, 0])) == pytest.approx([0.6, 0.8, 0])
    assert one(spark, vectors.l2_normalize(F.col("v")), v=array([0, 0, 0])) == [0, 0, 0]
    assert one(spark, vectors.quantize_int8(F.col("v")), v=array([-1, -0.5, 0, 0.5, 1])) == [-127, -63, 0, 64, 127]
    assert one(spark, vectors.quantize_int8(F.col("v")), v=array([-2, -1.5, 1.5, 2])) == [-127, -127, 127, 127]


@pytest.mark.parametrize("a, b, score", [([1, 2, 3], [1, 2, 3], 1), ([1, 0], [0, 1], 0.5), ([1, 0], [-1, 0], 0), ([0, 0], [1, 1], 0), ([127] * 3, [-128] * 3, 0)])
def test_cosine(spark, a, b, score):
    assert one(spark, vectors.cosine_similarity(F.col("a"), F.col("b")), a=array(a, "tinyint"), b=array(b, "tinyint")) == pytest.approx(score)


def test_cosine_of_other_lengths_fails(spark):
    with pytest.raises(Exception, match="Vector dimension mismatch: 3 vs 2"):
        one(spark, vectors.cosine_similarity(F.col("a"), F.col("b")), a=array([1, 2, 3], "tinyint"), b=array([1, 2], "tinyint"))


def test_hamming(spark):
    assert one(spark, vectors.hamming(F.col("a"), F.col("b")), a=array([1, 0, 1, 0, 1], "int"), b=array([1, 1, 1, 0, 0], "int")) == 2


@pytest.mark.parametrize("n, planes", [(100, 7), (1, 1), (10000, 14), (0, 0), (2, 1)])
def test_plane_count(n, planes):
    assert lsh.plane_count(n) == planes


def test_hash_bits(spark):
    p = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0, 1.0])], "hash_index int, projection array<double>")
    v = spark.createDataFrame([("a", [100, -100, 50, -50])], "id string, vector array<tinyint>")
    assert lsh.hash_vectors(v, p).head()["bucket_hash"] == "100"


def test_whole_buckets_until_enough(spark):
    for sizes, taken in (([4, 7, 9], 2), ([10, 1], 1)):
        rows = [("0" * (3 - i) + "1" * i, n) for i, n in enumerate(sizes)]
        s = spark.createDataFrame(rows, "bucket_hash string, size bigint")
        q = spark.createDataFrame([(0, "000")], "query_id bigint, bucket_hash string")
        assert lsh.candidate_buckets(q, s, 1).count() == taken


def chunked(spark, value, size, overlap):
    df = spark.createDataFrame([(value,)], "text string")
    return text.chunk_texts(df, size=size, overlap=overlap).orderBy("chunk_index").collect()


def test_chunks(spark):
    words = " ".join("abcdefghij")
    assert [r.token_count for r in chunked(spark, words, 5, 2)] == [5, 5, 4, 1]
    assert len(chunked(spark, words, 5, 8)) == 10
    (only,) = chunked(spark, "", 5, 2)
    assert (only.chunk_text, only.start_index, only.end_index, only.token_count) == ("", 0, 0, 0)
    (only,) = chunked(spark, " a  b ", 5, 2)
    assert (only.chunk_text, only.end_index) == (" a  b ", 6)


def test_cursor_context(spark):
    line = F.lit("a b c d e f")
    for col in (5, 5):
        assert one(spark, text.cursor_context(F.col("t"), F.lit(0), F.lit(col), 4), t=line) == "b c d e"
    assert one(spark, text.cursor_context(F.col("t"), F.lit(7), F.lit(0), 4), t=line) == ""


def test_anchor_and_formats(spark):
    assert one(spark, text.anchor_id(F.col("t")), t=F.lit("block ^ab-1 \n")) == "ab-1"
    assert one(spark, text.anchor_id(F.col("t")), t=F.lit("^ab-1 block")) is None
    assert one(spark, text.snippet(F.col("t"), 3), t=F.lit("abcd")) == "abc..."
    assert one(spark, text.format_score(F.col("t")), t=F.lit(0.12345)) == "0.123"


def test_query_grammar(spark):
    rows = spark.createDataFrame([(0, "Apple pie"), (1, "apple CAFÉ tart"), (2, "don't pie"), (3, None)], "docid bigint, content string")
    found = fts.fts_tokens(F.coalesce("content", F.lit("")))

    def ids(q):
        return [r.docid for r in rows.where(fts.predicate(fts.parse(q), fts.TokenArrays({"content": found}))).orderBy("docid").collect()]

    assert ids("apple") == [0, 1]
    assert ids("apple pie") == [0]
    assert ids("pie OR tart") == [0, 1, 2]
    assert ids("apple NOT pie") == [1]
    assert ids("ta*") == [1]
    assert ids("apple NEAR/1 tart") == [1]
    assert ids("dont") == []
    assert ids("...") == []
    for bad in ("(apple", "a OR", "AND"):
        with pytest.raises(fts.QueryError):
            fts.parse(bad)


def test_greedy_batches():
    assert embed.greedy_batches([4000, 3000, 1000, 9000, 10]) == [[0, 1], [2], [3], [4]]


@given(st.lists(st.integers(0, 9000), max_size=30))
@settings(max_examples=50, deadline=None)
def test_greedy_batches_hold_all_in_order(sizes):
    out = embed.greedy_batches(sizes)
    assert [i for b in out for i in b] == list(range(len(sizes)))
    assert all(len(b) == 1 or sum(sizes[i] for i in b) <= 7500 for b in out)


def test_cloud_retries():
    calls, slept = [], []

    def transport(url, body, headers):
        calls.append(body)
        return (429, "try again in 1.2s") if len(calls) < 3 else (200, '{"data": [{"index": 0, "embedding": [1.0]}]}')

    p = embed.CloudProvider("m", "k", transport=transport, sleep=slept.append, clock=lambda: 0.0)
    assert p.embed_one("x") == [1.0]
    assert slept.count(2.2) == 2


def test_local_batches():
    sizes = []

    def transport(url, body, headers):
        sizes.append(len(body["input"]))
        return 200, '{"embeddings": [%s]}' % ",".join(["[1.0]"] * len(body["input"]))

    assert len(embed.LocalProvider("m", transport=transport).embed_many(["a"] * 19)) == 19
    assert sizes == [8, 8, 3]


def test_pull_progress():
    assert list(embed.pull_progress(['{"status": "a", "total": 3, "completed": 1}', "bad", '{"status": "done"}'])) == [(33, "a"), (0, "done")]


def test_settings():
    assert Settings.parse({"chunk_size": "64x", "vector_size": "none"}) == Settings(chunk_size=64)
    assert requires_reindex(Settings(), Settings(model="bge-m3")) and not requires_reindex(Settings(), Settings(log_level="WARN"))
    assert (model_dimensions("bge-m3"), model_dimensions("x"), search_delay_ms("occasionally"), search_delay_ms("?")) == (1024, 768, 8000, 500)


@pytest.mark.parametrize("level", range(5))
@pytest.mark.parametrize("method", ["DEBUG", "INFO", "WARN", "ERROR"])
def test_log_levels(level, method):
    lines = []
    Logger(level, lines.append).log(method, "part", "told")
    assert lines == ([f"[{method}] [part] told"] if ["DEBUG", "INFO", "WARN", "ERROR"].index(method) >= level else [])
