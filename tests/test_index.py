"""Keyword and hyperplane indexes: the same answers as without them, and as another engine's."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillfind.functions import fts
from quillfind.operators import lsh, search

COLUMNS = "docid bigint, id string, type string, note_id string, content string, note_path string, note_name string, block_id string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["tree", "river", "stone", "Rivers", "treetop", "é", "x1", "sand"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 14))) + rng.choice(["", "!", " a-b", "\n"]) for _ in range(120)] + ["", None]


@pytest.fixture(scope="module")
def content(spark, texts):
    rows = [(i, f"note_{i}", "note", str(i), t, f"dir{i % 3}/river {i}.md", f"{i}.md", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def lite(texts):
    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE t USING fts3(content)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS3 here")
    c.executemany("INSERT INTO t(docid, content) VALUES (?, ?)", list(enumerate(texts)))
    return c


QUERIES = [
    "tree", "tree river", "tree AND river", "tree OR stone", "tree NOT river", "(tree OR stone) AND x1", "tree river NOT (stone OR sand)", "tre*", "riv* stone",
    "tree NEAR river", "tree NEAR/0 river", "tree NEAR/1 river", "tree NEAR/2 river NEAR/2 stone", "tree NEAR/1 river NEAR/1 stone NEAR/3 sand", "x1 NEAR/0 é", "tre* NEAR/1 stone", "a b", "RIVERS", "absent", "absent OR é",
]


@pytest.mark.parametrize("query", QUERIES)
def test_keywords_as_in_sqlite(spark, content, lite, query):
    want = [r[0] for r in lite.execute("SELECT docid FROM t WHERE content MATCH ? ORDER BY docid", (query,))]
    scanned = [r.docid for r in search.search_fts(content, query, 500).collect()]
    indexed = [r.docid for r in search.search_fts(content, query, 500, postings=fts.postings(content)).collect()]
    assert scanned == want and indexed == want


def test_near_chain_needs_every_step(spark):
    rows = [(0, "a b x x x x c"), (1, "a b x c"), (2, "c x b a"), (3, "a x x b x x c"), (4, "a x x x b c")]
    c = spark.createDataFrame([(i, f"n{i}", "note", str(i), t, "p", "n", None) for i, t in rows], COLUMNS)
    for postings in (None, fts.postings(c)):
        assert [r.docid for r in search.search_fts(c, "a NEAR/2 b NEAR/2 c", 9, postings=postings).collect()] == [1, 2, 3]


def test_columns_and_limits(spark, content):
    p = fts.postings(content)
    for q in ("note_path:dir1 tree", "note_path:river note_name:5", "note_path:dir1 NEAR/9 content:tree"):
        a, b = ([r.docid for r in search.search_fts(content, q, 7, postings=x).collect()] for x in (None, p))
        assert a == b and len(a) <= 7
    with pytest.raises(fts.QueryError):
        search.search_fts(content, "AND tree", 5, strict=True, postings=p)
    assert search.search_fts(content, "AND tree", 5, postings=p).count() == 0  # the word 'and' is nowhere
    assert search.search_fts(content, "''", 5, postings=p).count() == 0


def test_many_queries(spark, content):
    q = spark.createDataFrame([(0, "tree river"), (1, "TREE tree"), (2, ""), (3, "'absent"), (4, None)], "query_id bigint, query string")
    a, b = (sorted((r.query_id, r["rank"], r.docid) for r in search.search_fts_many(content, q, 5, x).collect()) for x in (None, fts.postings(content)))
    assert a == b and {x[0] for x in a} == {0, 1}
    for query_id, query in ((0, "tree river"), (1, "tree")):
        assert [x[2] for x in a if x[0] == query_id] == [r.docid for r in search.search_fts(content, query, 5).collect()]


def test_postings_are_read_by_term(spark, content, tmp_path):
    fts.postings(content).write.parquet(f"{tmp_path}/p")
    plan = search.search_fts(content, "tree NEAR river", 5, postings=spark.read.parquet(f"{tmp_path}/p"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,tree)" in plan and "PushedFilters" in plan


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(1)
    rows = [(f"v{i}", f"n{i % 5}", "note", [rng.randint(-127, 127) for _ in range(16)]) for i in range(300)]
    return spark.createDataFrame(rows, "id string, note_id string, type string, vector array<int>").withColumn("vector", F.col("vector").cast("array<tinyint>")).withColumn("chunk_id", F.lit(None).cast("string")).withColumn("block_id", F.lit(None).cast("string"))


def test_index_is_read_and_vectors_are_not_hashed(spark, vectors, tmp_path):
    made = lsh.build_index(vectors.select("id", "note_id", "vector"), 16)
    made["lsh_buckets"].write.parquet(f"{tmp_path}/b")
    vectors.write.parquet(f"{tmp_path}/v")
    index, stored = spark.read.parquet(f"{tmp_path}/b"), spark.read.parquet(f"{tmp_path}/v")
    planes = made["lsh_hash_functions"].select("hash_index", "projection")
    notes = spark.createDataFrame([(f"n{i}", f"n{i}.md", f"n{i}") for i in range(5)], "id string, path string, name string")
    queries = stored.where("id IN ('v0', 'v50')").select(F.expr("int(substring(id, 2))").alias("query_id"), F.col("vector").alias("query"))
    options = search.SearchOptions(top_k=3)
    found = [search.vector_search(queries, stored, notes, None, None, options, planes, x) for x in (None, index)]
    a, b = (sorted((r.query_id, r["rank"], r.id, r.score) for r in f.collect()) for f in found)
    assert a == b and len(a) == 6
    plan = found[1]._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.split("\n") if "Relation" in line]
    assert any("bucket_hash" in line for line in reads)
    with_planes = [part for part in plan.split("Join") if "_planes" in part and f"{tmp_path}/v" in part]
    assert len(with_planes) <= 1  # planes meet the stated queries alone
    exact = search.vector_search(queries, stored, notes, None, None, search.SearchOptions(top_k=3, use_index=False))
    assert 0 < lsh.recall(found[1], exact).head().recall <= 1


def test_candidates_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"v{i}", format(rng.randrange(64), "06b")) for i in range(400)]
    index = spark.createDataFrame(rows, "vector_id string, bucket_hash string")
    queries = spark.createDataFrame([(0, "010101"), (1, "111111")], "query_id bigint, bucket_hash string")
    got = {(r.query_id, r.vector_id) for r in lsh.candidates(queries, index, 2).collect()}
    want = set()
    for query_id, h in ((0, "010101"), (1, "111111")):
        sizes = {}
        for v, b in rows:
            sizes.setdefault(b, []).append(v)
        n = 0
        for b in sorted(sizes, key=lambda b: (sum(x != y for x, y in zip(b, h)), b)):
            if n >= 20:
                break
            n += len(sizes[b])
            want |= {(query_id, v) for v in sizes[b]}
    assert got == want
