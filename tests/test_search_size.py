"""Searches for many queries: the same hits as brute force, and no pairs of queries and rows in exchanges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfind.operators import search


def moved(spark, run):
    """Rows written to exchanges while run() runs."""
    sc = spark.sparkContext._jsc.sc()
    jvm, none = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (90, 6)).astype(int)
    v[7] = 0
    vectors = [(f"v{i}", f"n{i % 30}", None, f"b{i % 40}" if i % 2 else None, "block" if i % 2 else "note", v[i].tolist()) for i in range(90)]
    vectors = spark.createDataFrame(vectors, "id string, note_id string, chunk_id string, block_id string, type string, vector array<tinyint>")
    notes = spark.createDataFrame([(f"n{i}", f"p{i}", f"m{i}") for i in range(28)], "id string, path string, name string")
    blocks = spark.createDataFrame([(f"b{i}", None if i == 3 else f"text {i}") for i in range(35)], "id string, content string")
    place = F.struct(*[F.lit(0).alias(c) for c in ("line", "col", "offset")])
    blocks = blocks.withColumn("start_position", place).withColumn("end_position", place)
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(80)], "query_id bigint, query array<tinyint>")
    return queries, vectors, notes, blocks, v


@pytest.mark.parametrize("pairs", [1 << 21, 200])
def test_best_of_all_pairs(spark, tables, monkeypatch, pairs):
    queries, vectors, notes, blocks, v = tables
    monkeypatch.setattr(search, "PAIRS", pairs)
    got = search.vector_search(queries, vectors.coalesce(1), notes, blocks, None, search.SearchOptions(top_k=3, min_score=0.4, use_index=False, exclude_paths=("p5",))).collect()
    able = [i for i in range(90) if i % 30 < 28 and i % 30 != 5 and (i % 2 == 0 or (i % 40 < 35 and i % 40 != 3))]
    size = np.sqrt((v * v).sum(1))
    want = {}
    for q in range(80):
        hits = [(0.0 if size[q] * size[i] == 0 else (float(v[q] @ v[i]) / (size[q] * size[i]) + 1) / 2, f"v{i}") for i in able]
        want[q] = [x[1] for x in sorted((h for h in hits if h[0] >= 0.4), key=lambda h: (-h[0], h[1]))[:3]]
    found = {q: [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in range(80)}
    assert found == want


def test_pairs_are_not_exchanged(spark, tables):
    queries, vectors, notes, blocks, _ = tables
    options = search.SearchOptions(top_k=1, use_index=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        rows, n = moved(spark, lambda: search.vector_search(queries, vectors.coalesce(1), notes, blocks, None, options).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 80 and n < 1500  # 80 x 77 pairs


def test_equal_queries_are_one_in_keyword_search(spark):
    content = spark.createDataFrame([(i, f"The word{i % 3} of it") for i in range(50)], "docid bigint, content string")
    queries = spark.createDataFrame([(i, "of the") for i in range(60)] + [(60, "word1 the"), (61, "nowhere"), (62, "''")], "query_id bigint, query string")
    rows, n = moved(spark, lambda: search.search_fts_many(content, queries, 4).collect())
    assert n < 1000  # 60 x 50 pairs
    found = {q: [r.docid for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])] for q in range(63)}
    assert found == {**{q: [0, 1, 2, 3] for q in range(60)}, 60: [1, 4, 7, 10], 61: [], 62: []}


def test_hybrid_queries_write_no_index(spark, tmp_path):
    import os

    from quillfind.plans import fixtures as fx
    from quillfind.plans.registry import QUERIES

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    import quillfind.plans  # noqa: F401

    os.symlink("/root/testdata/sf0.001", f"{tmp_path}/other")
    for name in ("hybrid_rrf", "hybrid_rrf_weighted", "hybrid_rrf_excluded", "hybrid_enriched"):
        QUERIES[name](spark, f"{tmp_path}/other").collect()
    assert not [k for k in fx._BUILT if k[1] == f"{tmp_path}/other" and k[2] == "postings"]
