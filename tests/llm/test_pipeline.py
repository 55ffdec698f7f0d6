"""The pipeline against its stages by brute force."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from quillfind.llm import decontaminate, exact_dedup, near_dedup  # noqa: E402
from quillfind.llm.common import WordHashes  # noqa: E402


def test_run(spark, tmp_path):
    rng = random.Random(3)
    words = [rng.choice(["tree", "river", "stone"]) + str(i) for i in range(300)]
    rows, labels = [], []
    for i in range(120):
        own = rng.choices(words, k=rng.randint(20, 80))
        if i % 10 == 9:
            own = rows[i - 5][1].split()
        if i % 10 == 8 and i > 10:
            own = rows[i - 7][1].split() + ["more"]
        if i % 6 == 5:
            own = [w.upper() + "!!" for w in own]
        rows.append((i, " ".join(own), "en", "s", 1))
        labels.append((i, int("!!" not in rows[-1][1]), 0))
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(3)]
    rows.append((200, " ".join(rng.choices(words, k=30)) + " " + items[0][1] + " then " + items[1][1], "en", "s", 1))
    rows.append((201, " ".join(rng.choices(words, k=30)) + " " + items[2][1], "en", "s", 1))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    left = sorted((r.doc_id, r.text) for r in good.collect())
    assert {i for i, _ in left} == {r[0] for r in rows if "!!" not in r[1]}
    seen, once = set(), []
    for i, t in left:
        key = exact_dedup.normalise(t.encode())
        if key not in seen:
            seen.add(key)
            once.append((i, t))
    known = WordHashes()
    sets = {i: set(near_dedup.shingle_set(t.encode(), known).tolist()) for i, t in once}
    gone = {b for b in sets for a in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    index = decontaminate.BenchmarkIndex([(str(k), t.encode()) for k, t in items])
    want = {i for i, t in once if i not in gone and not next(iter(index.hits([t.encode()])))[2]}
    assert set(got) == want and not want & {200, 201}
    text = dict(left)
    assert all(r.decoded == text[i] for i, r in got.items())


DOCS = "doc_id bigint, text string, file string, place int, _metadata string, Text_key string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, f"f{k}", k, "m", "t") for k, (i, t) in enumerate(rows)], DOCS).repartition(3)


WORDS = " ".join(f"w{i}" for i in range(60))
NEAR = WORDS + " more"


def test_exact_decides_on_rows(spark):
    """One id with two texts, repeated rows, rows without an id."""
    rows = [(1, "a"), (1, "a"), (2, "aaa dup"), (5, "aaa dup"), (5, "mmm unique"), (None, "b"), (None, "b"), (None, "a"), (7, None), (8, ""), (9, " ")]
    out = corpus_pipeline.exact_dedup(spark, docs_of(spark, rows), "")
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a"), (2, "aaa dup"), (5, "mmm unique"), (None, "b"), (7, None), (9, " ")], key=str)


def test_near_decides_on_rows(spark):
    rows = [(1, WORDS), (5, NEAR), (5, "another text altogether of more than five words"), (5, NEAR.upper()), (None, WORDS), (None, "alone without an id here now"), (None, "alone without an id here now"), (6, None), (7, ""), (7, "")]
    out = corpus_pipeline.near_dedup(spark, docs_of(spark, rows), "")
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    want = [(1, WORDS), (5, "another text altogether of more than five words"), (None, "alone without an id here now"), (6, None), (7, ""), (7, "")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs_of(spark, [(1, "a")]).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_and_decontaminate_carry_every_column(spark, tmp_path):
    labels = [(i, i % 2, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, WORDS)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, "good plain words here" if i % 2 else "BAD!! ###") for i in range(40)] + [(41, "good plain words"), (41, "BAD!! ###"), (None, "good words"), (42, None)]
    docs = docs_of(spark, rows)
    out = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect() if r.text} == {(i, t) for i, t in rows if t and "good" in t}
    out = corpus_pipeline.decontaminate(spark, docs_of(spark, [(1, "a " + WORDS), (1, "clean"), (None, WORDS), (None, "x"), (3, None)]), str(tmp_path))
    assert sorted(((r.doc_id, r.text, r.Text_key) for r in out.collect()), key=str) == sorted([(1, "clean", "t"), (None, "x", "t"), (3, None, "t")], key=str)


def test_decontaminate_drops_a_document_with_one_item(spark, tmp_path):
    item = " ".join(f"b{i}" for i in range(12))
    spark.createDataFrame([(0, item), (None, item.upper()[::-1])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, f"before {item} after"), (2, "clean words only"), (3, " ".join(item.split()[:7])), (4, " ".join(item.split()[2:10])), (5, item[::-1])]
    out = corpus_pipeline.decontaminate(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]
