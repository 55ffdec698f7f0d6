"""What the engine writes for large vaults: postings without an exchange, changes without lists of ids."""

from pyspark.sql import functions as F

from quillfind.engine import Engine
from quillfind.functions import fts
from quillfind.operators.embed import HashingEmbedder


def as_rows(p):
    return sorted((r.term, r.column, r.docid, r.note_id, tuple(r.positions)) for r in p.collect())


def by_hand(content):
    out = []
    for r in content.collect():
        for c in fts.COLUMNS:
            places = {}
            for i, t in enumerate(fts.query_tokens(r[c] or "")):
                places.setdefault(t, []).append(i)
            out += [(t, c, r.docid, r.note_id, tuple(p)) for t, p in places.items()]
    return sorted(out)


def test_postings_follow_from_the_row(spark, monkeypatch):
    monkeypatch.setattr(fts, "PIECE", 40)
    texts = ["", None, "A b a", "  ", "été Été naïve 你好 x", "one\x00two one", "x" * 90 + " Y1y " + "x" * 90, "-", "B", "\U0001f600 a\u0080b"]
    content = spark.createDataFrame([(i * 7, f"i{i}", "note", f"n{i % 3}", t, f"p/{i}.md", None, None) for i, t in enumerate(texts)], "docid bigint, id string, type string, note_id string, content string, note_path string, note_name string, block_id string").coalesce(1)
    p = fts.postings(content)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    assert as_rows(p) == by_hand(content)
    assert as_rows(fts.postings(content.limit(0))) == []


def test_changes_and_deletes_by_table_leave_an_exact_index(spark, tmp_path):
    e = Engine(spark, f"{tmp_path}/s", HashingEmbedder(8), parts=2)
    vault = spark.range(40).select(F.format_string("d/%d.md", "id").alias("path"), F.format_string("%d.md", "id").alias("name"), F.col("id").cast("string").alias("base_name"), F.format_string("# head %d\n\nsome words of note %d\n> said", "id", F.col("id") % 5).alias("text"))
    assert e.automatic_setup(vault) == {"insert": 40}
    later = vault.withColumn("text", F.when(F.col("base_name").cast("int") % 4 == 0, F.lit("other words\nthan before")).otherwise(F.col("text")))
    assert e.process_vault(later) == {"update": 10, "skip": 30}
    e.delete_notes(e.store.table("notes").where("CAST(base_name AS int) % 4 = 1").select("id"))
    assert e.store.table("notes").count() == 30
    content, blocks = e.store.table("fts_content"), e.store.table("blocks")
    assert content.count() == 30 + blocks.count() == 30 + 10 * 2 + 20 * 3
    assert e.store.table("vectors").count() == e.store.table("lsh_buckets").count() == content.count()
    assert content.where("note_path IS NULL OR note_name IS NULL").count() == 0 and content.select("docid").distinct().count() == content.count()
    assert as_rows(e.store.table("fts_postings")) == by_hand(content)
