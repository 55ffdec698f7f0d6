"""The store through crashes, file events in their order, streams, and what listens to them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillfind.engine import Engine
from quillfind.functions import text
from quillfind.log import Logger
from quillfind.operators.embed import EmbeddingService, HashingEmbedder, greedy_batch_numbers, greedy_batches, quantize
from quillfind.sources import vault
from quillfind.sources.store import Store
from quillfind.streaming import editor, files
from quillfind.streaming.heartbeat import Heartbeat

T = dt.datetime(2024, 1, 1)
NOTES = "id string, created_at timestamp, updated_at timestamp, path string, name string, base_name string, text string"
EVENTS = "event_id bigint, ts timestamp, path string, op string, new_path string, text string"


def notes_of(spark, names, text_="old"):
    return spark.createDataFrame([(k, T, T, f"{k}.md", f"{k}.md", k, text_) for k in names], NOTES)


def test_a_crash_before_the_swap_leaves_the_batch_before(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path), parts=3)
    s.initialize()
    s.save({"notes": notes_of(spark, "ab")})
    for broken in ("rename", "create"):
        with monkeypatch.context() as m:

            class Broken:
                def __getattr__(self, name, fs=s._fs, broken=broken):
                    if name == broken:
                        raise OSError("crash")
                    return getattr(fs, name)

            m.setattr(s, "_fs", Broken())
            with pytest.raises(OSError):
                s.save({"notes": notes_of(spark, "xyz")})
        again = Store(spark, str(tmp_path))
        again.initialize()  # must not take what is there for an empty store
        assert {r.id for r in again.table("notes").collect()} == {"a", "b"} and again.parts == 3
    s.save({"notes": notes_of(spark, "c")})
    assert {r.id for r in s.table("notes").collect()} == {"c"}


def test_two_batches_with_one_number(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.initialize()
    number = b._numbers()[-1]
    with pytest.raises(OSError, match="another batch"):
        b._swap(number, {"parts": 16, "tables": {}})
    assert a.exists("notes")


def test_only_touched_partitions_are_written(spark, tmp_path):
    s = Store(spark, str(tmp_path), parts=8)
    s.initialize()
    s.save({"notes": notes_of(spark, "abcdefghij")})
    before = s._manifest()["tables"]["notes"]
    s.update("notes", {"text": ":t"}, "id = 'c'", {"t": "new"})
    s.insert("notes", notes_of(spark, "z"))
    s.delete("notes", "id = 'a'")
    after = s._manifest()["tables"]["notes"]
    touched = set(map(str, s.parts_of(spark.createDataFrame([("a",), ("c",), ("z",)], "id string"))))
    assert {p for p in before if before[p] != after.get(p)} <= touched
    assert {r.id: r.text for r in s.table("notes").collect()} == {k: "new" if k == "c" else "old" for k in "bcdefghijz"}
    with pytest.raises(ValueError):
        s.update("notes", {"id": "'x'"}, "true")


def applied(spark, notes, rows):
    e = spark.createDataFrame([(i, T + dt.timedelta(seconds=i), *r) for i, r in enumerate(rows)], EVENTS)
    return {r.path: r.text for r in files.apply_events(notes, e, F.lit(T)).collect()}


def test_edits_and_renames_in_one_batch(spark):
    n = notes_of(spark, "a")
    assert applied(spark, n, [("a.md", "modify", None, "new"), ("a.md", "rename", "b.md", None)]) == {"b.md": "new"}
    assert applied(spark, n, [("a.md", "rename", "b.md", None), ("b.md", "modify", None, "later")]) == {"b.md": "later"}
    assert applied(spark, n, [("a.md", "rename", "b.md", None), ("b.md", "rename", "c.md", None), ("c.md", "rename", "d.md", None)]) == {"d.md": "old"}
    assert applied(spark, n, [("a.md", "rename", "b.md", None), ("a.md", "create", None, "second")]) == {"b.md": "old", "a.md": "second"}
    assert applied(spark, n, [("a.md", "rename", "b.txt", None)]) == {"a.md": "old"}
    assert applied(spark, n, [("x.txt", "rename", "x.md", "from text")]) == {"a.md": "old", "x.md": "from text"}


def test_events_by_brute_force(spark):
    rng = random.Random(4)
    names = [f"{k}.md" for k in "abcdef"]
    for trial in range(4):
        rows = []
        for i in range(25):
            op = rng.choice(["create", "modify", "modify", "delete", "rename"])
            path, to = rng.sample(names, 2)
            rows.append((path, op, to if op == "rename" else None, f"t{i}"))
        state = {f"{k}.md": "old" for k in "abc"}
        for path, op, to, t in rows:
            if op == "delete":
                state.pop(path, None)
            elif op == "rename":
                state[to] = state.pop(path) if path in state else t
            else:
                state[path] = t
        assert applied(spark, notes_of(spark, "abc"), rows) == state, trial
    out = files.apply_events(notes_of(spark, "abc"), spark.createDataFrame([(i, T, *r) for i, r in enumerate(rows)], EVENTS), F.lit(T))
    ids = [r.id for r in out.collect()]
    assert len(ids) == len(set(ids))


def test_stream_of_file_events(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), HashingEmbedder(8))
    e.automatic_setup(spark.createDataFrame([("a.md", "a.md", "a", "apples and pears on the table"), ("b.md", "b.md", "b", "boats leave the harbour now")], "path string, name string, base_name string, text string"))
    rows = [(0, T, "a.md", "modify", None, "cherries and plums on the table"), (1, T, "a.md", "rename", "c.md", None), (2, T, "b.md", "delete", None, None)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "in"))
    q = e.watch(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.path, r.text) for r in e.store.table("notes").collect()} == {("c.md", "cherries and plums on the table")}
    assert {r.note_path for r in e.keywords("plums").collect()} == {"c.md"} and e.keywords("apples").count() == e.keywords("boats").count() == 0
    assert {r.note_path for r in e.search("cherries and plums on the table").collect()} == {"c.md"}
    v, b = e.store.table("vectors"), e.store.table("lsh_buckets")
    assert {r.id for r in v.collect()} == {r.vector_id for r in b.collect()}
    e.clear_index()
    assert e.store.table("lsh_buckets").count() == 0 and e.search("plums").count() > 0


def test_dynamic_search_never_fails(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "store"), HashingEmbedder(8))
    monkeypatch.setattr(e.provider, "embed_many", lambda texts: 1 / 0)
    assert e.dynamic("anything").count() == 0


def test_vault_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.md").write_text("# Title ^t-1\n\n- point\r\nlast")
    (tmp_path / "two.md").write_text("")
    (tmp_path / "no.txt").write_text("x")
    found = {r.name: r for r in vault.scan(spark, str(tmp_path)).collect()}
    assert set(found) == {"one.md", "two.md"} and found["one.md"].base_name == "one" and found["one.md"].text == "# Title ^t-1\n\n- point\r\nlast"
    b = vault.blocks_of_lines(spark.createDataFrame([("n", "# Title ^t-1\n\n- point\nlast"), ("e", ""), ("z", None)], "id string, text string"), F.lit(T)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.type, r.content, r.start_position.offset, r.end_position.offset, r.anchor_id) for r in b] == [(0, "heading", "# Title ^t-1", 0, 12, "t-1"), (2, "list", "- point", 14, 21, None), (3, "paragraph", "last", 22, 26, None)]


def test_triggers_and_heartbeat(spark):
    raw = spark.createDataFrame(
        [(0, T, "click", True, True, True, "x"), (1, T, "click", True, True, False, "x"), (2, T, "file-open", True, False, False, None), (3, T, "file-open", True, True, False, None), (4, T, "editor-change", False, True, True, "x"), (5, T, "other", True, True, True, "x")],
        "event_id bigint, ts timestamp, kind string, panel_visible boolean, markdown boolean, in_editor boolean, context string",
    )
    got = [(r.event_id, (r.ts - T).microseconds // 1000, r.action, r.context) for r in editor.triggers(raw).orderBy("event_id").collect()]
    assert got == [(0, 10, "search", "x"), (2, 50, "clear", None), (3, 50, "search", "")]
    now, out = [0.0], []
    h = Heartbeat(Logger("DEBUG", out.append), clock=lambda: now[0])
    h.onQueryProgress(None)
    now[0] = 299
    h.onQueryIdle(None)
    now[0] = 300
    h.onQueryProgress(None)
    assert len(out) == 2


def test_greedy_batches_are_streamed(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(1, 60)) for k in "ab" for i in range(200)]
    got = greedy_batch_numbers(spark.createDataFrame(rows, "k string, i bigint, n bigint").repartition(5), "k", "i", "n", 100).collect()
    for k in "ab":
        sizes = [n for kk, _, n in rows if kk == k]
        want = [b for b, places in enumerate(greedy_batches(sizes, 100)) for _ in places]
        assert [r.batch for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)] == want


def test_byte_pairs(spark, tmp_path):
    import base64

    pytest.importorskip("tiktoken")
    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abc"]
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(ranks)))
    df = spark.createDataFrame([("abcab",), ("",), (None,), ("é",)], "t string")
    assert [r[0] for r in df.select(text.bpe_tokens(str(tmp_path / "ranks"))("t")).collect()] == [[257, 256], [], [], [195, 169]]


def test_one_text_or_many_embed_alike():
    s = EmbeddingService(HashingEmbedder(16))
    texts = ["river and stone", "", "the river"]
    assert [list(map(int, v)) for v in s.embed_rows(texts)] == [s.embed_text(t) for t in texts] == s.embed_texts(texts)
    assert quantize([-1, -0.5, 0, 0.5, 1]) == [-80, -40, 0, 40, 80]
