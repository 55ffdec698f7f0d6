"""File events: texts are not sent about while events are put in order."""

import random

from pyspark.sql import functions as F

from quillfind.engine import Engine
from quillfind.operators.embed import HashingEmbedder
from quillfind.streaming import files


def _written(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_apply_files_deals_out_texts_once(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=40_000))  # noqa: E731  one word: postings stay small
    notes = [(f"n{i}.md", f"n{i}.md", f"n{i}", text()) for i in range(60)]
    engine = Engine(spark, str(tmp_path / "s"), HashingEmbedder(8), parts=2)
    engine.process_vault(spark.createDataFrame(notes, "path string, name string, base_name string, text string"))
    rows, sent = [], 0
    for i in range(60):
        t = text() if i % 4 in (1, 2) else None
        if i % 4 == 0:
            rows.append((i, i, f"n{i}.md", "rename", f"moved/n{i}.md", None))
        elif i % 4 == 1:
            rows.append((i, i, f"n{i}.md", "modify", None, t))
        elif i % 4 == 2:
            rows += [(i, i, f"new{i}.md", "create", None, t)] * 2  # it comes twice
        else:
            rows.append((i, i, f"n{i}.md", "delete", None, None))
    rows += [(100, 100, "n2.md", "modify", None, notes[2][3]), (101, 101, "empty.md", "create", None, None), (102, 0, "moved/n0.md", "modify", None, "before"), (103, 103, "moved/n0.md", "modify", None, "later")]
    events = spark.createDataFrame(rows, "event_id bigint, s bigint, path string, op string, new_path string, text string").withColumn("ts", F.timestamp_seconds("s")).drop("s").cache()
    stored = engine.store.table("notes")
    expected = {r.path: (r.id, r.text) for r in files.apply_events(stored, events, F.lit(0).cast("timestamp")).collect()}
    untouched = stored.where("path = 'n2.md'").head()["updated_at"]
    events.count()
    before = _written(spark)
    engine.apply_files(events)
    sent = _written(spark) - before
    found = engine.store.table("notes").collect()
    assert {r.path: (r.id, r.text) for r in found} == expected and len(found) == len(expected)
    assert next(r for r in found if r.path == "n2.md").updated_at == untouched  # an event with the same text changes nothing
    assert sent < 4 * 60 * 40_000 * 0.65, sent
