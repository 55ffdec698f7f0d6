"""File change capture: creates, changes, deletes and renames applied to the notes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfind.functions.text import is_markdown, stable_id
from quillfind.sources.scratch import cut

NOTE = ("id", "created_at", "updated_at", "path", "name", "base_name", "text")
_REPLAYED = "id string, created_at timestamp, updated_at timestamp, path string, name string, base_name string, text string"


def relevant(events: DataFrame) -> DataFrame:
    """Events (event_id, ts, path, op, new_path, text) of markdown files: a rename counts by its new path, others by their path."""
    return events.where(is_markdown(F.when(F.col("op") == "rename", F.coalesce("new_path", "path")).otherwise(F.col("path"))))


def referred(rows: DataFrame) -> DataFrame:
    """Notes or events with a reference in place of their text: its digest, and what names the row; null for none.

    So texts stay where they are while events are put in order; resolved() brings them back.
    """
    what = ("id",) if "id" in rows.columns else ("ts", "event_id", "path", "op", "new_path")
    named = [F.coalesce((F.unix_micros(F.col(c).cast("timestamp")) if c == "ts" else F.col(c)).cast("string"), F.lit("\0")) for c in what]
    return rows.withColumn("text", F.concat(F.sha2("text", 256), F.lit(":"), F.sha2(F.concat_ws("\x1f", F.lit(what[0]), *named), 256)))


def digest(reference: Column) -> Column:
    """Of a reference the digest of its text."""
    return F.substring(reference, 1, 64)


def resolved(notes: DataFrame, sources: list[DataFrame], few: bool) -> DataFrame:
    """notes with the texts that they refer to, of the rows in sources. few: the notes without texts may go to every worker."""
    texts = None
    for rows in sources:
        kept = rows.withColumn("_text", F.col("text"))
        own = referred(kept).select(F.col("text").alias("_ref"), "_text")
        if "id" not in rows.columns and not own.groupBy("_ref").count().where("_ref IS NOT NULL AND count > 1").isEmpty():
            own = own.dropDuplicates(["_ref"])  # an event that came twice
        texts = own if texts is None else texts.unionByName(own)
    some = notes.where("text IS NOT NULL").withColumnRenamed("text", "_ref")
    found = texts.join(F.broadcast(some) if few else some, "_ref").withColumnRenamed("_text", "text")
    return found.select(*NOTE).unionByName(notes.where("text IS NULL").select(*NOTE))


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each path; other files than .md are left out."""
    rows = relevant(events)
    return rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), F.struct("ts", "event_id")).alias("e")).select("path", "e.*")


def rename_groups(renames: DataFrame) -> DataFrame:
    """(path, group) of each path that a rename names: paths that renames connect, by their least path.

    Labels are taken from neighbours, then from their labels, until none changes: rounds grow with
    the logarithm of the longest chain of renames in one batch of events.
    """
    edges = renames.select("path", F.coalesce("new_path", "path").alias("to"))
    both = cut(edges.unionByName(edges.select(F.col("to").alias("path"), F.col("path").alias("to"))).distinct())
    labels = cut(both.groupBy("path").agg(F.least(F.col("path"), F.min("to")).alias("group"), F.lit(True).alias("changed")))
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("path").alias("to"), F.col("group").alias("g")), "to").groupBy("path").agg(F.min("g").alias("g"))
        step = labels.join(near, "path").select("path", "group", F.least("group", "g").alias("g"))
        far = labels.select(F.col("path").alias("g"), F.col("group").alias("h"))
        step = step.join(far, "g").select("path", "group", F.least("g", "h").alias("next"))
        labels = cut(step.select("path", F.col("next").alias("group"), (F.col("next") < F.col("group")).alias("changed")))
    return labels.drop("changed")


def _replay(key: tuple, notes: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
    """The notes of one group of paths after its events, in their order."""
    state = {r.path: r._asdict() for r in notes[list(NOTE)].itertuples(index=False)}

    def ident(path: str, event_id: int) -> str:
        made = hashlib.sha256(f"note\x1f{path}".encode()).hexdigest()[:20]
        if any(n["id"] == made for n in state.values()):  # a note that was made under this path lives under another now
            made = hashlib.sha256(f"note\x1f{path}\x1f{event_id}".encode()).hexdigest()[:20]
        return made

    for e in events.sort_values(["ts", "event_id"]).itertuples(index=False):
        path, renamed = e.path, e.op == "rename"
        if renamed:
            path = e.new_path if isinstance(e.new_path, str) else e.path
        name = path.rsplit("/", 1)[-1]
        names = {"path": path, "name": name, "base_name": name.removesuffix(".md"), "updated_at": e.now}
        if e.op == "delete":
            state.pop(path, None)
        elif renamed and e.path in state:
            state[path] = {**state.pop(e.path), **names}
        elif path in state:
            state[path].update(text=e.text, updated_at=e.now)
        else:
            state[path] = {"id": ident(path, e.event_id), "created_at": e.now, **names, "text": e.text}
    return pd.DataFrame(list(state.values()), columns=list(NOTE))


def apply_events(notes: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """The notes after events (event_id, ts, path, op, new_path, text), taken in order of ts and event_id.

    A rename changes path and names and keeps the text with all edits before it; of an unknown path it
    is a create; a note that has the new path is replaced. Renames bump updated_at, so vectors become
    outdated. Deletes of unknown paths do nothing. Two notes that come to be in one path in a batch end
    as the later one.

    Paths that no rename names are settled by their last event, combined before the exchange. Paths that
    renames connect are replayed together, of each path only the last text between two renames or deletes.
    """
    rows = relevant(events).select("event_id", "ts", "path", "op", "new_path", "text")
    renames = rows.where("op = 'rename'")
    if renames.isEmpty():
        return _apply_last(notes, last_events(rows), now)
    groups = rename_groups(renames)
    at = F.struct("ts", "event_id")
    # Renames and deletes that touch a path, and with them the interval that a text event falls in.
    bounds = rows.where("op IN ('rename', 'delete')").select(F.explode(F.array_distinct(F.array(F.col("path"), F.coalesce("new_path", "path")))).alias("path"), at.alias("at"))
    bounds = bounds.groupBy("path").agg(F.collect_list("at").alias("bounds"))
    mine = rows.join(groups, "path")
    texts = mine.where("op NOT IN ('rename', 'delete')").join(bounds, "path", "left").withColumn("_at", at)
    texts = texts.withColumn("interval", F.size(F.filter(F.coalesce("bounds", F.array().cast("array<struct<ts:timestamp,event_id:bigint>>")), lambda b: b < F.col("_at"))))
    last = texts.groupBy("group", "path", "interval").agg(F.max_by(F.struct("event_id", "ts", "op", "new_path", "text"), "_at").alias("e")).select("group", "path", "e.*")
    kept = mine.where("op IN ('rename', 'delete')").select("group", "path", "event_id", "ts", "op", "new_path", "text").unionByName(last).withColumn("now", now)
    touched = notes.select(*NOTE).join(groups, "path").select(*NOTE, F.concat("group").alias("of"))  # a column of its own
    replayed = touched.groupBy("of").cogroup(kept.groupBy("group")).applyInPandas(_replay, _REPLAYED)
    rest = notes.join(groups, "path", "left_anti")
    settled = _apply_last(rest, last_events(rows.join(groups, "path", "left_anti")), now)
    return settled.unionByName(replayed)


def _apply_last(notes: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """The notes after one event a path, none of them a rename."""
    name = F.element_at(F.split("path", "/"), -1)
    e = events.select("path", "op", F.col("text").alias("_text"), F.lit(True).alias("_hit"))
    both = notes.select(*NOTE).join(e, "path", "full_outer").where(~F.coalesce(F.col("op") == "delete", F.lit(False)))
    hit = F.coalesce("_hit", F.lit(False))
    return both.select(
        F.coalesce("id", stable_id(F.lit("note"), F.col("path"))).alias("id"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        "path",
        F.coalesce("name", name).alias("name"),
        F.coalesce("base_name", F.regexp_replace(name, r"\.md$", "")).alias("base_name"),
        F.when(hit, F.col("_text")).otherwise(F.col("text")).alias("text"),
    )


def start(stream: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str):
    """A streaming query that hands each micro-batch of file events to apply, such as Engine.apply_files."""

    def each(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            apply(batch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
