"""As-you-type search: debounce and suppression, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fires(events: DataFrame, gap: str | Column, keys: list[str]) -> DataFrame:
    at = F.struct("ts", "event_id")
    return events.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.max_by("context", at).alias("context"), F.count(F.lit(1)).alias("n_events")).select(*keys, F.col("w.end").alias("fire_ts"), "context", "n_events")


def debounce(events: DataFrame, gap: str | Column = "500 milliseconds", keys: list[str] | None = None) -> DataFrame:
    """Fires of events (event_id, ts, context): fire_ts a gap after the last of a run, with its context.

    An arrival within the gap (its end included) puts the fire off; a blank context fires nothing but
    still does so. events may be a stream; then see debounce_stream.
    """
    return _fires(events, gap, keys or []).where(F.trim(F.coalesce("context", F.lit(""))) != "")


def debounce_stream(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds", keys: list[str] | None = None) -> DataFrame:
    """The same over a stream, for append mode: a run is emitted when the watermark has passed its end."""
    marked = events.withWatermark("ts", late)
    if keys:
        return debounce(marked, gap, keys)
    # A stream's session window needs a key: without one there is a single timer.
    return debounce(marked.withColumn("_timer", F.lit(0)), gap, ["_timer"]).drop("_timer")


def cadence_gap(cadence: Column) -> Column:
    """The gap by search cadence, for a session window of its own length each row."""
    return F.when(cadence == "always", "500 milliseconds").when(cadence == "sometimes", "2000 milliseconds").when(cadence == "occasionally", "8000 milliseconds").otherwise("500 milliseconds")


def suppress(events: DataFrame, calls: DataFrame, keys: list[str] | None = None, hours: int = 1) -> DataFrame:
    """events with suppressed: is ts before the end set by the last call at or before it?

    calls: event_id, ts, ms. The last call wins, a shorter one too. Time is cut in spans of some hours:
    a task takes a span of a key, and the last call before it comes from a table of a row a span, so
    neither a busy key nor a single timer is one task.
    """
    keys = keys or []
    until = F.col("ts") + F.make_dt_interval(secs=(F.col("ms") / 1000).cast("decimal(18,6)"))
    span = F.floor(F.unix_micros("ts") / F.lit(hours * 3_600_000_000)).alias("_span")
    both = events.select(*keys, span, "event_id", "ts", F.lit(None).cast("timestamp").alias("_until"), F.lit(1).alias("_kind"), F.struct(*events.columns).alias("_row"))
    row = both.schema["_row"].dataType
    marks = calls.select(*keys, span, "event_id", "ts", until.alias("_until"), F.lit(0).alias("_kind"), F.lit(None).cast(row).alias("_row"))
    spans = marks.groupBy(*keys, "_span").agg(F.max_by("_until", F.struct("ts", "event_id")).alias("_last"))
    spans = spans.unionByName(both.select(*keys, "_span", F.lit(None).cast("timestamp").alias("_last")).distinct()).groupBy(*keys, "_span").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_until", F.last("_last", ignorenulls=True).over(before)).where("_until IS NOT NULL")
    carried = carried.select(*keys, "_span", F.lit(None).cast("bigint").alias("event_id"), F.timestamp_micros(F.col("_span") * F.lit(hours * 3_600_000_000)).alias("ts"), "_until", F.lit(-1).alias("_kind"), F.lit(None).cast(row).alias("_row"))
    # Of one instant what is carried over comes first, then the calls.
    w = Window.partitionBy(*keys, "_span").orderBy("ts", "_kind", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.unionByName(marks).unionByName(carried).withColumn("_upto", F.last("_until", ignorenulls=True).over(w)).where("_kind = 1")
    return out.select("_row.*", F.coalesce(F.col("ts") < F.col("_upto"), F.lit(False)).alias("suppressed"))


#: How long after a trigger of a kind its context is read, in milliseconds.
TRIGGER_DELAY_MS = {"editor-change": 0, "active-leaf-change": 0, "click": 10, "file-open": 50}


def triggers(raw: DataFrame) -> DataFrame:
    """Raw editor events (event_id, ts, kind, panel_visible, markdown, in_editor, context) as arrivals: event_id, ts, action, context.

    Nothing happens while the panel is hidden or for other kinds. A markdown view gives a search with its
    context; a click must be in an editor; opening another file clears the results, other events with
    it do nothing. ts is when the context is read.
    """
    kinds = F.create_map(*[F.lit(x) for pair in TRIGGER_DELAY_MS.items() for x in pair])
    delay = F.element_at(kinds, F.col("kind"))
    seen = raw.where(F.coalesce("panel_visible", F.lit(False)) & F.col("kind").isin(*TRIGGER_DELAY_MS))
    search = F.coalesce("markdown", F.lit(False)) & ((F.col("kind") != "click") | F.coalesce("in_editor", F.lit(False)))
    action = F.when(search, "search").when((F.col("kind") == "file-open") & ~F.coalesce("markdown", F.lit(False)), "clear")
    at = F.timestamp_micros(F.unix_micros("ts") + delay * 1000)
    return seen.select("event_id", at.alias("ts"), action.alias("action"), F.when(action == "search", F.coalesce("context", F.lit(""))).alias("context")).where("action IS NOT NULL")


def search_fires(events: DataFrame, calls: DataFrame, gap: str = "500 milliseconds", keys: list[str] | None = None) -> DataFrame:
    """Fires that are left: suppressed events never reach the timer, and a fire within a suppression is lost."""
    kept = suppress(events, calls, keys).where(~F.col("suppressed")).drop("suppressed")
    fires = debounce(kept, gap, keys).withColumn("event_id", F.lit(1 << 62)).withColumnRenamed("fire_ts", "ts")
    return suppress(fires, calls, keys).where(~F.col("suppressed")).select(*(keys or []), F.col("ts").alias("fire_ts"), "context", "n_events")
