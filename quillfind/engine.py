"""The engine: a store, a provider, and the jobs and searches over them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfind.functions import fts
from quillfind.functions.text import stable_id
from quillfind.log import logger
from quillfind.operators import ingest, lsh, maintenance, search
from quillfind.operators.embed import EmbeddingService, Provider
from quillfind.settings import Settings, requires_reindex
from quillfind.sources import vault as vaults
from quillfind.sources.scratch import written
from quillfind.sources.store import Store, part_of
from quillfind.streaming import files


class Engine:
    """Tables live in the store; every job reads them, makes new ones and saves them together."""

    def __init__(self, spark: SparkSession, root: str, provider: Provider, settings: Settings | None = None, seed: int = 42, parts: int = 16) -> None:
        """parts: partitions of a new store, in how many pieces a large vault is written."""
        self.spark, self.store, self.provider, self.seed = spark, Store(spark, root, parts), provider, seed
        self.settings = settings or Settings()
        self.store.initialize()

    def process_vault(self, vault: DataFrame, now: Column | None = None) -> dict[str, int]:
        """Upsert a vault scan (path, name, base_name, text); rows by action. New vectors join the stored planes' buckets."""
        now = F.current_timestamp() if now is None else now
        notes = self.store.table("notes")
        later = vault.where(F.endswith("path", F.lit(".md")))
        acted = ingest.upsert_actions(notes, later).select("path", "id", "action").persist()
        told = {r["action"]: r["n"] for r in acted.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        changed = acted.where("action <> 'skip'")
        if set(told) == {"insert"}:  # all are new: nothing to look up
            fresh = later.select(stable_id(F.lit("note"), F.col("path")).alias("id"), now.alias("created_at"), now.alias("updated_at"), "path", "name", "base_name", "text")
            self._save_notes(fresh, notes.limit(0), now)
        elif set(told) - {"skip"}:
            hit = F.broadcast(changed.select("path")) if self._small(told) else changed.select("path")
            after = ingest.upsert_notes(notes.join(hit, "path", "left_semi"), later.join(hit, "path", "left_semi"), now)
            self._save_notes(after, notes.limit(0), now)
        acted.unpersist()
        return told

    @staticmethod
    def _small(told: dict[str, int], most: int = 250_000) -> bool:
        """Are the changed notes few enough for their paths or ids to go to every worker?"""
        return sum(n for k, n in told.items() if k != "skip") <= most

    def _save_notes(self, changed: DataFrame, gone: DataFrame, now: Column, named: DataFrame | None = None) -> None:
        """Save changed notes (whole rows) with all that follows from them, and drop gone ones (id). named: the changed ones' ids, where they are known.

        Only the partitions that these notes are in are read and written. Notes are written first; what follows
        from them is made from their new partitions, so texts are dealt out once and not held meanwhile.
        """
        both = (changed.select("id") if named is None else named).unionByName(gone.select("id")).persist()
        parts = self.store.parts_of(both)
        if parts:
            few = self._small({"": both.count()})
            ids = F.broadcast(both) if few else both
            before = self.store.tables(parts)
            first = not self.store.filled("notes", parts)
            made: dict[str, DataFrame] = {}

            def follows(name: str):
                def make(new: dict[str, DataFrame]) -> DataFrame:
                    if not made:
                        fresh = new["notes"] if first else new["notes"].join(ids, "id", "left_semi")
                        made.update(ingest.cascade(before, fresh, gone, lambda n: vaults.blocks_of_lines(n, now), self.provider, now, ids))
                    return made[name]

                return make

            def indexed(new: dict[str, DataFrame]) -> DataFrame:
                if first or not few:
                    return fts.postings(new["fts_content"])
                mine = ids.withColumnRenamed("id", "note_id")
                fresh = fts.postings(new["fts_content"].join(mine, "note_id", "left_semi"))
                return ingest.delete_for_notes(before["fts_postings"], ids).unionByName(fresh)

            notes = ingest.delete_for_notes(before["notes"].withColumnRenamed("id", "note_id"), ids).withColumnRenamed("note_id", "id").unionByName(changed, allowMissingColumns=True)
            tables = {name: follows(name) for name in ("blocks", "vectors", "chunks", "fts_content")}
            self.store.save({"notes": notes}, parts, {**tables, "fts_postings": indexed, **self._buckets()})
        both.unpersist()

    def _buckets(self) -> dict:
        """How lsh_buckets follow from vectors just written: nothing without an index."""
        planes = self._planes()
        if planes is None:
            return {}
        config = self.store.table("lsh_configs").head()["id"]  # one row

        def rows(new: dict[str, DataFrame]) -> DataFrame:
            hashed = lsh.hash_vectors(new["vectors"].where(F.col("vector").isNotNull()).select("id", "note_id", "vector", "created_at"), planes)
            return lsh.bucket_rows(hashed, F.lit(config), F.col("created_at"))

        return {"lsh_buckets": rows}

    def apply_files(self, events: DataFrame, now: Column | None = None) -> None:
        """File events (event_id, ts, path, op, new_path, text) with all that follows: blocks, vectors, buckets and keywords.

        Only notes of paths that the events name are looked at. Texts stay where they are until it is known which notes change.
        """
        now = F.current_timestamp() if now is None else now
        notes, rows = self.store.table("notes").select(*files.NOTE), files.relevant(events).select("event_id", "ts", "path", "op", "new_path", "text")
        told = files.referred(rows).persist()
        named = told.select(F.explode(F.array(F.col("path"), F.coalesce("new_path", "path"))).alias("path")).distinct()
        before, drop_before = written(files.referred(notes).join(named, "path", "left_semi"))
        after, drop_after = written(files.apply_events(before, told, now))
        held = F.struct("path", "name", "base_name", files.digest(F.col("text")))
        same = before.select("id", held.alias("_was"))
        moved, drop_moved = written(after.join(same, "id", "left").where(~held.eqNullSafe(F.col("_was"))).drop("_was"))
        few = self._small({"": moved.count()}, 100_000)
        self._save_notes(files.resolved(moved, [notes, rows], few), before.join(after, "id", "left_anti").select("id"), now, moved.select("id"))
        told.unpersist()
        for drop in (drop_moved, drop_after, drop_before):
            drop()

    def watch(self, stream: DataFrame, checkpoint: str):
        """A streaming query that applies file events as they come."""
        return files.start(stream, self.apply_files, checkpoint)

    def _planes(self) -> DataFrame | None:
        if self.store.table("lsh_configs").isEmpty():
            return None
        return self.store.table("lsh_hash_functions").select("hash_index", "projection")

    def _index(self) -> DataFrame:
        return self.store.table("lsh_buckets").select("bucket_hash", "vector_id")

    def rebuild_index(self) -> None:
        v = self.store.table("vectors").where(F.col("vector").isNotNull()).select("id", "note_id", "vector")
        first = v.select(F.size("vector")).head()
        made = lsh.build_index(v, first[0] if first else 0, self.seed, F.current_timestamp())
        buckets = made.pop("lsh_buckets")
        self.store.save(made, derived={"lsh_buckets": lambda new: buckets})

    def clear_index(self, config_id: str | None = None) -> None:
        """Drop the index, or one configuration of it; searches scan then."""
        self.store.save(lsh.clear(self.store.tables(), config_id))

    def ensure_index(self) -> bool:
        """Build the index if there is none; was it built?"""
        if self._planes() is not None:
            return False
        self.rebuild_index()
        return True

    def ensure_fts(self) -> None:
        """Keyword rows and postings for notes that have none; nothing is written when none lacks them."""
        t = self.store.tables()
        lacking = t["notes"].select(F.col("id").alias("note_id")).join(t["fts_content"].select("note_id").distinct(), "note_id", "left_anti")
        parts = self.store.parts_of(lacking, "note_id")
        if parts:
            here = self.store.tables(parts)
            rows = ingest.replace_fts_rows(t["fts_content"], t["notes"].limit(0), ingest.missing_fts_rows(here["notes"], here["blocks"], here["fts_content"]))
            mine = rows.where(part_of(F.col("note_id"), self.store.parts).isin(parts))
            self.store.save({"fts_content": mine}, parts, {"fts_postings": lambda new: fts.postings(new["fts_content"])})

    def automatic_setup(self, vault: DataFrame) -> dict[str, int]:
        told = self.process_vault(vault)
        self.ensure_index()
        self.ensure_fts()
        return told

    def rebuild(self, vault: DataFrame) -> dict[str, int]:
        self.store.drop_all()
        self.store.initialize()
        told = self.process_vault(vault)
        self.rebuild_index()
        return told

    def save_and_reindex(self, settings: Settings, vault: DataFrame) -> bool:
        """Take new settings; rebuild if they need it. Was it rebuilt?"""
        old, self.settings = self.settings, settings
        if requires_reindex(old, settings):
            self.rebuild(vault)
            return True
        return False

    def delete_notes(self, ids: list[str] | DataFrame) -> None:
        """Delete notes with all that belongs to them: listed ones, or those of a table (id)."""
        notes = self.store.table("notes")
        gone = notes.join(ids.select("id").distinct(), "id", "left_semi") if isinstance(ids, DataFrame) else notes.where(F.col("id").isin(ids))
        self._save_notes(gone.limit(0), gone.select("id"), F.current_timestamp())

    def cleanup(self) -> dict[str, int]:
        """Remove orphans; how many there were."""
        t = self.store.tables()
        counts = maintenance.orphan_counts(t["notes"], t["chunks"], t["vectors"]).head().asDict()
        chunks, vectors = maintenance.full_cleanup(t["notes"], t["chunks"], t["vectors"])
        self.store.save({"chunks": chunks, "vectors": vectors})
        return counts

    def _query(self, text: str) -> DataFrame:
        vector = EmbeddingService(self.provider).embed_text(text)
        return self.spark.createDataFrame([(0, vector, text)], "query_id bigint, query array<tinyint>, text string")

    def search(self, text: str, options: search.SearchOptions | None = None) -> DataFrame:
        t = self.store.tables()
        options = options or search.SearchOptions(min_score=0.1)
        return search.vector_search(self._query(text), t["vectors"], t["notes"], t["blocks"], t["chunks"], options, self._planes() if options.use_index else None, self._index())

    def hybrid(self, text: str, options: search.SearchOptions | None = None) -> DataFrame:
        t = self.store.tables()
        options = options or search.SearchOptions()
        return search.hybrid_search(self._query(text), t["vectors"], t["notes"], t["blocks"], t["fts_content"], options, self._planes() if options.use_index else None, self._index(), t["fts_postings"])

    def keywords(self, text: str, limit: int = 20, strict: bool = False) -> DataFrame:
        return search.search_fts(self.store.table("fts_content"), text, limit, strict, self.store.table("fts_postings"))

    def dynamic(self, text: str, current_path: str | None = None) -> DataFrame:
        """Search as the settings say, without the note that is open. An error is logged and gives no results."""
        options = search.SearchOptions(exclude_paths=(current_path,) if current_path else ())
        try:
            found = self.hybrid(text, options) if self.settings.search_mode == "hybrid" else self.search(text, replace(options, min_score=0.1))
            rows = found.collect()  # top_k rows
        except Exception as e:  # noqa: BLE001  as-you-type search never fails
            logger.error("Engine", "dynamic search failed", e)
            return self.spark.createDataFrame([], "query_id bigint, rank int, note_path string, text string")
        return self.spark.createDataFrame(rows, found.schema)

    def stats(self) -> dict:
        t = self.store.tables()
        return maintenance.db_stats(t["notes"], t["chunks"], t["vectors"]).head().asDict()
