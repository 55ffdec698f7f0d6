"""Rows of the store: reads, writes and upserts, and ingest over the changed set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfind.functions.text import is_embedded_block, long_enough, stable_id, trim_white
from quillfind.operators.embed import Provider, embed


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def by_ids(df: DataFrame, ids: list[str]) -> DataFrame:
    """Rows whose id is listed; the list is the caller's and small."""
    return df.where(F.col("id").isin(ids)) if ids else df.where(F.lit(False))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), "id")


def older_than(df: DataFrame, column: str, when: Column) -> DataFrame:
    return df.where(F.col(column) < when).orderBy(column, "id")


def for_note(df: DataFrame, note_id: str, order: str = "created_at") -> DataFrame:
    return df.where(F.col("note_id") == note_id).orderBy(order, "id")


def not_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(trim_white(F.col(column)) != "")


def first_vector(vectors: DataFrame, chunk_id: str | None = None) -> DataFrame:
    """Of each note the oldest vector of the chunk, or without one of no chunk (block vectors are such, too)."""
    own = vectors.where(F.col("chunk_id").isNull() if chunk_id is None else F.col("chunk_id") == chunk_id)
    return own.groupBy("note_id").agg(F.min_by(F.struct("*"), F.struct("created_at", "id")).alias("r")).select("r.*")


def insert_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def update_row(df: DataFrame, row_id: str, values: dict[str, Column], now: Column) -> DataFrame:
    """Set values and updated_at of one row. Nothing to set leaves the table as it is."""
    if not values:
        return df
    hit = F.col("id") == row_id
    changed = {**values, "updated_at": now}
    return df.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in df.columns])


def delete_row(df: DataFrame, row_id: str) -> DataFrame:
    return df.where(~F.col("id").eqNullSafe(row_id))


def delete_for_notes(df: DataFrame, notes: DataFrame, column: str = "note_id") -> DataFrame:
    """Rows of df whose note is not among notes (id)."""
    return df.join(notes.select(F.col("id").alias(column)).distinct(), column, "left_anti")


def upsert_actions(have: DataFrame, later: DataFrame) -> DataFrame:
    """later (path, name, base_name, text) with id and action: insert, update or skip. Texts are told apart by their digests, so stored ones stay where they are."""
    old = have.select("path", F.col("id").alias("id"), F.col("name").alias("_n"), F.col("base_name").alias("_b"), F.sha2("text", 256).alias("_t"))
    same = F.col("_d").eqNullSafe(F.col("_t")) & F.col("name").eqNullSafe(F.col("_n")) & F.col("base_name").eqNullSafe(F.col("_b"))
    action = F.when(F.col("id").isNull(), "insert").when(same, "skip").otherwise("update")
    return later.withColumn("_d", F.sha2("text", 256)).join(old, "path", "left").withColumn("action", action).drop("_n", "_b", "_t", "_d")


def upsert_notes(have: DataFrame, later: DataFrame, now: Column) -> DataFrame:
    """The notes after the upsert. Ids come from the path; unchanged notes keep their times."""
    acted = upsert_actions(have, later)
    changed = acted.where("action <> 'skip'")
    old = have.select("path", F.col("created_at").alias("_c"))
    fresh = changed.join(old, "path", "left").select(
        F.coalesce("id", stable_id(F.lit("note"), F.col("path"))).alias("id"), F.coalesce("_c", now).alias("created_at"), now.alias("updated_at"), "path", "name", "base_name", "text"
    )
    return have.join(changed.select("path"), "path", "left_anti").select(*fresh.columns).unionByName(fresh)


def replace_blocks(blocks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Blocks with those of changed notes (id) replaced by fresh ones."""
    return delete_for_notes(blocks, changed).unionByName(fresh, allowMissingColumns=True)


def make_vectors(notes: DataFrame, blocks: DataFrame, provider: Provider, now: Column) -> DataFrame:
    """Vectors of notes that are long enough and of their non-blank blocks of an embedded kind.

    Note texts are embedded untrimmed. One pass over both, so a provider sees full batches.
    """
    none = F.lit(None).cast("string")
    n = notes.where(long_enough(F.col("text"))).select(F.col("id").alias("note_id"), none.alias("block_id"), F.lit("note").alias("type"), "text")
    b = not_blank(blocks.where(is_embedded_block(F.col("type"))), "content").select("note_id", F.col("id").alias("block_id"), F.lit("block").alias("type"), F.col("content").alias("text"))
    out = embed(n.unionByName(b), provider)
    key = stable_id(F.lit("vector"), F.col("note_id"), F.coalesce("block_id", F.lit("")))
    return out.select(key.alias("id"), "note_id", none.alias("chunk_id"), "block_id", "type", now.alias("created_at"), now.alias("updated_at"), "vector")


def fts_rows(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Keyword rows of notes and all blocks given: id, type, note_id, content, note_path, note_name, block_id."""
    n = notes.select(F.concat(F.lit("note_"), "id").alias("id"), F.lit("note").alias("type"), F.col("id").alias("note_id"), F.col("text").alias("content"), F.col("path").alias("note_path"), F.col("name").alias("note_name"), F.lit(None).cast("string").alias("block_id"))
    if "note_path" not in blocks.columns:  # blocks just split know their note
        blocks = blocks.join(notes.select(F.col("id").alias("note_id"), F.col("path").alias("note_path"), F.col("name").alias("note_name")), "note_id")
    b = blocks.select(F.concat(F.lit("block_"), "id").alias("id"), F.lit("block").alias("type"), "note_id", "content", "note_path", "note_name", F.col("id").alias("block_id"))
    return n.unionByName(b)


def missing_fts_rows(notes: DataFrame, blocks: DataFrame, content: DataFrame) -> DataFrame:
    """Keyword rows for notes that have none; all of their blocks, blank or not."""
    lack = notes.join(content.select(F.col("note_id").alias("id")).distinct(), "id", "left_anti")
    return fts_rows(lack, blocks)


def replace_fts_rows(content: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """content without rows of changed notes, then fresh ones with larger docids."""
    kept = delete_for_notes(content, changed)
    start = content.agg(F.coalesce(F.max("docid"), F.lit(-1)).alias("_top"))
    added = fresh.withColumn("_seq", F.monotonically_increasing_id()).crossJoin(F.broadcast(start))
    return kept.unionByName(added.withColumn("docid", F.col("_top") + 1 + F.col("_seq")).drop("_top", "_seq"), allowMissingColumns=True)


def cascade(tables: dict[str, DataFrame], changed: DataFrame, gone: DataFrame, vault_blocks, provider: Provider, now: Column, both: DataFrame | None = None) -> dict[str, DataFrame]:
    """blocks, vectors, chunks and fts_content after notes changed (whole rows) and notes went (id).

    What belonged to either goes; changed notes are split, embedded and indexed again. Chunks are not
    made by ingest, so those of notes that stay are kept. both: the ids of either, where they are known.
    """
    both = changed.select("id").unionByName(gone.select("id")) if both is None else both
    fresh = vault_blocks(changed)
    return {
        "blocks": replace_blocks(tables["blocks"], both, fresh),
        "vectors": delete_for_notes(tables["vectors"], both).unionByName(make_vectors(changed, fresh, provider, now), allowMissingColumns=True),
        "chunks": delete_for_notes(tables["chunks"], gone),
        "fts_content": replace_fts_rows(tables["fts_content"], both, fts_rows(changed, fresh.where(is_embedded_block(F.col("type"))))),
    }
