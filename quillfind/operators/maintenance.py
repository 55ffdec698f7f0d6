"""Freshness, orphans and statistics, for all notes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_note(notes: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per note what a join with its chunks, note vectors and chunk vectors would count, without the join's product.

    The counts are those of the joined rows, so a second note vector doubles both chunk counts. Every
    side is aggregated first, so nothing is multiplied but numbers.
    """
    vn = vectors.where("type = 'note'").groupBy(F.col("note_id").alias("id")).agg(F.count("id").alias("_nv"), F.min("created_at").alias("_vn"))
    vc = vectors.where("type = 'chunk'").groupBy(F.col("chunk_id").alias("_chunk")).agg(F.count("id").alias("_k"), F.min("created_at").alias("_made"))
    c = chunks.select("note_id", F.col("id").alias("_chunk")).join(vc, "_chunk", "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    c = c.groupBy(F.col("note_id").alias("id")).agg(F.sum(F.greatest(F.col("_k"), F.lit(1))).alias("_rows"), F.sum("_k").alias("_with"), F.min("_made").alias("_vc"), F.bool_or(F.col("_k") == 0).alias("_bare"))
    out = notes.select("id", "path", "created_at", "updated_at").join(vn, "id", "left").join(c, "id", "left")
    times = F.greatest(F.coalesce("_nv", F.lit(0)), F.lit(1))
    has = F.coalesce(F.col("_nv") > 0, F.lit(False))
    total, with_vectors = (F.coalesce(F.col(k), F.lit(0)) * times for k in ("_rows", "_with"))
    fresh_note = F.coalesce(has & (F.col("_vn") >= F.col("updated_at")), F.lit(False))
    fresh_chunks = (total == 0) | F.coalesce((with_vectors == total) & (F.col("_vc") >= F.col("updated_at")), F.lit(False))
    old = ~has | (F.col("_vn") < F.col("updated_at")) | F.coalesce("_bare", F.lit(False)) | (F.col("_vc") < F.col("updated_at"))
    return out.select(
        F.col("id").alias("note_id"), "path", "created_at", "updated_at",
        has.alias("has_note_vector"), fresh_note.alias("note_vector_up_to_date"),
        total.alias("total_chunks"), with_vectors.alias("chunks_with_vectors"), fresh_chunks.alias("all_chunk_vectors_up_to_date"),
        (fresh_note & fresh_chunks).alias("fully_processed"), F.coalesce(old, F.lit(False)).alias("modified"),
    )


def modified_files(notes: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """path, updated_at of notes with a missing or older note vector, or a chunk with one; newest first."""
    return per_note(notes, chunks, vectors).where("modified").select("path", "updated_at").distinct().orderBy(F.desc("updated_at"), "path")


def files_without_vectors(notes: DataFrame, vectors: DataFrame) -> DataFrame:
    """note_id, path, updated_at of notes without a note vector; newest first."""
    own = vectors.where("type = 'note'").select(F.col("note_id").alias("id"))
    return notes.join(own, "id", "left_anti").orderBy(F.desc("created_at"), "id").select(F.col("id").alias("note_id"), "path", "updated_at")


def outdated_files(notes: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """path, note_id, updated_at: modified files and those without vectors; the latter are modified, too."""
    return per_note(notes, chunks, vectors).where("modified").select("path", "note_id", "updated_at")


def vector_count(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("n"))


def vector_count_by_type(vectors: DataFrame) -> DataFrame:
    """One row: note, block."""
    return vectors.agg(F.count_if(F.col("type") == "note").alias("note"), F.count_if(F.col("type") == "block").alias("block"))


def note_status(notes: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per note: has_note_vector, note_vector_up_to_date, total_chunks, chunks_with_vectors, all_chunk_vectors_up_to_date, fully_processed.

    Counts are over the joined rows, so a second note vector doubles both chunk counts.
    """
    return per_note(notes, chunks, vectors).drop("path", "created_at", "modified")


def up_to_date(notes: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return note_status(notes, chunks, vectors).select("note_id", F.col("fully_processed").alias("up_to_date"))


def last_vector_time(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("note_id").agg(F.max("created_at").alias("last_created_at"))


def vector_creation_stats(vectors: DataFrame) -> DataFrame:
    """One row: total, oldest, newest, mean vectors a note (0 when there are none)."""
    return vectors.agg(
        F.count(F.lit(1)).alias("total"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
        F.coalesce(F.try_divide(F.count(F.lit(1)).cast("double"), F.countDistinct("note_id").cast("double")), F.lit(0.0)).alias("vectors_per_note"),
    )


def _lost(rows: DataFrame, column: str, parents: DataFrame, how: str) -> DataFrame:
    return rows.join(parents.select(F.col("id").alias(column)).distinct(), column, how)


def orphan_counts(notes: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: orphaned_vectors, orphaned_chunks, vectors_of_deleted_chunks."""
    a = _lost(vectors, "note_id", notes, "left_anti").agg(F.count(F.lit(1)).alias("orphaned_vectors"))
    b = _lost(chunks, "note_id", notes, "left_anti").agg(F.count(F.lit(1)).alias("orphaned_chunks"))
    c = _lost(vectors.where("chunk_id IS NOT NULL"), "chunk_id", chunks, "left_anti").agg(F.count(F.lit(1)).alias("vectors_of_deleted_chunks"))
    return a.crossJoin(b).crossJoin(c)


def cleanup_vectors(notes: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vectors that stay."""
    return _lost(vectors, "note_id", notes, "left_semi")


def cleanup_chunks(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    return _lost(chunks, "note_id", notes, "left_semi")


def cleanup_chunk_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    free = vectors.where("chunk_id IS NULL")
    return free.unionByName(_lost(vectors.where("chunk_id IS NOT NULL"), "chunk_id", chunks, "left_semi"))


def full_cleanup(notes: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) that stay; vectors are held against the chunks that stay."""
    kept = cleanup_chunks(notes, chunks)
    return kept, cleanup_chunk_vectors(kept, cleanup_vectors(notes, vectors))


def fts_stats(content: DataFrame) -> DataFrame:
    return content.agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "docid").alias("sample_id"))


def db_stats(notes: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of totals."""
    told = per_note(notes, chunks, vectors).agg(F.count(F.lit(1)).alias("total_notes"), F.count_if("fully_processed").alias("processed_notes"), F.count_if("modified").alias("outdated_files"))
    kinds = vectors.agg(F.count(F.lit(1)).alias("total_vectors"), F.count_if(F.col("type") == "note").alias("note_vectors"), F.count_if(F.col("type") == "block").alias("block_vectors"))
    return told.crossJoin(kinds).crossJoin(orphan_counts(notes, chunks, vectors))


def report(stats: dict) -> str:
    """db_stats' row as text."""
    return "\n".join(f"{k.replace('_', ' ').capitalize()}: {v}" for k, v in stats.items())
