"""The driver's tables as the data model: deterministic, and the same rows in Spark and in DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfind.functions import fts
from quillfind.functions.text import chunk_texts, lines_of, long_enough
from quillfind.functions.vectors import process_vector
from quillfind.operators import lsh
from quillfind.operators.embed import HashingEmbedder, embed
from quillfind.schema import EMBEDDED_BLOCKS
from quillfind.sources.scratch import shared_dir

#: 2024-01-01 UTC in seconds; kinds that the lines of a document take in turn.
START = 1704067200
LINE_TYPES = ("paragraph", "heading", "list", "blockquote", "code", "table")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    created = F.lit(START) + F.col("doc_id") * 60
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.timestamp_seconds(created).alias("created_at"),
        F.timestamp_seconds(created + F.col("doc_id") % 5 * 3600).alias("updated_at"),
        F.concat(F.col("source"), F.lit("/"), name).alias("path"),
        name.alias("name"),
        F.col("doc_id").cast("string").alias("base_name"),
        "text",
        "doc_id",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block a line, with its kind in turn and its offset in characters."""
    return _blocks(spark, sf_dir).drop("note_path", "note_name")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).select("id", "doc_id", "created_at", "path", "name", F.posexplode_outer(lines_of("text")).alias("ordinal", "line"))
    kinds = F.array(*map(F.lit, LINE_TYPES))
    content, end = F.col("line.content"), F.col("line.end")
    return n.select(
        F.concat_ws("#", "id", F.col("ordinal").cast("string")).alias("id"),
        F.col("id").alias("note_id"),
        "created_at",
        "ordinal",
        F.element_at(kinds, ((F.col("doc_id") + F.col("ordinal")) % 6 + 1).cast("int")).alias("type"),
        content.alias("content"),
        F.struct(F.col("ordinal").alias("line"), F.lit(0).alias("col"), (end - F.length(content)).alias("offset")).alias("start_position"),
        F.struct(F.col("ordinal").alias("line"), F.length(content).alias("col"), end.alias("offset")).alias("end_position"),
        "doc_id",
        F.col("path").alias("note_path"),
        F.col("name").alias("note_name"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_texts(notes(spark, sf_dir).select("id", "created_at", "updated_at", "text"))
    return c.select(F.concat_ws("#", "id", F.col("chunk_index").cast("string")).alias("id"), F.col("id").alias("note_id"), "created_at", "updated_at", "chunk_index", F.col("chunk_text").alias("text"), "start_index", "end_index", "token_count")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Int8 vectors; one in 20 without a note, some older than their note, some of chunks that do not exist."""
    v = table(spark, sf_dir, "embeddings")
    note = F.when(F.col("vec_id") % 20 == 19, -1 - F.col("vec_id")).otherwise(F.col("vec_id") % 97)
    ref = F.concat_ws("#", note.cast("string"), (F.col("vec_id") % 5).cast("string"))
    kind = F.element_at(F.array(F.lit("note"), F.lit("chunk"), F.lit("block")), (F.col("vec_id") % 3 + 1).cast("int"))
    created = F.lit(START) + note * 60 + F.pmod(note, F.lit(5)) * 3600 + (F.col("vec_id") % 7 - 2) * 3600
    at = F.timestamp_seconds(created)
    return v.select(
        F.col("vec_id").cast("string").alias("id"),
        note.cast("string").alias("note_id"),
        F.when(kind == "chunk", ref).alias("chunk_id"),
        F.when(kind == "block", ref).alias("block_id"),
        kind.alias("type"),
        at.alias("created_at"),
        at.alias("updated_at"),
        process_vector(F.col("embedding")).alias("vector"),
        "vec_id",
    )


def fts_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes, then embedded blocks, in order of docid."""
    n = notes(spark, sf_dir)
    own = n.select(F.col("doc_id").alias("docid"), F.concat(F.lit("note_"), "id").alias("id"), F.lit("note").alias("type"), F.col("id").alias("note_id"), F.col("text").alias("content"), F.col("path").alias("note_path"), F.col("name").alias("note_name"), F.lit(None).cast("string").alias("block_id"))
    b = _blocks(spark, sf_dir).where(F.col("type").isin(*EMBEDDED_BLOCKS))
    b = b.select((F.lit(1 << 40) + F.col("doc_id") * (1 << 20) + F.col("ordinal")).alias("docid"), F.concat(F.lit("block_"), "id").alias("id"), F.lit("block").alias("type"), "note_id", "content", "note_path", "note_name", F.col("id").alias("block_id"))
    return own.unionByName(b)


_BUILT: dict[tuple, DataFrame] = {}


def built(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that is built once a session and folder, as an index is, and read from then on.

    It is written to the folder that all executors share.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/quillfind-index/{name}-{uuid.uuid4().hex}"
        df = make()
        df.write.parquet(path)
        _BUILT[key] = spark.read.schema(df.schema).parquet(path)
    return _BUILT[key]


def lsh_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.planes(spark, lsh.plane_count(table(spark, sf_dir, "embeddings").count()), 64, 42)


def lsh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket_hash, vector_id of all vectors, in order of buckets, so that few row groups are read for one."""

    def make() -> DataFrame:
        hashed = lsh.hash_vectors(vectors(spark, sf_dir).select("id", "vector"), lsh_planes(spark, sf_dir))
        return hashed.select("bucket_hash", F.col("id").alias("vector_id")).repartitionByRange("bucket_hash", "vector_id").sortWithinPartitions("bucket_hash")

    return built(spark, sf_dir, "buckets", make)


def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword index, in order of terms."""
    return built(spark, sf_dir, "postings", lambda: fts.postings(fts_content(spark, sf_dir)).repartitionByRange("term", "docid").sortWithinPartitions("term", "column", "docid"))


def note_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the notes' texts by the offline provider, embedded once as ingest does."""

    def make() -> DataFrame:
        long = notes(spark, sf_dir).where(long_enough(F.col("text"))).select(F.concat(F.lit("v"), "id").alias("id"), F.col("id").alias("note_id"), "text")
        none = F.lit(None).cast("string")
        return embed(long, HashingEmbedder(64)).select("id", "note_id", none.alias("chunk_id"), none.alias("block_id"), F.lit("note").alias("type"), "vector")

    return built(spark, sf_dir, "note-vectors", make)


_WHITE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

#: The same tables for DuckDB, times in seconds. WITH clauses by name; a query lists those that it needs.
CTES: dict[str, str] = {
    "notes": f"""notes AS (SELECT doc_id::VARCHAR AS id, doc_id, source || '/' || doc_id || '.md' AS path, doc_id || '.md' AS name, doc_id::VARCHAR AS base_name, text,
  {START} + doc_id * 60 AS created_at, {START} + doc_id * 60 + doc_id % 5 * 3600 AS updated_at FROM documents)""",
    "blocks": f"""lines AS (SELECT id AS note_id, doc_id, created_at, string_split(text, chr(10)) AS l FROM notes),
blocks AS (SELECT note_id || '#' || (i - 1) AS id, note_id, doc_id, created_at, i - 1 AS ordinal, (ARRAY{list(LINE_TYPES)})[(doc_id + i - 1) % 6 + 1] AS type, l[i] AS content,
  coalesce(list_sum(list_transform(list_slice(l, 1, i - 1), lambda x: length(x) + 1)), 0)::BIGINT AS start_offset FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM lines))""",
    "tok": f"""tok AS (SELECT id AS note_id, created_at, updated_at, text, list_filter(regexp_split_to_array(text, '{_WHITE}+'), lambda x: x <> '') AS t FROM notes)""",
    "chunks": """starts AS (SELECT *, len(t) AS n, unnest(CASE WHEN len(t) <= 128 THEN [0] ELSE generate_series(0, len(t) - 1, 112) END) AS s FROM tok),
chunks AS (SELECT note_id || '#' || (s // 112) AS id, note_id, created_at, updated_at, s // 112 AS chunk_index,
  CASE WHEN n <= 128 THEN text ELSE array_to_string(list_slice(t, s + 1, least(s + 128, n)), ' ') END AS text,
  CASE WHEN n <= 128 THEN 0 ELSE floor(s * (length(text)::DOUBLE / n) + 0.5::DOUBLE)::BIGINT END AS start_index,
  CASE WHEN n <= 128 THEN length(text) ELSE floor(least(s + 128, n) * (length(text)::DOUBLE / n) + 0.5::DOUBLE)::BIGINT END AS end_index,
  least(s + 128, n) - s AS token_count FROM starts)""",
    "vectors": f"""vn AS (SELECT vec_id, CASE WHEN vec_id % 20 = 19 THEN -1 - vec_id ELSE vec_id % 97 END AS k, (ARRAY['note', 'chunk', 'block'])[vec_id % 3 + 1] AS type, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
vl AS (SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, x: a + x)) AS size FROM vn),
vectors AS (SELECT vec_id::VARCHAR AS id, vec_id, k::VARCHAR AS note_id, CASE WHEN type = 'chunk' THEN k || '#' || (vec_id % 5) END AS chunk_id, CASE WHEN type = 'block' THEN k || '#' || (vec_id % 5) END AS block_id, type,
  {START} + k * 60 + ((k % 5) + 5) % 5 * 3600 + (vec_id % 7 - 2) * 3600 AS created_at,
  list_transform(e, lambda x: floor(greatest(-1::DOUBLE, least(1::DOUBLE, CASE WHEN size = 0 THEN x ELSE x / size END)) * 127::DOUBLE + 0.5::DOUBLE)::BIGINT) AS vector FROM vl)""",
    "fts": f"""fts AS (SELECT doc_id AS docid, 'note_' || id AS id, 'note' AS type, id AS note_id, text AS content, path AS note_path, name AS note_name, NULL AS block_id FROM notes
  UNION ALL SELECT {1 << 40} + b.doc_id * {1 << 20} + b.ordinal, 'block_' || b.id, 'block', b.note_id, b.content, n.path, n.name, b.id FROM blocks b JOIN notes n ON n.id = b.note_id WHERE b.type IN {EMBEDDED_BLOCKS}),
ftsw AS (SELECT *, regexp_extract_all(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM fts)""",
    "events_s": """ev AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type FROM events)""",
}


def sql(names: str, body: str) -> str:
    return "WITH " + ",\n".join(CTES[n] for n in names.split()) + "\n" + body
