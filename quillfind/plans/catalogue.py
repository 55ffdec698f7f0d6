"""The registered queries over the fixture tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfind.functions import text as X
from quillfind.functions import vectors as V
from quillfind.operators import embed as E
from quillfind.operators import ingest as I
from quillfind.operators import lsh as L
from quillfind.operators import maintenance as M
from quillfind.operators import search as S
from quillfind.plans import fixtures as fx
from quillfind.plans.fixtures import sql
from quillfind.plans.registry import ORACLES, QUERIES, listed, register, seconds  # noqa: F401  the registered queries are read from here, too
from quillfind.settings import MODEL_DIMENSIONS, Settings, model_dimensions, requires_reindex
from quillfind.streaming import editor as R
from quillfind.streaming import files as C

# --- vectors ---------------------------------------------------------------------------------------

_COS = """CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0::DOUBLE ELSE ({dot} / ({na} * {nb}) + 1) / 2 END"""
_DOT = "list_sum(list_transform(generate_series(1, len({a})), lambda i: {a}[i] * {b}[i]))::DOUBLE"
_SIZE = "sqrt(list_sum(list_transform({a}, lambda x: x * x))::DOUBLE)"


def _cos(a: str, b: str) -> str:
    return _COS.format(na=_SIZE.format(a=a), nb=_SIZE.format(a=b), dot=_DOT.format(a=a, b=b))


@register(sql("vectors", "SELECT vec_id, round(list_sum(list_transform(list_transform(e, lambda x: CASE WHEN size = 0 THEN x ELSE x / size END), lambda x, i: x * i)), 6) AS checksum FROM vl"))
def vec_l2_normalize(spark, d):
    v = fx.table(spark, d, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"))


@register(sql("vectors", "SELECT vec_id, array_to_string(list_transform(vector, lambda x: x::VARCHAR), ',') AS vector FROM vectors"))
def vec_quantize_int8(spark, d):
    return fx.vectors(spark, d).select("vec_id", listed(F.col("vector")).alias("vector"))


def _queries(spark, d) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return fx.vectors(spark, d).where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))


_KNN = "s AS (SELECT q.vec_id AS query_id, v.id, v.type, v.note_id, " + _cos("q.vector", "v.vector") + " AS score FROM vectors v, vectors q WHERE {n})"


@register("WITH " + fx.CTES["vectors"] + ",\n" + _KNN.format(n="q.vec_id % 50 = 0") + " SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.6 QUALIFY rank <= 5")
def vec_cosine_topk(spark, d):
    """The five best of at least 0.6."""
    found = S.knn(_queries(spark, d), fx.vectors(spark, d).select("id", "vector"), 5, 0.6)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("WITH " + fx.CTES["vectors"] + ",\n" + _KNN.format(n="q.vec_id % 50 = 0") + " SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10")
def vec_knn_multi(spark, d):
    return S.knn(_queries(spark, d), fx.vectors(spark, d).select("id", "vector"), 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_FILTERED = ",\nr AS (SELECT s.query_id, s.id, s.score, n.path AS note_path, CASE WHEN s.type = 'note' THEN n.path || ' - ' || n.name ELSE b.content END AS text FROM s JOIN notes n ON n.id = s.note_id LEFT JOIN vectors v ON v.id = s.id LEFT JOIN blocks b ON b.id = v.block_id WHERE s.type IN ('note', 'block') AND s.score >= 0.1 AND n.doc_id <> 3) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, note_path, text FROM r WHERE text IS NOT NULL QUALIFY rank <= 10"


def _excluded(spark, d) -> tuple[str, ...]:
    return tuple(r[0] for r in fx.notes(spark, d).where("doc_id = 3").select("path").collect())


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"), "note_path", "text")


@register("WITH " + ",\n".join(fx.CTES[k] for k in ("notes", "blocks", "vectors")) + ",\n" + _KNN.format(n="q.vec_id % 50 = 0") + _FILTERED)
def vec_knn_filtered(spark, d):
    options = S.SearchOptions(min_score=0.1, exclude_paths=_excluded(spark, d), use_index=False)
    return _hits(S.vector_search(_queries(spark, d), fx.vectors(spark, d), fx.notes(spark, d), fx.blocks(spark, d), None, options))


# --- LSH -------------------------------------------------------------------------------------------

_DIMS, _SEED = 64, 42
_U = "((('0x' || substr(md5('42:' || h || ':' || j || ':{k}'), 1, 8))::BIGINT + 1) / 4294967297::DOUBLE)"
_PLANES = f"""np AS (SELECT greatest(1, ceil(log2(count(*))))::BIGINT AS n FROM embeddings),
cells AS (SELECT h, unnest(generate_series(0, {_DIMS - 1})) AS j FROM (SELECT unnest(generate_series(0, n - 1)) AS h FROM np)),
cell AS (SELECT h, j, sqrt(-2::DOUBLE * ln({_U.format(k=1)})) * cos(6.283185307179586::DOUBLE * {_U.format(k=2)}) AS z FROM cells),
planes AS (SELECT h, list(z ORDER BY j) AS p FROM cell GROUP BY h)"""
_HASHED = """bits AS (SELECT v.vec_id, h, CASE WHEN list_sum(list_transform(generate_series(1, 64), lambda i: v.vector[i] * p[i])) > 0 THEN '1' ELSE '0' END AS b FROM vectors v, planes),
hashes AS (SELECT vec_id, string_agg(b, '' ORDER BY h) AS bucket_hash FROM bits GROUP BY vec_id), hashed AS (SELECT * FROM vectors JOIN hashes USING (vec_id))"""
_LSH = "WITH " + fx.CTES["vectors"] + ",\n" + _PLANES + ",\n" + _HASHED + ",\nbuckets AS (SELECT bucket_hash, count(*) AS size FROM hashed GROUP BY 1)"
_NEAR = """,
q AS (SELECT vec_id AS query_id, vector AS qv, bucket_hash AS qh FROM hashed WHERE vec_id % 50 = 0),
dist AS (SELECT query_id, b.bucket_hash, size, hamming(qh, b.bucket_hash) AS distance FROM q, buckets b),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY query_id ORDER BY distance, bucket_hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nearer FROM dist),
near AS (SELECT * FROM run WHERE nearer < 100)"""


def _hashed(spark, d) -> DataFrame:
    return L.hash_vectors(fx.vectors(spark, d), fx.lsh_planes(spark, d))


@register("WITH " + _PLANES + " SELECT h AS hash_index, j AS place, round(z, 9) + 0 AS value FROM cell")
def lsh_planes(spark, d):
    n = L.plane_count(fx.table(spark, d, "embeddings").count())
    return L.plane_rows(spark, n, _DIMS, _SEED).select(F.col("hash_index").cast("bigint").alias("hash_index"), F.col("place").cast("bigint").alias("place"), (F.round("value", 9) + 0.0).alias("value"))


@register(_LSH + " SELECT vec_id, bucket_hash FROM hashed")
def lsh_bucket_hash(spark, d):
    return _hashed(spark, d).select("vec_id", "bucket_hash")


@register(_LSH + " SELECT bucket_hash, count(*) AS size, string_agg(id, ',' ORDER BY id) AS vector_ids FROM hashed GROUP BY 1")
def lsh_buckets(spark, d):
    return L.buckets(_hashed(spark, d)).select("bucket_hash", "size", F.array_join("vector_ids", ",").alias("vector_ids"))


@register(_LSH + " SELECT count(DISTINCT bucket_hash) AS total_buckets, count(*) AS total_vectors_ref, round(avg(size), 6) AS avg_bucket_size, max(size) AS max_bucket_size, count(*) FILTER (size = 0) AS empty_buckets, sum(size)::BIGINT AS total_vectors FROM buckets")
def lsh_stats(spark, d):
    return L.lsh_stats(_hashed(spark, d)).withColumn("avg_bucket_size", F.round("avg_bucket_size", 6))


@register(_LSH + _NEAR + " SELECT query_id, bucket_hash, distance::BIGINT AS distance FROM dist")
def lsh_hamming(spark, d):
    h = _hashed(spark, d)
    q = h.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), L.bits_of(F.col("bucket_hash")).alias("q"))
    out = L.bucket_sizes(h).crossJoin(F.broadcast(q))
    return out.select("query_id", "bucket_hash", V.hamming_bits(F.col("q"), L.bits_of(F.col("bucket_hash"))).cast("bigint").alias("distance"))


@register(_LSH + _NEAR + " SELECT query_id, h.id, distance::BIGINT AS distance FROM near JOIN hashed h USING (bucket_hash)")
def lsh_candidates(spark, d):
    index = fx.lsh_index(spark, d)
    asked = F.col("vector_id").cast("bigint")
    q = index.where(asked % 50 == 0).select(asked.alias("query_id"), "bucket_hash")
    return L.candidates(q, index, 10).select("query_id", F.col("vector_id").alias("id"), F.col("distance").cast("bigint").alias("distance"))


@register(
    _LSH.replace("WITH ", "WITH " + fx.CTES["notes"] + ",\n" + fx.CTES["blocks"] + ",\n", 1)
    + _NEAR
    + ",\ns AS (SELECT n.query_id, h.id, h.type, h.note_id, h.block_id, " + _cos("q.qv", "h.vector") + " AS score FROM near n JOIN hashed h USING (bucket_hash) JOIN q ON q.query_id = n.query_id)"
    + ",\nr AS (SELECT s.query_id, s.id, s.score, n.path AS note_path, CASE WHEN s.type = 'note' THEN n.path || ' - ' || n.name ELSE b.content END AS text FROM s JOIN notes n ON n.id = s.note_id LEFT JOIN blocks b ON b.id = s.block_id WHERE s.type IN ('note', 'block') AND s.score >= 0.1) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, note_path, text FROM r WHERE text IS NOT NULL QUALIFY rank <= 10"
)
def lsh_search(spark, d):
    return _hits(S.vector_search(_queries(spark, d), fx.vectors(spark, d), fx.notes(spark, d), fx.blocks(spark, d), None, S.SearchOptions(min_score=0.1), fx.lsh_planes(spark, d), fx.lsh_index(spark, d)))


# --- text ------------------------------------------------------------------------------------------


@register(sql("notes tok chunks", "SELECT id, chunk_index::BIGINT AS chunk_index, md5(text) AS text_md5, start_index::BIGINT AS start_index, end_index::BIGINT AS end_index, token_count::BIGINT AS token_count FROM chunks"))
def text_chunk(spark, d):
    c = fx.chunks(spark, d)
    return c.select("id", *[F.col(k).cast("bigint").alias(k) for k in ("chunk_index", "start_index", "end_index", "token_count")], F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register(sql("notes tok", "SELECT note_id, len(t)::BIGINT AS n_tokens FROM tok"))
def text_token_count(spark, d):
    return fx.notes(spark, d).select(F.col("id").alias("note_id"), X.token_count(F.col("text")).cast("bigint").alias("n_tokens"))


@register(sql("notes tok", "SELECT note_id, len(t) > 128 AS needs FROM tok"))
def text_needs_chunking(spark, d):
    return fx.notes(spark, d).select(F.col("id").alias("note_id"), X.needs_chunking(F.col("text"), 128).alias("needs"))


@register(sql("notes blocks", "SELECT id, type, content, start_offset FROM blocks"))
def block_split(spark, d):
    """Blocks cut out of the whole text again by their offsets, as the section splitter does."""
    b = fx.blocks(spark, d).groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "type", F.col("start_position").alias("start"), F.col("end_position").alias("end")))).alias("s"))
    sections = b.select("note_id", F.transform("s", lambda x: F.struct(x["type"].alias("type"), x["start"].alias("start"), x["end"].alias("end"))).alias("sections"))
    whole = fx.notes(spark, d).select(F.col("id").alias("note_id"), F.col("text").alias("content")).join(sections, "note_id")
    out = X.split_sections(whole)
    return out.select(F.concat_ws("#", "note_id", F.col("ordinal").cast("string")).alias("id"), "type", "content", F.col("start_position.offset").cast("bigint").alias("start_offset"))


_ANCHORED = "CASE WHEN ordinal % 3 = 0 THEN content || ' ^a-' || ordinal || ' ' ELSE content END"


@register(sql("notes blocks", f"SELECT id, nullif(regexp_extract({_ANCHORED}, '\\^([a-zA-Z0-9-]+)[ \\t\\n\\r]*$', 1), '') AS anchor_id FROM blocks"))
def block_anchor_id(spark, d):
    tail = F.when(F.col("ordinal") % 3 == 0, F.concat("content", F.lit(" ^a-"), F.col("ordinal").cast("string"), F.lit(" "))).otherwise(F.col("content"))
    return fx.blocks(spark, d).select("id", X.anchor_id(tail).alias("anchor_id"))


@register(sql("notes blocks", "SELECT type, count(*) AS n FROM blocks WHERE type IN ('paragraph', 'heading', 'list', 'blockquote') GROUP BY type"))
def block_whitelist(spark, d):
    return fx.blocks(spark, d).where(X.is_embedded_block(F.col("type"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@register(sql("notes", f"SELECT id FROM notes WHERE length(regexp_replace(text, '^{fx._WHITE}+|{fx._WHITE}+$', '', 'g')) >= 16"))
def note_min_length(spark, d):
    return fx.notes(spark, d).where(X.long_enough(F.col("text"))).select("id")


@register(
    sql(
        "notes",
        """, c AS (SELECT id, string_split(text, chr(10)) AS l, (doc_id % len(string_split(text, chr(10))))::BIGINT AS line, 5 AS col FROM notes),
w AS (SELECT id, list_filter(regexp_split_to_array(array_to_string(list_slice(l, greatest(0, line - 10) + 1, least(len(l) - 1, line + 10) + 1), chr(10)), '[ \\t\\n\\r]+'), lambda x: x <> '') AS words,
  len(list_filter(regexp_split_to_array(array_to_string(list_append(list_slice(l, greatest(0, line - 10) + 1, line), left(l[line + 1], col)), chr(10)), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS before FROM c)
SELECT id, array_to_string(list_slice(words, greatest(0, before - 32) + 1, least(len(words), before + 32)), ' ') AS context FROM w""",
    )
)
def cursor_context(spark, d):
    n = fx.notes(spark, d)
    line = (F.col("doc_id") % F.size(F.split("text", "\n", -1))).cast("int")
    return n.select("id", X.cursor_context(F.col("text"), line, F.lit(5), 64).alias("context"))


@register(sql("notes", "SELECT id, CASE WHEN length(text) > 150 THEN text[:150] || '...' ELSE text END AS panel, CASE WHEN length(text) > 200 THEN text[:200] || '...' ELSE text END AS modal FROM notes"))
def snippet(spark, d):
    return fx.notes(spark, d).select("id", X.snippet(F.col("text"), 150).alias("panel"), X.snippet(F.col("text"), 200).alias("modal"))


@register(sql("notes", "SELECT id, '[[' || path || '|' || name || ']]' AS link, CASE WHEN doc_id % 2 = 0 THEN text ELSE '[[' || path || '|' || name || ']]' END AS copied, path || ' - ' || name AS title FROM notes"))
def link_format(spark, d):
    kind = F.when(F.col("doc_id") % 2 == 0, "block").otherwise("note")
    return fx.notes(spark, d).select("id", X.format_link(F.col("path"), F.col("name")).alias("link"), X.copied(kind, F.col("text"), F.col("path"), F.col("name")).alias("copied"), X.note_title(F.col("path"), F.col("name")).alias("title"))


@register("SELECT doc_id, printf('%.3f', (doc_id % 1000)::DOUBLE / 1000) AS shown FROM documents")
def score_format(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", X.format_score((F.col("doc_id") % 1000).cast("double") / 1000).alias("shown"))


@register("SELECT doc_id, CASE WHEN ceil(length(text) / 4.0::DOUBLE) > 2000 THEN text[:8000] ELSE text END AS cut FROM documents")
def cloud_truncate(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", X.truncate_for_cloud(F.col("text"), 2000).alias("cut"))


@register("SELECT conv_id, turn, trim(replace(replace(text, '\"', ''), '''', '')) AS query FROM conversations")
def fts_sanitise(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", X.fts_sanitise(F.col("text")).alias("query"))


# --- keyword search --------------------------------------------------------------------------------


def _found(df: DataFrame) -> DataFrame:
    return df.select("docid", "id", "note_path", "relevance")


def _fts(where: str, limit: int = 20) -> str:
    return sql("notes blocks fts", f"SELECT docid, id, note_path, 1.0::DOUBLE AS relevance FROM ftsw WHERE {where} ORDER BY docid LIMIT {limit}")


@register(_fts("list_contains(w, 'the') AND list_contains(w, 'of') AND list_contains(w, 'and')"))
def fts_and(spark, d):
    return _found(S.search_fts(fx.fts_content(spark, d), "The of \"and\"", 20, postings=fx.fts_postings(spark, d)))


@register(_fts("len(list_filter(w, lambda x: starts_with(x, 'thest'))) > 0"))
def fts_prefix(spark, d):
    return _found(S.search_fts(fx.fts_content(spark, d), "thest*", 20, postings=fx.fts_postings(spark, d)))


@register(_fts("(list_contains(w, 'und') OR list_contains(w, 'les')) AND NOT list_contains(w, 'der')"))
def fts_or_not(spark, d):
    return _found(S.search_fts(fx.fts_content(spark, d), "(und OR les) NOT der", 20, postings=fx.fts_postings(spark, d)))


@register(_fts("list_contains(w, 'the')", 7))
def fts_limit_order(spark, d):
    return _found(S.search_fts(fx.fts_content(spark, d), "the", 7, postings=fx.fts_postings(spark, d)))


@register(
    sql(
        "notes blocks fts",
        """, pos AS (SELECT docid, i, w[i] AS t FROM (SELECT docid, w, unnest(generate_series(1, len(w))) AS i FROM ftsw WHERE list_contains(w, 'the') AND list_contains(w, 'was')) WHERE w[i] IN ('the', 'was')),
m AS (SELECT DISTINCT a.docid FROM pos a JOIN pos b ON a.docid = b.docid AND a.t = 'the' AND b.t = 'was' AND abs(a.i - b.i) <= 3)
SELECT docid, id, note_path, 1.0::DOUBLE AS relevance FROM fts JOIN m USING (docid) ORDER BY docid LIMIT 20""",
    )
)
def fts_near(spark, d):
    return _found(S.search_fts(fx.fts_content(spark, d), "the NEAR/2 was", 20, postings=fx.fts_postings(spark, d)))


@register(sql("notes blocks fts", "SELECT docid, id, note_path, 1.0::DOUBLE AS relevance FROM ftsw WHERE list_contains(regexp_extract_all(note_path, '[a-z0-9]+'), 'src3') AND list_contains(w, 'the') ORDER BY docid LIMIT 20"))
def fts_column(spark, d):
    return _found(S.search_fts(fx.fts_content(spark, d), "note_path:src3 the", 20, postings=fx.fts_postings(spark, d)))


@register(sql("notes blocks fts", "SELECT 'note_' || n.id AS id, 'note' AS type, n.id AS note_id FROM notes n WHERE n.doc_id % 3 = 0 UNION ALL SELECT 'block_' || b.id, 'block', b.note_id FROM blocks b WHERE b.doc_id % 3 = 0"))
def fts_ensure_missing(spark, d):
    have = fx.fts_content(spark, d).where(F.col("note_id").cast("bigint") % 3 != 0)
    return I.missing_fts_rows(fx.notes(spark, d), fx.blocks(spark, d), have).select("id", "type", "note_id")


@register(sql("notes blocks fts", "SELECT count(*) AS n, min_by(id, docid) AS sample_id FROM fts"))
def fts_stats(spark, d):
    return M.fts_stats(fx.fts_content(spark, d))


# --- hybrid search ---------------------------------------------------------------------------------


def _spoken(spark, d) -> DataFrame:
    """The stated query set: the whole first user turn of every conversation whose id is divisible by 50."""
    first = fx.table(spark, d, "conversations").where("role = 'user' AND conv_id % 50 = 0").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select(F.col("conv_id").cast("bigint").alias("query_id"), "text")


_TOK = "regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
_EMBED = """{out} AS (SELECT k, list_transform(raw, lambda x: floor(greatest(-1::DOUBLE, least(1::DOUBLE, CASE WHEN size = 0 THEN x ELSE x / size END)) * 127::DOUBLE + 0.5::DOUBLE)::BIGINT) AS vector FROM (
  SELECT k, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS size FROM (
    SELECT k, list_transform(generate_series(0, 63), lambda i: coalesce(m[i], 0)::DOUBLE) AS raw FROM (
      SELECT k, map_from_entries(list((p, s))) AS m FROM (
        SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS p, sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS s FROM (SELECT {key} AS k, unnest({tok}) AS t FROM {src}) GROUP BY ALL) GROUP BY k))))"""


def _hybrid_sql(weight: float, exclude: str = "false") -> str:
    parts = [
        fx.CTES["notes"],
        "spoken AS (SELECT conv_id AS query_id, min_by(text, turn) AS text FROM conversations WHERE role = 'user' AND conv_id % 50 = 0 GROUP BY conv_id)",
        _EMBED.format(out="qe", key="query_id", tok=_TOK.format(c="text"), src="spoken"),
        _EMBED.format(out="ne", key="id", tok=_TOK.format(c="text"), src="(SELECT * FROM notes WHERE length(trim(text)) >= 16)"),
        "s AS (SELECT q.k AS query_id, n.k AS id, " + _cos("q.vector", "n.vector") + " AS score FROM qe q, ne n)",
        f"v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, 'v' || id) AS rank FROM s JOIN notes USING (id) WHERE NOT ({exclude}) QUALIFY rank <= 10)",
        f"h AS (SELECT q.query_id, n.id, row_number() OVER (PARTITION BY q.query_id ORDER BY n.doc_id) AS rank FROM spoken q JOIN (SELECT *, {_TOK.format(c='text')} AS w FROM notes) n ON list_has_all(n.w, {_TOK.format(c="translate(q.text, chr(34) || chr(39), '')")}) WHERE len({_TOK.format(c="translate(q.text, chr(34) || chr(39), '')")}) > 0 QUALIFY rank <= 20)",
        f"u AS (SELECT coalesce(v.query_id, h.query_id) AS query_id, coalesce(v.id, h.id) AS id, v.rank AS rv, h.rank AS rf, coalesce({weight}::DOUBLE * (1::DOUBLE / (60 + v.rank)), 0) + coalesce((1 - {weight}::DOUBLE) * (1::DOUBLE / (60 + h.rank)), 0) AS score FROM v FULL JOIN h ON v.query_id = h.query_id AND v.id = h.id)",
        "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rv NULLS LAST, rf) AS rank FROM u WHERE score > 0 QUALIFY rank <= 10)",
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT query_id, rank, round(score, 9) AS score, id AS key, path AS note_path FROM t JOIN notes USING (id) WHERE NOT ({exclude})"


def _hybrid(spark, d, options: S.SearchOptions) -> DataFrame:
    """Every text is read once for all queries; an index of all terms would be written for one reading."""
    n = fx.notes(spark, d)
    q = E.embed(_spoken(spark, d), E.HashingEmbedder(_DIMS)).withColumnRenamed("vector", "query")
    content = fx.fts_content(spark, d).where("type = 'note'")
    out = S.hybrid_search(q, fx.note_vectors(spark, d), n, None, content, options)
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 9).alias("score"), "key", "note_path")


@register(_hybrid_sql(0.5))
def hybrid_rrf(spark, d):
    return _hybrid(spark, d, S.SearchOptions(use_index=False))


@register(_hybrid_sql(0.8))
def hybrid_rrf_weighted(spark, d):
    return _hybrid(spark, d, S.SearchOptions(use_index=False, weight=0.8))


@register(_hybrid_sql(0.5, "doc_id IN (0, 3)"))
def hybrid_rrf_excluded(spark, d):
    paths = tuple(r[0] for r in fx.notes(spark, d).where("doc_id IN (0, 3)").select("path").collect())
    return _hybrid(spark, d, S.SearchOptions(use_index=False, exclude_paths=paths))


# --- store and ingest ------------------------------------------------------------------------------

_NEXT = """nxt AS (SELECT id, path, CASE WHEN doc_id % 7 = 0 THEN name || 'x' ELSE name END AS name, base_name, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text, doc_id FROM notes WHERE doc_id % 4 <> 1),
prev AS (SELECT * FROM notes WHERE doc_id % 3 <> 0)"""


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Stored notes, and the same vault later."""
    n = fx.notes(spark, d)
    later = n.where("doc_id % 4 <> 1")
    later = later.withColumn("name", F.when(F.col("doc_id") % 7 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    later = later.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return n.where("doc_id % 3 <> 0"), later.select("path", "name", "base_name", "text")


@register("WITH " + fx.CTES["notes"] + ",\n" + _NEXT + " SELECT n.path, CASE WHEN p.id IS NULL THEN 'insert' WHEN n.text <> p.text OR n.name <> p.name OR n.base_name <> p.base_name THEN 'update' ELSE 'skip' END AS action FROM nxt n LEFT JOIN prev p USING (path)")
def upsert_actions(spark, d):
    have, later = _versions(spark, d)
    return I.upsert_actions(have, later).select("path", "action")


@register("WITH " + fx.CTES["notes"] + ",\n" + _NEXT + f" SELECT coalesce(n.path, p.path) AS path, coalesce(n.name, p.name) AS name, md5(coalesce(n.text, p.text)) AS text_md5, CASE WHEN n.path IS NULL OR (p.id IS NOT NULL AND n.text = p.text AND n.name = p.name) THEN p.updated_at ELSE {fx.START} END AS updated_at FROM nxt n FULL JOIN prev p USING (path)")
def upsert_apply(spark, d):
    have, later = _versions(spark, d)
    out = I.upsert_notes(have.drop("doc_id"), later, F.timestamp_seconds(F.lit(fx.START)))
    return out.select("path", "name", F.md5(F.col("text").cast("binary")).alias("text_md5"), seconds("updated_at"))


@register("WITH " + fx.CTES["notes"] + ",\n" + _NEXT + " SELECT CASE WHEN p.id IS NULL THEN 'insert' WHEN n.text <> p.text OR n.name <> p.name THEN 'update' ELSE 'skip' END AS action, count(*) AS n FROM nxt n LEFT JOIN prev p USING (path) GROUP BY 1")
def ingest_counts(spark, d):
    have, later = _versions(spark, d)
    return I.upsert_actions(have, later).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register(sql("notes", f"SELECT id, path, updated_at FROM notes WHERE updated_at < {fx.START + 20000}"))
def notes_older_than(spark, d):
    n = I.older_than(fx.notes(spark, d), "updated_at", F.timestamp_seconds(F.lit(fx.START + 20000)))
    return n.select("id", "path", seconds("updated_at"))


@register(sql("notes", "SELECT id, name FROM notes WHERE path IN (SELECT path FROM notes WHERE doc_id = 17)"))
def notes_by_path(spark, d):
    path = fx.notes(spark, d).where("doc_id = 17").select("path").head()[0]
    return I.by_key(fx.notes(spark, d), "path", path).select("id", "name")


@register(sql("notes", "SELECT id, created_at FROM notes ORDER BY created_at DESC, id LIMIT 25"))
def notes_newest(spark, d):
    return I.newest_first(fx.notes(spark, d)).limit(25).select("id", seconds("created_at"))


@register(sql("vectors", f"SELECT id, note_id, created_at FROM vectors WHERE created_at < {fx.START + 9000}"))
def vectors_older_than(spark, d):
    return I.older_than(fx.vectors(spark, d), "created_at", F.timestamp_seconds(F.lit(fx.START + 9000))).select("id", "note_id", seconds("created_at"))


@register(sql("vectors", "SELECT id, type FROM vectors WHERE id IN ('1', '5', '7', '499', 'none')"))
def vectors_by_ids(spark, d):
    return I.by_ids(fx.vectors(spark, d), ["1", "5", "7", "499", "none"]).select("id", "type")


@register(sql("vectors", "SELECT note_id, arg_min(id, (created_at, id)) AS id FROM vectors WHERE chunk_id IS NULL AND note_id IN ('3', '8') GROUP BY note_id"))
def vector_by_note(spark, d):
    return I.first_vector(fx.vectors(spark, d).where(F.col("note_id").isin("3", "8"))).select("note_id", "id")


@register(sql("notes tok chunks", "SELECT id, note_id, chunk_index::BIGINT AS chunk_index FROM chunks WHERE note_id = '9'"))
def chunks_for_note(spark, d):
    return I.for_note(fx.chunks(spark, d), "9", "chunk_index").select("id", "note_id", F.col("chunk_index").cast("bigint").alias("chunk_index"))


@register(sql("notes blocks", "SELECT id, ordinal::BIGINT AS ordinal, content FROM blocks WHERE note_id = '9' AND trim(content) <> ''"))
def blocks_for_note(spark, d):
    b = I.not_blank(I.for_note(fx.blocks(spark, d), "9", "ordinal"), "content")
    return b.select("id", F.col("ordinal").cast("bigint").alias("ordinal"), "content")


@register(sql("notes", "SELECT id, md5(CASE WHEN doc_id = 4 THEN 'new' ELSE text END) AS text_md5 FROM notes WHERE doc_id <> 6"))
def note_update_delete(spark, d):
    n = I.update_row(fx.notes(spark, d), "4", {"text": F.lit("new")}, F.timestamp_seconds(F.lit(fx.START)))
    return I.delete_row(n, "6").select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register(sql("notes blocks", "SELECT 'note' AS type, count(*) AS n FROM notes WHERE length(trim(text)) >= 16 UNION ALL SELECT 'block', count(*) FROM blocks WHERE type IN ('paragraph', 'heading', 'list', 'blockquote') AND trim(content) <> ''"))
def ingest_vectors(spark, d):
    """Vectors that ingest makes of all notes and their embedded blocks, counted by kind."""
    made = I.make_vectors(fx.notes(spark, d), fx.blocks(spark, d), E.HashingEmbedder(_DIMS), F.timestamp_seconds(F.lit(fx.START)))
    return made.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# --- maintenance -----------------------------------------------------------------------------------

_MODEL = "notes tok chunks vectors"
_FAN = """FROM notes n LEFT JOIN chunks c ON n.id = c.note_id LEFT JOIN vectors vn ON n.id = vn.note_id AND vn.type = 'note' LEFT JOIN vectors vc ON c.id = vc.chunk_id AND vc.type = 'chunk'"""
_STALE = "vn.id IS NULL OR vn.created_at < n.updated_at OR (c.id IS NOT NULL AND vc.id IS NULL) OR (c.id IS NOT NULL AND vc.created_at < n.updated_at)"
_STATUS = f"""g AS (SELECT n.id AS note_id, n.updated_at, count(c.id) AS total_chunks, count(vn.id) AS nv, count(vc.id) AS chunks_with_vectors, min(vn.created_at) AS a, min(vc.created_at) AS b {_FAN} GROUP BY n.id, n.updated_at),
st AS (SELECT note_id, total_chunks, chunks_with_vectors, nv > 0 AS has_note_vector, coalesce(nv > 0 AND a >= updated_at, false) AS note_vector_up_to_date, total_chunks = 0 OR coalesce(chunks_with_vectors = total_chunks AND b >= updated_at, false) AS all_chunk_vectors_up_to_date FROM g)"""


def _model(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fx.notes(spark, d), fx.chunks(spark, d), fx.vectors(spark, d)


@register(sql(_MODEL, f"SELECT DISTINCT n.path, n.updated_at {_FAN} WHERE {_STALE}"))
def files_modified(spark, d):
    return M.modified_files(*_model(spark, d)).select("path", seconds("updated_at"))


@register(sql(_MODEL, "SELECT n.id AS note_id, path FROM notes n LEFT JOIN vectors v ON v.note_id = n.id AND v.type = 'note' WHERE v.id IS NULL"))
def files_without_vectors(spark, d):
    n, _, v = _model(spark, d)
    return M.files_without_vectors(n, v).select("note_id", "path")


@register(sql(_MODEL, f"SELECT DISTINCT n.path, n.id AS note_id, n.updated_at {_FAN} WHERE {_STALE}"))
def outdated_files(spark, d):
    return M.outdated_files(*_model(spark, d)).select("path", "note_id", seconds("updated_at"))


@register(sql("vectors", "SELECT count(*) FILTER (type = 'note') AS note, count(*) FILTER (type = 'block') AS block FROM vectors"))
def vector_count_by_type(spark, d):
    return M.vector_count_by_type(fx.vectors(spark, d))


@register(sql("vectors", "SELECT count(*) AS n FROM vectors"))
def vector_count(spark, d):
    return M.vector_count(fx.vectors(spark, d))


@register(sql("vectors", "SELECT count(*) AS total, min(created_at) AS oldest, max(created_at) AS newest, round(count(*)::DOUBLE / count(DISTINCT note_id), 6) AS vectors_per_note FROM vectors"))
def vector_creation_stats(spark, d):
    s = M.vector_creation_stats(fx.vectors(spark, d))
    return s.select("total", seconds("oldest"), seconds("newest"), F.round("vectors_per_note", 6).alias("vectors_per_note"))


@register(sql("vectors", "SELECT note_id, max(created_at) AS last_created_at FROM vectors GROUP BY note_id"))
def last_vector_time(spark, d):
    return M.last_vector_time(fx.vectors(spark, d)).select("note_id", seconds("last_created_at"))


@register(sql(_MODEL, ", " + _STATUS + " SELECT note_id, note_vector_up_to_date AND all_chunk_vectors_up_to_date AS up_to_date FROM st"))
def note_uptodate(spark, d):
    return M.up_to_date(*_model(spark, d))


@register(sql(_MODEL, ", " + _STATUS + " SELECT *, note_vector_up_to_date AND all_chunk_vectors_up_to_date AS fully_processed FROM st"))
def note_status(spark, d):
    return M.note_status(*_model(spark, d)).drop("updated_at")


_ORPHANS = """(SELECT count(*) FROM vectors WHERE note_id NOT IN (SELECT id FROM notes)) AS orphaned_vectors, (SELECT count(*) FROM chunks WHERE note_id NOT IN (SELECT id FROM notes)) AS orphaned_chunks,
 (SELECT count(*) FROM vectors WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT id FROM chunks)) AS vectors_of_deleted_chunks"""


@register(sql(_MODEL, f"SELECT {_ORPHANS}"))
def orphan_counts(spark, d):
    return M.orphan_counts(*_model(spark, d))


@register(sql(_MODEL, "SELECT id FROM vectors WHERE note_id IN (SELECT id FROM notes)"))
def cleanup_vectors(spark, d):
    n, _, v = _model(spark, d)
    return M.cleanup_vectors(n, v).select("id")


@register(sql(_MODEL, "SELECT id FROM chunks WHERE note_id IN (SELECT id FROM notes WHERE doc_id % 2 = 0)"))
def cleanup_chunks(spark, d):
    n, c, _ = _model(spark, d)
    return M.cleanup_chunks(n.where("doc_id % 2 = 0"), c).select("id")


@register(sql(_MODEL, "SELECT id FROM vectors WHERE chunk_id IS NULL OR chunk_id IN (SELECT id FROM chunks)"))
def cleanup_chunk_vectors(spark, d):
    _, c, v = _model(spark, d)
    return M.cleanup_chunk_vectors(c, v).select("id")


@register(sql(_MODEL, "SELECT id FROM vectors WHERE note_id IN (SELECT id FROM notes WHERE doc_id % 2 = 0) AND (chunk_id IS NULL OR chunk_id IN (SELECT id FROM chunks WHERE note_id IN (SELECT id FROM notes WHERE doc_id % 2 = 0)))"))
def full_cleanup(spark, d):
    n, c, v = _model(spark, d)
    return M.full_cleanup(n.where("doc_id % 2 = 0"), c, v)[1].select("id")


@register(
    sql(
        _MODEL,
        ", " + _STATUS + f""" SELECT (SELECT count(*) FROM st) AS total_notes, (SELECT count(*) FROM st WHERE note_vector_up_to_date AND all_chunk_vectors_up_to_date) AS processed_notes,
 (SELECT count(*) FROM vectors) AS total_vectors, (SELECT count(*) FROM vectors WHERE type = 'note') AS note_vectors, (SELECT count(*) FROM vectors WHERE type = 'block') AS block_vectors,
 (SELECT count(DISTINCT n.path) {_FAN} WHERE {_STALE}) AS outdated_files, {_ORPHANS}""",
    )
)
def db_stats(spark, d):
    return M.db_stats(*_model(spark, d))


# --- streaming -------------------------------------------------------------------------------------


def _editor(spark, d) -> DataFrame:
    e = fx.table(spark, d, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("context"))


_GAP = 600


@register(
    sql(
        "events_s",
        f""", o AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {_GAP}000000 AS gap FROM ev),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM o),
f AS (SELECT user_id, n, max(us) + {_GAP}000000 AS fire_us, arg_max(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, (us, event_id)) AS context, count(*) AS n_events FROM s GROUP BY user_id, n)
SELECT user_id, fire_us::BIGINT AS fire_us, context, n_events FROM f WHERE context <> ''""",
    )
)
def debounce_fires(spark, d):
    fires = R.debounce(_editor(spark, d), f"{_GAP} seconds", keys=["user_id"])
    return fires.select("user_id", F.unix_micros("fire_ts").alias("fire_us"), "context", "n_events")


@register(
    sql(
        "events_s",
        """, p AS (SELECT user_id, us, event_id, us + CASE WHEN event_id % 2 = 0 THEN 86400000000 ELSE 3600000000 END AS upto FROM ev WHERE event_type = 'purchase')
SELECT e.event_id, coalesce(e.us < p.upto, false) AS suppressed FROM (SELECT * FROM ev WHERE event_type <> 'purchase') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.us >= p.us""",
    )
)
def suppressed_events(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    calls = e.where("event_type = 'purchase'").select("event_id", "ts", "user_id", F.when(F.col("event_id") % 2 == 0, 86400000).otherwise(3600000).alias("ms"))
    return R.suppress(e.where("event_type <> 'purchase'"), calls, keys=["user_id"]).select("event_id", "suppressed")


_OPS = """ops AS (SELECT event_id, epoch_us(ts) AS us, user_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'delete' ELSE 'modify' END AS op FROM events)"""


@register(f"WITH {_OPS} SELECT 'u' || user_id || '.md' AS path, arg_max(op, (us, event_id)) AS op, arg_max(event_id, (us, event_id)) AS event_id FROM ops GROUP BY user_id")
def cdc_last_event(spark, d):
    return C.last_events(_file_events(spark, d)).select("path", "op", "event_id")


def _file_events(spark, d) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "rename").when(F.col("event_type") == "error", "delete").otherwise("modify")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".md"))
    new = F.when(op == "rename", F.concat(F.lit("new-u"), F.col("user_id").cast("string"), F.lit(".md")))
    return fx.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), path.alias("path"), op.alias("op"), new.alias("new_path"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"))


def _stored_files(spark, d) -> DataFrame:
    had = fx.table(spark, d, "events").where("user_id % 2 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".md")).alias("path")).distinct()
    at = F.timestamp_seconds(F.lit(fx.START))
    return had.select(F.sha2("path", 256).alias("id"), at.alias("created_at"), at.alias("updated_at"), "path", F.col("path").alias("name"), F.col("path").alias("base_name"), F.lit("old").alias("text"))


#: What an event finds at its path is what the user's event before it left there.
_FOUND = f"""{_OPS}, l AS (SELECT *, lag(op) OVER w AS before, lag(event_id) OVER w AS before_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS back FROM ops WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
r AS (SELECT user_id, arg_max(struct_pack(before, before_id, event_id), (us, event_id)) AS x FROM l WHERE op = 'rename' GROUP BY user_id)"""


@register(
    f"""WITH {_FOUND}
SELECT 'u' || user_id || '.md' AS path, 'text ' || event_id AS text FROM l WHERE back = 1 AND op IN ('create', 'modify')
UNION ALL SELECT 'new-u' || user_id || '.md', CASE WHEN x.before IN ('create', 'modify') THEN 'text ' || x.before_id WHEN x.before IS NULL AND user_id % 2 = 0 THEN 'old' ELSE 'text ' || x.event_id END FROM r"""
)
def cdc_apply(spark, d):
    return C.apply_events(_stored_files(spark, d), _file_events(spark, d), F.timestamp_seconds(F.lit(fx.START))).select("path", "text")


_CHAIN = "WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events), s AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS moves, 'old' AS text FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT o.user_id, o.i, s.moves + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, CASE WHEN event_type = 'purchase' THEN s.text ELSE 'text ' || o.event_id END FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1) SELECT 'u' || user_id || '-' || max(moves) || '.md' AS path, arg_max(text, i) AS text FROM s GROUP BY user_id"


@register(_CHAIN)
def cdc_modify_rename(spark, d):
    """A file edited and renamed again and again: edits keep their place between the renames, and all follow the file."""
    from pyspark.sql import Window

    e = fx.table(spark, d, "events").withColumn("op", F.when(F.col("event_type") == "purchase", "rename").otherwise("modify"))
    renamed = (F.col("op") == "rename").cast("int")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("n", F.sum(renamed).over(w))

    def path(moves: Column) -> Column:
        return F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), moves.cast("string"), F.lit(".md"))

    events = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), path(F.col("n") - renamed).alias("path"), "op", F.when(F.col("op") == "rename", path(F.col("n"))).alias("new_path"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"))
    at = F.timestamp_seconds(F.lit(fx.START))
    first = e.select("user_id").distinct().select(path(F.lit(0)).alias("path"))
    notes = first.select(F.sha2("path", 256).alias("id"), at.alias("created_at"), at.alias("updated_at"), "path", F.col("path").alias("name"), F.col("path").alias("base_name"), F.lit("old").alias("text"))
    return C.apply_events(notes, events, at).select("path", "text")


# --- embedding and settings ------------------------------------------------------------------------


@register("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents")
def embed_batches_fixed(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return fx.table(spark, d, "documents").select("doc_id", E.fixed_batch(n).alias("batch"))


@register(
    """WITH RECURSIVE o AS (SELECT source, doc_id, ceil(length(text) / 4::DOUBLE)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
b AS (SELECT source, doc_id, i, n AS total, 0::BIGINT AS batch FROM o WHERE i = 1 UNION ALL
SELECT o.source, o.doc_id, o.i, CASE WHEN b.total + o.n <= 7500 THEN b.total + o.n ELSE o.n END, CASE WHEN b.total + o.n <= 7500 THEN b.batch ELSE b.batch + 1 END FROM b JOIN o ON o.source = b.source AND o.i = b.i + 1)
SELECT doc_id, batch FROM b"""
)
def embed_batches_greedy(spark, d):
    t = fx.table(spark, d, "documents").select("source", "doc_id", F.ceil(F.length("text") / F.lit(4)).cast("bigint").alias("n"))
    return E.greedy_batch_numbers(t, "source", "doc_id", "n").select("doc_id", "batch")


@register("SELECT * FROM (VALUES ('bge-m3', 1024::BIGINT), ('text-embedding-3-small', 1536), ('text-embedding-3-large', 3072), ('other', 768)) t(model, dims)")
def model_dims(spark, d):
    return spark.createDataFrame([(m, model_dimensions(m)) for m in (*MODEL_DIMENSIONS, "other")], "model string, dims bigint")


@register("SELECT * FROM (VALUES ('provider', true), ('model', true), ('vector_size', true), ('chunk_size', true), ('chunk_overlap', true), ('search_cadence', false), ('search_mode', false), ('log_level', false)) t(changed, reindex)")
def settings_reindex(spark, d):
    base = Settings()
    changes = {"provider": "openai", "model": "bge-m3", "vector_size": 1024, "chunk_size": 64, "chunk_overlap": 8, "search_cadence": "always", "search_mode": "vector", "log_level": "DEBUG"}
    return spark.createDataFrame([(k, requires_reindex(base, Settings.parse({k: v}))) for k, v in changes.items()], "changed string, reindex boolean")
