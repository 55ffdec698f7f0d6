"""The data model: tables, small structs and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

POSITION = T.StructType([T.StructField(c, T.IntegerType()) for c in ("line", "col", "offset")])
SECTION = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", POSITION), T.StructField("end", POSITION)])


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, k) for c, k in columns.items()])


_S, _TS, _I, _L = T.StringType(), T.TimestampType(), T.IntegerType(), T.LongType()

TABLES: dict[str, T.StructType] = {
    "notes": _table(id=_S, created_at=_TS, updated_at=_TS, path=_S, name=_S, base_name=_S, text=_S),
    "chunks": _table(id=_S, note_id=_S, created_at=_TS, updated_at=_TS, chunk_index=_I, text=_S),
    "vectors": _table(id=_S, note_id=_S, chunk_id=_S, block_id=_S, type=_S, created_at=_TS, updated_at=_TS, vector=T.ArrayType(T.ByteType())),
    "blocks": _table(id=_S, note_id=_S, created_at=_TS, updated_at=_TS, ordinal=_I, type=_S, content=_S, anchor_id=_S, start_position=POSITION, end_position=POSITION),
    "fts_content": _table(docid=_L, id=_S, type=_S, note_id=_S, content=_S, note_path=_S, note_name=_S, block_id=_S),
    "lsh_configs": _table(id=_S, created_at=_TS, vector_count=_L, vector_dimensions=_I, num_hash_functions=_I),
    "lsh_hash_functions": _table(id=_S, config_id=_S, hash_index=_I, created_at=_TS, projection=T.ArrayType(T.DoubleType())),
    "lsh_buckets": _table(id=_S, config_id=_S, bucket_hash=_S, vector_id=_S, note_id=_S, created_at=_TS),
    "fts_postings": _table(term=_S, column=_S, docid=_L, note_id=_S, positions=T.ArrayType(_I)),
}

#: By which column a table's rows belong to a note; id where none is named.
NOTE_KEYS = {"chunks": "note_id", "vectors": "note_id", "blocks": "note_id", "fts_content": "note_id", "lsh_buckets": "note_id", "fts_postings": "note_id"}

#: Kinds of blocks and vectors, and the kinds of blocks that get a vector.
BLOCK_TYPES = ("paragraph", "heading", "list", "blockquote", "code", "table", "thematicBreak", "linkReference", "definition", "yaml", "math", "callout", "embed", "footnote")
VECTOR_TYPES = ("note", "chunk", "block")
EMBEDDED_BLOCKS = ("paragraph", "heading", "list", "blockquote")
#: A note whose trimmed text is shorter gets no vector.
MIN_NOTE_CHARS = 16
