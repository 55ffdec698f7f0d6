"""Exact dedup by deterministic block naming.

A text, with each run of ASCII white space made one space, is cut into blocks of BLOCK bytes. Equal
blocks are brought together by sorting and share an integer name; then equal pairs of adjacent names
do, level by level, until each text has a single name. A name is given to equal content only and is
the smallest reference of its sorted run, so identity is exact: no digest decides it.

Scale: each task first names blocks and pairs within a bounded segment of its rows, so a block, pair
or text reaches the shuffle once for each segment however many copies there are. That bounds hot
groups without dropping rows. The only text that moves is one copy of each block for each segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeing, materialize, named_texts, read_table

BLOCK = 4096
#: A segment is closed at so many bytes of distinct blocks or so many rows.
SEGMENT_BYTES, SEGMENT_ROWS = 48 << 20, 200_000
_SPACE = b" \t\n\x0b\x0c\r"

_NODES = pa.schema(
    [("level", pa.int32()), ("ref", pa.int64()), ("block", pa.binary()), ("lref", pa.int64()), ("rref", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("ids", "files", "places")), ("sha", pa.string())]
)
_NODES_SQL = "level int, ref bigint, block binary, lref bigint, rref bigint, ids array<bigint>, files array<bigint>, places array<bigint>, sha string"
#: Bits of a name: the partition has what these two leave of 63.
SEGMENT_BITS, INDEX_BITS = 18, 24


def _base(partition: int, segment: int) -> int:
    """The first name of a segment. Raises rather than take the names of another."""
    if segment >> SEGMENT_BITS or partition >> (63 - SEGMENT_BITS - INDEX_BITS):
        raise OverflowError(f"no names for segment {segment} of partition {partition}: use more partitions or larger segments")
    return (partition << SEGMENT_BITS | segment) << INDEX_BITS


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space, at both ends too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[:1] in _SPACE else b"") + b" ".join(words) + (b" " if text[-1:] in _SPACE else b"")


class _Segment:
    """Names of blocks and pairs within a bounded run of rows."""

    def __init__(self, base: int) -> None:
        self.base, self.bytes, self.rows = base, 0, 0
        self.levels: list[dict] = [{}]
        self.roots: dict[tuple[int, int], list] = {}

    def add(self, row: tuple, text: bytes, block: int) -> None:
        names = []
        for i in range(0, max(1, len(text)), block):
            part, known = text[i : i + block], self.levels[0]
            if part not in known:
                self.bytes += len(part) + 100
                known[part] = len(known)
            names.append(known[part])
        level = 0
        while len(names) > 1:
            level += 1
            if level == len(self.levels):
                self.levels.append({})
            known = self.levels[level]
            names = [known.setdefault((a, b), len(known)) for a, b in zip(names[::2], [*names[1::2], -1])]
        root = (level, names[0])
        if root not in self.roots:
            self.roots[root] = [[], hashlib.sha256(text).hexdigest()]
        self.roots[root][0].append(row)
        self.rows += 1

    def rows_out(self) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in _NODES]
        held = 0
        for level, known in enumerate(self.levels):
            if len(known) >> INDEX_BITS:
                raise OverflowError("too many blocks in a segment: use smaller ones")
            for key, i in known.items():
                block, left, right = (key, None, None) if level == 0 else (None, self.base + key[0], self.base + key[1] if key[1] >= 0 else None)
                rows, sha = self.roots.get((level, i), (None, None))
                for c, v in zip(cols, (level, self.base + i, block, left, right, *(map(list, zip(*rows)) if rows else (None, None, None)), sha)):
                    c.append(v)
                held += len(block or b"") + 24 * len(rows or ()) + 100
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NODES)], schema=_NODES)
                    cols, held = [[] for _ in _NODES], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NODES)], schema=_NODES)


def _local_names(block: int, segment_bytes: int, segment_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, n = TaskContext.get().partitionId(), 0
        seg = _Segment(_base(partition, n))
        for b in batches:
            for *row, text in zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), b.column(1)):
                seg.add(tuple(row), normalise(text.as_py()), block)
                if seg.bytes >= segment_bytes or seg.rows >= segment_rows:
                    yield from seg.rows_out()
                    n += 1
                    seg = _Segment(_base(partition, n))
        yield from seg.rows_out()

    return run


def exact_groups(documents: DataFrame, block: int = BLOCK, segment_bytes: int = SEGMENT_BYTES, segment_rows: int = SEGMENT_ROWS, row: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; with row, also the file and place that name it.

    Null and empty texts are one group. A null doc_id ranks after every other id; of rows that repeat
    one doc_id and text, one is kept. Other columns of documents are ignored, whatever their names.
    An empty table gives an empty result.
    """
    nodes = materialize(named_texts(documents, row).mapInArrow(freeing(_local_names(block, segment_bytes, segment_rows)), _NODES_SQL), "blocks")
    depth = nodes.agg(F.max("level")).head()[0] or 0
    first = F.min("ref")
    names = [materialize(nodes.where("level = 0").select("ref", first.over(Window.partitionBy("block")).alias("name")), "names")]
    for level in range(1, depth + 1):
        left = names[-1].select(F.col("ref").alias("lref"), F.col("name").alias("lname"))
        right = names[-1].select(F.col("ref").alias("rref"), F.col("name").alias("rname"))
        pairs = nodes.where(F.col("level") == level).select("ref", "lref", "rref").join(left, "lref").join(right, "rref", "left")
        names.append(materialize(pairs.select("ref", first.over(Window.partitionBy("lname", F.coalesce("rname", F.lit(-1)))).alias("name")), "names"))
    named = None
    for level, t in enumerate(names):
        t = t.select(F.lit(level).alias("level"), "ref", "name")
        named = t if named is None else named.unionByName(t)
    roots = nodes.where(F.col("ids").isNotNull()).select("level", "ref", "ids", "files", "places", "sha").join(named, ["level", "ref"])
    same = Window.partitionBy("level", "name")
    least = F.struct(F.array_min("ids").isNull().alias("none"), F.array_min("ids").alias("id"), F.col("ref"))
    out = roots.select("ref", "ids", "files", "places", "sha", F.min(least).over(same).alias("best"), F.sum(F.size("ids").cast("bigint")).over(same).alias("group_size"))
    out = out.withColumn("at", F.when(F.col("best.ref") == F.col("ref"), F.coalesce(F.array_position("ids", F.col("best.id")), F.lit(1))))
    out = out.select("*", F.posexplode(F.arrays_zip("ids", "files", "places")).alias("pos", "row"))
    out = out.select(
        F.col("row.ids").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        "group_size",
        F.coalesce(F.col("at") == F.col("pos") + 1, F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *([F.col("row.files").alias("file"), F.col("row.places").alias("place")] if row else []),
    )
    out._quillfind_tables = [nodes, *names]
    return out


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
