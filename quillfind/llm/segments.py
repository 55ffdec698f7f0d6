"""Segments: bounded packs of whole documents, a row each, written once and read by several passes.

A segment's number is kept in the table, so every pass over it agrees on what it holds even after
tasks are run again. Texts are compressed together, which costs about a third of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

SEGMENT_BYTES, SEGMENT_DOCS = 8 << 20, 50_000
SCHEMA = "seg bigint, doc_ids array<bigint>, sizes array<int>, n_bytes bigint, pack binary"


def zip_bytes(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def unzip(data: bytes, size: int) -> bytes:
    return pa.decompress(bytes(data), size, codec="zstd", asbytes=True) if size else b""


def _pack(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 24
        ids: list = []
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            row = (seg, ids, [len(x) for x in held], size, zip_bytes(b"".join(held)))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["seg", "doc_ids", "sizes", "n_bytes", "pack"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(doc_id)
                held.append(text.as_py())
                size += len(held[-1])
                if size >= most or len(ids) >= SEGMENT_DOCS:
                    yield out()
                    seg, ids, held, size = seg + 1, [], [], 0
        if ids:
            yield out()

    return run


def pack(documents: DataFrame, most: int = SEGMENT_BYTES) -> DataFrame:
    """The table of segments. A segment closes at most bytes; one longer text is a segment of its own size."""
    return materialize(texts(documents).mapInArrow(_pack(most), SCHEMA), "segments", "none")


def with_rows(packed: DataFrame, rows: DataFrame, column: str, few: bool = False) -> DataFrame:
    """packed with the list of each segment's values of column, none if it has none.

    few: the rows are known to be so few that they go to every worker, and the segments stay where they are.
    """
    listed = rows.groupBy("seg").agg(F.collect_list(column).alias(column))
    return packed.join(F.broadcast(listed) if few else listed, "seg", "left")


def unpack(sizes: np.ndarray, n_bytes: int, data: bytes) -> Iterator[bytes]:
    whole, at = unzip(data, int(n_bytes)), 0
    for n in sizes:
        yield whole[at : at + n]
        at += int(n)
