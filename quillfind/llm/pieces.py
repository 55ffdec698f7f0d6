"""SentencePiece encoding and decoding by a table of distinct chunks.

The model's pieces hold the white space marker at their start only (checked when it is loaded), so no
piece crosses from a word into the next marker: a text is cut before each run of markers, every
distinct marked word of a batch is segmented once, and ids are joined back by position. Decoding uses
the same table: each chunk's ids are decoded once by the library and joined by position.

Scale: no exchange at all; each task keeps a bounded table, and a batch is bounded in bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_tables import ChunkTable
from .common import freeing, kept_by, read_table

MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")


@lru_cache(maxsize=2)
def chunk_codec(model: str) -> ChunkCodec:
    """One for each worker process: its table serves all of the process's tasks."""
    return ChunkCodec(model)


kept_by("pieces", chunk_codec)


class ChunkCodec:
    """encode and decode of whole texts, equal to the library's without begin and end ids."""

    def __init__(self, model: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=model)
        crossing = [p for p in map(self.sp.id_to_piece, range(self.sp.get_piece_size())) if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross white space markers: {crossing[:3]}")
        self.table = ChunkTable(self._segment, 200_000)

    def _segment(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """Of each chunk, which starts with a marker: number of ids, ids as decimals, decoded text with its marker."""
        ids = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        # An empty rest has no ids of its own, and the library adds its marker to none: the marker alone.
        ids = [x or [self.sp.piece_to_id(MARK)] for x in ids]
        return [(len(x), ",".join(map(str, x)), " " + y) for x, y in zip(ids, self.sp.decode(ids))]

    @staticmethod
    def chunks(text: str) -> list[str]:
        return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []

    def run(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of ids, ids as decimals joined by commas, decoded text."""
        split = [self.chunks(t) for t in texts]
        known = self.table.load(set().union(*split))
        for chunks in split:
            found = [known[c] for c in chunks]
            yield sum([f[0] for f in found]), ",".join([f[1] for f in found]), "".join([f[2] for f in found])[1:]

    def encode(self, text: str) -> list[int]:
        ids = next(self.run([text]))[1]
        return [int(x) for x in ids.split(",")] if ids else []


def _code(model: str, digest: bool, most: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunk_codec(model)

        def out(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
            n, ids, decoded = zip(*codec.run(texts))
            if digest:
                cols = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in col]) for col in (ids, decoded)]
            else:
                cols = [pa.array([[int(i) for i in x.split(",")] if x else [] for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), *cols], names=["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])])

        for b in batches:
            doc_ids, held, size, first = b.column(0).to_pylist(), [], 0, 0
            for i, x in enumerate(b.column(1)):
                held.append(x.as_py() or "")
                size += len(held[-1])
                if size >= most:
                    yield out(doc_ids[first : i + 1], held)
                    held, size, first = [], 0, i + 1
            if held:
                yield out(doc_ids[first:], held)

    return run


def encode_pieces(documents: DataFrame, model: str, digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, and ids and decoded, or with digest their SHA-256.

    Null and empty texts have no ids and decode to an empty text. Every row is kept, repeated and
    null ids too; other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return rows.mapInArrow(freeing(_code(model, digest), "pieces"), f"doc_id bigint, n_tokens bigint, {kind}")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode_pieces(read_table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"), digest=True)
