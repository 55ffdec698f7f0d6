"""Token-id output: shards of concatenated ids with Elias-Fano coded document boundaries.

A shard holds a run of documents in ascending doc_id order: one array of ids (16 bits each when the
vocabulary allows, else 32) and the boundaries between documents as an Elias-Fano sequence - low bits
packed, high bits in unary, and the place of every 256th one kept, so that select(i) finds the start
of document i without a table of 64-bit offsets. A file is a folder of Parquet parts with a row a
shard, so writing and reading go through Spark's own committer and any store it knows.

Scale: one range exchange of texts on doc_id; encoding follows it, so a sample of keys does not encode
anything. A shard is bounded in bytes, and the driver sees one number for each partition.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_tables import ChunkTable
from .common import freeing, kept_by, read_table, table_path, texts

SHARD_TOKENS, SHARD_DOCS, SAMPLE = 2 << 20, 100_000, 256
_MAGIC = b"QFEF"


class EliasFano:
    """A non-decreasing sequence of n values up to top, in about n * (2 + log2(top / n)) bits."""

    def __init__(self, n: int, top: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.top, self.low, self.high, self.samples = n, top, low, high, samples
        self.width = self.bits(n, top)

    @staticmethod
    def bits(n: int, top: int) -> int:
        return max(0, int(top // max(n, 1)).bit_length() - 1)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        w = cls.bits(n, top)
        low = np.packbits(((v[:, None] >> np.arange(w)) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> w) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, top, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i, from the nearest kept place on."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        bits = np.unpackbits(self.high[byte : byte + 8 + (left * 4) // 8], bitorder="little")
        ones = np.flatnonzero(bits[at % 8 :])
        if len(ones) <= left:
            ones = np.flatnonzero(np.unpackbits(self.high[byte:], bitorder="little")[at % 8 :])
        high = at + int(ones[left]) - i
        if not self.width:
            return high
        first = i * self.width
        part = np.unpackbits(self.low[first // 8 : (first + self.width + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.width]
        return (high << self.width) | int((part.astype(np.int64) << np.arange(self.width)).sum())

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.int64)
        return ((ones - np.arange(self.n)) << self.width) | (low << np.arange(self.width)).sum(axis=1)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.top, len(self.low), len(self.high), len(self.samples)], "<u8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[EliasFano, int]:
        """The sequence and the number of bytes that it took."""
        n, top, a, b, c = (int(x) for x in np.frombuffer(data, "<u8", 5))
        at = 40
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, "<u4", c, at + a + b)
        return cls(n, top, low, high, samples), at + a + b + 4 * c


def pack_shard(ids: list[bytes], width: int) -> bytes:
    """ids: for each document its ids, each of width bytes."""
    ends = np.cumsum([0, *(len(x) // width for x in ids)])
    return _MAGIC + bytes([width]) + EliasFano.of(ends).to_bytes() + b"".join(ids)


def open_shard(blob: bytes) -> tuple[EliasFano, np.ndarray]:
    if blob[:4] != _MAGIC:
        raise ValueError("not a token shard")
    width = blob[4]
    bounds, used = EliasFano.from_bytes(memoryview(blob)[5:])
    return bounds, np.frombuffer(blob, f"<u{width}", offset=5 + used)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process: its tables serve all of the process's tasks."""
    return WordTokenizer(path)


kept_by("tokens", word_tokenizer)


class WordTokenizer:
    """Ids of a text with a tokenizer that never joins across ASCII white space and drops it."""

    #: After a plain letter the tokenizer starts anew at these marks, so words are cut there.
    _CUT = re.compile(rb"(?<=[a-z])(?=[.,!?*#$%&;:|])")

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.words = ChunkTable(self._encode, 400_000, 40)

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        kind = f"<u{self.width}"
        return [np.array(e.ids, kind).tobytes() for e in batch([p.decode() for p in parts], add_special_tokens=False)]

    def split(self, text: bytes) -> list[bytes]:
        """Words that are encoded by themselves. A text that may hold special tokens keeps its case: it matters to them."""
        return text.split() if b"<|" in text else self._CUT.sub(b" ", text.lower()).split()

    def ids(self, texts_: list[bytes]) -> list[bytes]:
        split = [self.split(t) for t in texts_]
        known = self.words.load(set().union(*split))
        return [b"".join(map(known.__getitem__, words)) for words in split]


def _batches(col: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Rows in runs of about most bytes: (first row, values)."""
    held, size, first = [], 0, 0
    for i, x in enumerate(col):
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


_SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("shard", pa.binary())])
_SHARDS_SQL = "part int, seq int, before bigint, n_docs bigint, n_tokens bigint, doc_ids array<bigint>, shard binary"


def _encode_part(tokenizer: str, end_id: int, shard_tokens: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer)
        end = int(end_id).to_bytes(tok.width, "little")
        part, seq, before, tokens = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def shard() -> pa.RecordBatch:
            row = (part, seq, before, len(ids), tokens, names, pack_shard(ids, tok.width))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SHARDS)], schema=_SHARDS)

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for first, rows in _batches(b.column(1)):
                for i, x in enumerate(tok.ids(rows), first):
                    ids.append(x + end)
                    names.append(doc_ids[i])
                    tokens += len(ids[-1]) // tok.width
                    if tokens >= shard_tokens or len(ids) >= shard_docs:
                        yield shard()
                        before, seq, tokens, ids, names = before + tokens, seq + 1, 0, [], []
        if ids:
            yield shard()

    return run


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS) -> None:
    """Encode whole texts and write the shards to path, in ascending doc_id order (null ids first, ties by text)."""
    ordered = texts(documents).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(freeing(_encode_part(tokenizer, end_id, shard_tokens, shard_docs), "tokens"), _SHARDS_SQL).write.option("compression", "zstd").parquet(path)


def _open_part(base: dict[int, int]):
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, doc_ids, shard in zip(*(b.column(c).to_pylist() for c in ("part", "before", "doc_ids", "shard"))):
                bounds, ids = open_shard(shard)
                at = bounds.all()
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[lo:hi]) for lo, hi in zip(at.tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at[:-1] + (base[part] + before)), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=out)

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the file: doc_id, start, n_tokens, ids_crc32 (of its ids as 32-bit integers)."""
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each range partition
    base, total = {}, 0
    for part, n in sorted(map(tuple, totals)):
        base[part], total = total, total + n
    return shards.select("part", "before", "doc_ids", "shard").mapInArrow(_open_part(base), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op1_token_file(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = table_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)
