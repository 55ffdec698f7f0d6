"""What the operators share: the shared folder, written tables, keyed streams, hashes."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfind.sources.scratch import shared_dir


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that materialize() wrote."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_late(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans it
        pass


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/quillfind/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_late, spark, path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillfind_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if getattr(t, "_quillfind_path", None):
            remove(t.sparkSession, t._quillfind_path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | Column = "text") -> Column:
    """The UTF-8 bytes of a whole text; null is empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def texts(df: DataFrame) -> DataFrame:
    """(doc_id bigint, text binary): the UTF-8 bytes of whole texts; null is empty."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text"))


def named_texts(df: DataFrame, row: tuple[str, str] | None) -> DataFrame:
    """texts() with file and place, both bigint: of row, the columns that name each row (see with_row_names), or null."""
    file, place = (F.col(c) for c in row) if row else (F.lit(None), F.lit(None))
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8().alias("text"), file.cast("bigint").alias("file"), place.cast("bigint").alias("place"))


def with_row_names(df: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """df with two columns that name each row, the hash of its file's path and its place there, and their names.

    They stay the same however often tasks are run again. A table that is not read from files is written first.
    """
    try:
        meta = df.metadataColumn("_metadata")
        df.select(meta["row_index"]).schema
    except AnalysisException:
        df = materialize(df, "rows")
        meta = df.metadataColumn("_metadata")
    names = tuple(fresh_name(df, c) for c in ("file", "place"))
    return df.select("*", F.xxhash64(meta["file_path"]).alias(names[0]), meta["row_index"].alias(names[1])), names


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with strokes added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bounded(column: pa.Array, most: int = 4 << 20) -> Iterator[list[bytes]]:
    """The values of a binary column in lists of about most bytes."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py() or b"")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def trim() -> None:
    """Give memory that a worker process no longer uses back to the system; workers live for many tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


#: What worker processes keep from task to task, by owner: functions that let it go.
_KEPT: dict[str, Callable[[], None]] = {}


def kept_by(owner: str, cached):
    """Register an lru_cache that tasks of one owner keep for the next; tasks of others clear it."""
    _KEPT[owner] = cached.cache_clear
    return cached


def _let_go(owner: str) -> None:
    for other, clear in _KEPT.items():
        if other != owner:
            clear()


def freeing(run: Callable, owner: str = "") -> Callable:
    """run, a function of batches, that lets go what other owners keep before, and unused memory after.

    An owner's own tasks do not look for unused memory: what they hold is kept on purpose, and large.
    """

    def wrapped(batches: Iterator) -> Iterator:
        _let_go(owner)
        try:
            yield from run(batches)
        finally:
            if not owner:
                trim()

    return wrapped


def keyed_stream(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    each: Callable[[tuple, pd.DataFrame], Iterator[pd.DataFrame] | list],
    schema: str,
    partitions: int | None = None,
) -> DataFrame:
    """Call each(key, rows) for every key, in a stream over sorted partitions.

    Cheaper than one Arrow group for each key when groups are many and small. A group is held
    whole in one task, so the caller must have bounded it.
    """
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last: tuple | None = None
        for b in batches:
            if not len(b):
                continue
            cols = [b[k].to_numpy() for k in keys]
            new = np.zeros(len(b), dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(c[lo] for c in cols)
                if last is not None and key != last:
                    yield from each(last, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))
                    held = []
                last = key
                held.append(b.iloc[lo:hi])
        if last is not None:
            yield from each(last, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(freeing(run), schema)


#: The multipliers of the public SplitMix64 finaliser and of Fibonacci hashing.
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """bytes -> 64-bit hash, kept for frequent words; cleared when it holds limit words."""

    def __init__(self, limit: int = 300_000) -> None:
        super().__init__()
        import xxhash

        self._of, self._limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        h = self[bytes(word)] = self._of(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive entries (in order, not distinct)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= GOLDEN
        out ^= out >> np.uint64(29)
        out += hashes[i : i + n]
    return mix64(out)


def lower_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are the maximal runs without ASCII white space."""
    return text.lower().split()
