"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A
shared window is WINDOW consecutive words. Both sides keep the least hash of each WINDOW - GRAM + 1
consecutive GRAM-word grams, so any shared window holds a gram that both kept; kept grams of the
documents are joined with those of the benchmark and each hit is extended over equal words as far as
it goes. Every shared window is thus found, and words decide, not hashes.

Scale: documents are scanned once for each block of the benchmark, with no exchange. The benchmark's
size is checked first: blocks of at most BLOCK_BYTES are broadcast one by one, however large it is.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, freeing, materialize, mix64, read_table, release, shingles, texts, utf8

WINDOW, GRAM = 8, 5
BLOCK_BYTES = 32 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the last least hash in each run of width grams."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    n = len(grams) - width + 1
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, width):
        other = grams[i : i + n]
        less = other <= best
        best[less] = other[less]
        at[less] = i
    return np.unique(at + np.arange(n))


class BenchmarkIndex:
    """Kept grams and whole word sequences of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram, self.vocabulary = window, gram, {}
        self.items: list[tuple[str | None, list[int]]] = []
        self.short: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        fingers: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if not ids:
                continue
            k = len(self.items)
            self.items.append((name, ids))
            if len(ids) < window:
                self.short[len(ids)][tuple(ids)].append(k)
                continue
            grams = self.grams(np.array(ids, np.int64))
            for at in winnow(grams, window - gram + 1).tolist():
                fingers[int(grams[at])].append((k, at))
        self.fingers = dict(fingers)
        self.keys = np.sort(np.fromiter(self.fingers, np.uint64, len(self.fingers)))
        self.short = {m: dict(d) for m, d in self.short.items()}
        self.short_keys = {m: np.sort(shingles(mix64(np.array(list(d), np.int64).astype(np.uint64) + np.uint64(1)).ravel(), m)[::m]) for m, d in self.short.items()}

    def grams(self, ids: np.ndarray) -> np.ndarray:
        return shingles(mix64(ids.astype(np.uint64) + np.uint64(1)), self.gram)

    @staticmethod
    def _found(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(x):
            return np.zeros(len(x), bool)
        return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x

    def hits(self, texts_: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """Per text: number of words, disjoint hit spans of words, places of items with an occurring window."""
        get, split = self.vocabulary.get, [words(t) for t in texts_]
        ids: list[int] = []
        starts = []
        for w in split:
            starts.append(len(ids))
            ids += [get(x, -1) for x in w]
            ids.append(-2)  # nothing matches across texts
        a = np.array(ids, np.int64)
        grams = self.grams(a)
        kept = winnow(grams, self.window - self.gram + 1)
        kept = kept[self._found(self.keys, grams[kept])]
        spans: dict[int, list] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        covered: dict[tuple[int, int], int] = {}
        docs = np.searchsorted(starts, kept, side="right") - 1
        for p, d in zip(kept.tolist(), docs.tolist()):
            for k, q in self.fingers[int(grams[p])]:
                if covered.get((k, p - q), -1) >= p + self.gram:
                    continue
                seq = self.items[k][1]
                lo, hi, j = p, p, q
                while lo > 0 and q - (p - lo) > 0 and ids[lo - 1] == seq[q - (p - lo) - 1]:
                    lo -= 1
                while j < len(seq) and ids[hi] == seq[j]:
                    hi, j = hi + 1, j + 1
                covered[k, p - q] = hi
                if hi - lo >= self.window:
                    spans[d].append((lo - starts[d], hi - starts[d]))
                    items[d].add(k)
        for m, known in self.short.items():
            for p in np.flatnonzero(self._found(self.short_keys[m], shingles(mix64(a.astype(np.uint64) + np.uint64(1)), m))).tolist():
                found = known.get(tuple(ids[p : p + m]))
                if found:
                    d = int(np.searchsorted(starts, p, side="right")) - 1
                    spans[d].append((p - starts[d], p + m - starts[d]))
                    items[d].update(found)
        for d, w in enumerate(split):
            yield len(w), union(spans.get(d, [])), items.get(d, set())


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order, touching ones joined."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8().alias("text"))


def n_blocks(benchmark: DataFrame, most: int) -> int:
    """How many blocks keep each at about most bytes: the benchmark's size, measured."""
    total = _items(benchmark).agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    return -(-2 * total // most) if total > most else 1


def blocks(benchmark: DataFrame, n: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in n blocks, each small enough to hold in the driver; an item is never cut."""
    rows = _items(benchmark)
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield [(r[0], bytes(r[1])) for r in (rows.where(dealt == b) if n > 1 else rows).orderBy("item_id", "text").collect()]


_HITS_SQL = "doc_id bigint, text_key binary, n_words bigint, spans array<struct<lo:bigint,hi:bigint>>, items array<string>"
_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _scan(shared, most: int = 4 << 20, keyed: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: BenchmarkIndex = pickle.loads(zlib.decompress(shared.value))

        def out(doc_ids: list, held: list[bytes]) -> pa.RecordBatch:
            n, spans, items = [], [], []
            for k, s, i in index.hits(held):
                n.append(k)
                spans.append([{"lo": lo, "hi": hi} for lo, hi in s])
                items.append(sorted({index.items[x][0] for x in i} - {None}))
            keys = [hashlib.sha256(t).digest() if keyed else None for t in held]
            cols = [pa.array(doc_ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "n_words", "spans", "items"])

        for b in batches:
            doc_ids, held, size, first = b.column(0).to_pylist(), [], 0, 0
            for i, x in enumerate(b.column(1)):
                held.append(x.as_py() or b"")
                size += len(held[-1])
                if size >= most:
                    yield out(doc_ids[first : i + 1], held)
                    held, size, first = [], 0, i + 1
            if held:
                yield out(doc_ids[first:], held)

    return run


def _hit_column(shared, text: str | Column) -> Column:
    """Number of words that windows of one block of items cover, as a column."""

    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index: BenchmarkIndex = pickle.loads(zlib.decompress(shared.value))
        for c in columns:
            yield pa.array([sum(hi - lo for lo, hi in spans) for held in bounded(c) for _, spans, _ in index.hits(held)], pa.int64())

    @F.arrow_udf("bigint")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from freeing(count)(columns)

    return run(utf8(text))


def _share(spark: SparkSession, items: list[tuple[str | None, bytes]]):
    return spark.sparkContext.broadcast(zlib.compress(pickle.dumps(BenchmarkIndex(items)), 1))


def clean_rows(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents, whole, in which no window of any benchmark item occurs.

    Null and empty texts are clean, as is all with an empty benchmark; repeated rows are judged each.
    Nothing is joined: a row is judged where it is. One block after another is broadcast and let go.
    """
    spark, parts = documents.sparkSession, n_blocks(benchmark, block_bytes)
    for i, items in enumerate(blocks(benchmark, parts)):
        shared = _share(spark, items)
        later = documents.where(_hit_column(shared, "text") == 0)
        if parts > 1:
            later = materialize(later, "clean")
            shared.destroy()
            if i:
                release(documents)
        documents = later
    return documents


def contamination(documents: DataFrame, benchmark: DataFrame, min_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, spans, contaminated.

    Null and empty texts have no words; items without words match nothing; an item of fewer than
    WINDOW words is one window. An item whose item_id is null marks words but is not counted or named.
    Repeated rows are each kept. An empty benchmark leaves every document clean; an empty table of
    documents gives no rows. Other columns are ignored.
    """
    spark, rows, n = documents.sparkSession, texts(documents), n_blocks(benchmark, block_bytes)
    found, end = None, F.lit(0).cast("bigint")
    for items in blocks(benchmark, n):
        shared = _share(spark, items)
        one = rows.mapInArrow(freeing(_scan(shared, keyed=n > 1)), _HITS_SQL)
        if n > 1:  # each block's hits are written, then joined by document
            one = materialize(one, "hits")
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    if n > 1:
        found = found.groupBy("doc_id", "text_key").agg(
            F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            (F.count(F.lit(1)) / n).cast("int").alias("copies"),
        )
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    # Spans are in order; those of several blocks may overlap.
    reach = F.aggregate(
        "spans",
        F.struct(end.alias("end"), end.alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["hi"]).alias("end"), (a["n"] + F.greatest(end, s["hi"] - F.greatest(a["end"], s["lo"]))).alias("n")),
    )
    return found.select("doc_id", "n_words", reach["n"].alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans", (F.size("items") >= min_items).alias("contaminated"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Windows of eight words by SQL. Items of fewer words are one window; text regexes as in the operator.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS m, array_to_string(list_slice(w, i, i + least(8, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 7))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM bw), dw AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)
), hit AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw USING (m, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(named.s, '')) AS items_sha256, coalesce(named.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
