"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and of their character n-grams, hashed into
BUCKETS rows; a softmax layer gives the label. Both are trained by stochastic gradient descent in
numpy on the driver (an immediate repeat of a word is one more word of its own kind), on at most train_rows labelled documents with their whole texts (a documented
bound: the rows with the least hash of doc_id). Scoring reads every whole text.

Scale: the output is linear in the words, so the workers get one number for each bucket (BUCKETS * 4
bytes, whatever the input) and keep a bounded table of words. Scoring has no exchange.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_tables import ChunkTable
from .common import bounded, freeing, materialize, mix64, read_table, release, texts, utf8

BUCKETS, DIM, NGRAMS = 1 << 18, 10, (2, 3, 4)
EPOCHS, RATE, TRAIN_ROWS, TRAIN_BYTES, SEED = 6, 0.5, 4000, 64 << 20, 7
#: The bucket of a word that repeats the one before it, and its weight: such a word counts once more as this marker.
AGAIN, AGAIN_WEIGHT = 1, 12
THRESHOLD = 0.7

_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, bucket) of every word and of each of its character n-grams."""
    chars = np.frombuffer("".join(["\x02" + w.decode("utf-8", "replace") + "\x03" for w in words]).encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero(chars == 2)
    # a word may hold these marks itself; then lengths decide
    sizes = np.array([len(w.decode("utf-8", "replace")) + 2 for w in words], np.int64)
    if len(starts) != len(words):
        starts = np.cumsum(sizes) - sizes
    word_of = np.repeat(np.arange(len(words)), sizes)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(7)) * _powers(_P, len(chars)), out=sums[1:])
    back = _powers(_PINV, len(chars))
    mask = np.uint64(BUCKETS - 1)
    whole = mix64((sums[starts + sizes] - sums[starts]) * back[starts] + np.uint64(1)) & mask
    at, found = [np.arange(len(words))], [whole]
    for n in NGRAMS:
        k = len(chars) - n + 1
        if k <= 0:
            continue
        inside = np.flatnonzero(word_of[:k] == word_of[n - 1 :])
        h = (sums[inside + n] - sums[inside]) * back[inside]
        at.append(word_of[inside])
        found.append(mix64(h * np.uint64(2) + np.uint64(n)) & mask)
    return np.concatenate(at), np.concatenate(found).astype(np.int64)


def repeats(words: list[bytes]) -> int:
    """Words equal to the one before."""
    return sum(map(operator.eq, words, words[1:]))


class Model:
    """Vectors of buckets and the softmax layer."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
        self.layer, self.bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)

    def fit(self, rows: list[tuple[bytes, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
        docs = []
        for text, label in rows:
            words = text.split()
            if words:
                counts = np.bincount(features(words)[1], minlength=BUCKETS)
                counts[AGAIN] += AGAIN_WEIGHT * repeats(words)
                ids = np.flatnonzero(counts)
                counts = counts[ids]
                docs.append((ids, (counts / counts.sum()).astype(np.float32), label))
            else:
                docs.append((np.empty(0, np.int64), np.empty(0, np.float32), label))
        rng, steps = np.random.default_rng(seed), epochs * max(1, len(docs))
        step = 0
        for _ in range(epochs):
            for k in rng.permutation(len(docs)):
                ids, weight, label = docs[k]
                now = rate * (1 - step / steps)
                step += 1
                v = weight @ self.vectors[ids]
                z = self.layer @ v + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1  # the gradient at the layer's output
                back = self.layer.T @ p
                self.layer -= now * np.outer(p, v)
                self.bias -= now * 0.1 * p
                self.vectors[ids] -= (now * 20) * weight[:, None] * back[None, :]
        return self

    def scores(self) -> tuple[np.ndarray, float]:
        """The share of each bucket in the difference of the two outputs, and its constant."""
        d = self.layer[1] - self.layer[0]
        return (self.vectors @ d).astype(np.float32), float(self.bias[1] - self.bias[0])


def score_texts(bucket: np.ndarray, constant: float, batches: Iterator[list[bytes]]) -> Iterator[np.ndarray]:
    def of(words: list[bytes], most: int = 20_000) -> list[complex]:
        out: list[complex] = []
        for i in range(0, len(words), most):
            some = words[i : i + most]
            at, ids = features(some)
            total, n = np.bincount(at, bucket[ids], len(some)), np.bincount(at, minlength=len(some))
            out += (total + 1j * n).tolist()
        return out

    table = ChunkTable(of, 150_000)
    for held in batches:
        split = [t.split() for t in held]
        known = table.load(set().union(*split))
        z = np.empty(len(held))
        for i, words in enumerate(split):
            s = np.fromiter(map(known.__getitem__, words), np.complex128, len(words)).sum() if words else 0j
            if words:
                again = AGAIN_WEIGHT * repeats(words)
                z[i] = constant + (s.real + again * float(bucket[AGAIN])) / (s.imag + again)
            else:
                z[i] = constant
        yield 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_column(spark: SparkSession, model: Model, text: str | Column = "text") -> Column:
    """The score of a text column, 0 to 1: whatever other columns a row has go along with it."""
    bucket, constant = model.scores()
    shared = spark.sparkContext.broadcast(bucket)

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes: list[int] = []

        def parts() -> Iterator[list[bytes]]:
            for c in columns:
                held = list(bounded(c))
                sizes.append(len(held))
                yield from held

        held: list[np.ndarray] = []
        for s in score_texts(shared.value, constant, parts()):
            held.append(s)
            if len(held) == sizes[0]:
                yield pa.array(np.concatenate(held))
                held, sizes[:] = [], sizes[1:]

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from freeing(score)(columns)

    return run(utf8(text))


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo modulus."""
    return F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % modulus


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most train_rows labelled documents of train_bytes in all, none of them held out (remainder(4) is 2)."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("quality").isin(0, 1) & (remainder(4) != 2))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    # At most train_rows rows, a doc_id that repeats too, of train_bytes together; the texts stay whole.
    rows = texts(documents).join(F.broadcast(sample), "doc_id")
    rows = materialize(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "quality").limit(train_rows), "labelled")
    room = rows.select("doc_id", "text", "quality", F.octet_length("text").alias("size"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "quality")  # over the bounded sample alone
    room = room.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= train_bytes)
    got = [(bytes(r.text), r.quality) for r in room.orderBy("doc_id", "text", "quality").collect()]
    release(rows)
    return Model().fit(got)


def quality_scores(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts get the score of no words. A null doc_id is not held out and is scored like
    any other; labels other than 0 and 1 are ignored; without labels every score is 0.5. Rows that
    repeat a doc_id are each scored; other columns are ignored; an empty table gives no rows.
    """
    score = score_column(documents.sparkSession, train(documents, labels, train_rows))
    out = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), score.alias("score"))
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
