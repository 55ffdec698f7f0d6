"""LM scoring with a log-frequency Bloom filter.

Counts of single tokens and of pairs of neighbours, and of each token how many different ones follow
it, are quantised to the logarithm of their frequency: an n-gram at level q is entered q times, as
(n-gram, 1) ... (n-gram, q), in a Bloom filter. The filter goes to the workers; a count is found again
by probing levels until one is missing. A pair's probability is interpolated with the token's own, in
the share that the history's followers have among its occurrences (Witten-Bell), so the smoothing, too,
is learned from the corpus. An n-gram seen once is at level 1: every one of the training texts is in.

Scale: each task counts a bounded segment of its tokens and sends sorted arrays of hashes and counts,
cut into hash ranges, so the exchange carries about 12 bytes a distinct n-gram and segment, and a
frequent token is one entry a segment. Pairs go to the range of their history. Ranges follow the size of
the input; one is reduced in one task and owns a slice of the filter. The filter has BITS bits an entry
at every size. While it and the exact token counts, for the base score, are within MAX_FILTER and
MAX_TABLE bytes, they go to the workers whole; past that they stay in their ranges: segments of the
texts send their distinct n-grams to the ranges and get levels and counts back, so no process holds
more than a slice, texts are read once, and scores are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, WordHashes, freeing, lower_words, materialize, mix64, read_table, release, texts, trim, utf8
from .quality import remainder
from .segments import pack, unpack, with_rows

SEGMENT_TOKENS = 3 << 19
LOG_BASE, BITS, PROBES = 1.5, 12, 4
MAX_FILTER, MAX_TABLE = 192 << 20, 96 << 20
#: Text bytes for each hash range; no fewer ranges than there are shuffle partitions.
RANGE_BYTES = 64 << 20
#: Stand-ins for the end of a text and for what is before its first token.
END, START = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
#: What is in the filter: tokens, pairs, and histories with the number of their followers.
TOKEN, PAIR, FOLLOWED = 1, 2, 3


def token_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    return np.append(known.array(lower_words(text)), END)


def histories(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What is before each token; starts: places where texts begin."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    return before


def pair_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix64(before * GOLDEN + tokens)


def _range(keys: np.ndarray, n: int) -> np.ndarray:
    """The hash range, of n, of each key; grows with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def distinct_pairs(before: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair hash, its history, its count, which pair each place has) in order of history, then hash."""
    keys, first, back, counts = np.unique(pair_hashes(before, tokens), return_index=True, return_inverse=True, return_counts=True)
    of = before[first]
    by = np.argsort(of, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return keys[by], of[by], counts[by], place[back]


def _pieces(n_ranges: int, tokens: np.ndarray, starts: np.ndarray, counted: bool) -> Iterator[tuple]:
    """(range, order, keys, counts, histories, pairs of each) of the distinct n-grams of some texts."""
    def cut(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
        cuts = np.searchsorted(_range(of, n_ranges), np.arange(n_ranges + 1)) if n_ranges < len(of) else None
        if cuts is None:  # few keys, many ranges
            r = _range(of, n_ranges)
            heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
            yield from zip(r[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(r)])
        else:
            yield from ((k, lo, hi) for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if lo < hi)

    keys, counts = np.unique(tokens, return_counts=True)
    for k, lo, hi in cut(keys):
        yield k, TOKEN, keys[lo:hi].tobytes(), counts[lo:hi].astype("<u4").tobytes() if counted else None, None, None
    keys, of, counts, _ = distinct_pairs(histories(tokens, starts), tokens)
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    sizes = np.diff(np.r_[heads, len(of)])
    for k, lo, hi in cut(of[heads]):
        a, b = heads[lo], heads[lo] + sizes[lo:hi].sum()
        yield k, PAIR, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes() if counted else None, of[heads[lo:hi]].tobytes(), sizes[lo:hi].astype("<u4").tobytes()


_PIECES = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
_PIECES_SQL = "range int, n int, keys binary, counts binary, before binary, sizes binary"


def _count(n_ranges: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(150_000)

        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, held)])[:-1]
            cols = zip(*_pieces(n_ranges, np.concatenate(held), starts, True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PIECES)], names=["range", "n", "keys", "counts", "before", "sizes"])

        held, size = [], 0
        for b in batches:
            for x in b.column(0):
                held.append(token_hashes(x.as_py(), known))
                size += len(held[-1])
                if size >= segment:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return run


def level(counts: np.ndarray, least: int = 1) -> np.ndarray:
    """The quantised count; an n-gram seen once is at level least."""
    return np.floor(np.log(counts) / np.log(LOG_BASE) + 1e-9).astype(np.int64) + least


def count_at(levels: np.ndarray) -> np.ndarray:
    """The middle count of a level; 0 where nothing was found."""
    q = (levels - 1).astype(np.float64)
    middle = np.where(q == 0, 1.0, (LOG_BASE**q + LOG_BASE ** (q + 1)) / 2)
    return np.where(levels > 0, middle, 0.0)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and a place of each."""
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts, by[first]


def _joined(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _reduce(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a range -> its tokens with exact counts, and its pairs and histories with their levels."""
    out: dict = {"range": int(key[0])}
    part = g[g["n"] == TOKEN]
    keys, counts, _ = _summed(_joined(part["keys"], np.uint64), _joined(part["counts"], "<u4").astype(np.int64))
    out |= {"tokens": int(counts.sum()), "types": len(keys), "keys1": keys.tobytes(), "counts1": counts.astype("<i8").tobytes(), "entries": int(level(counts).sum())}
    part = g[g["n"] == PAIR]
    keys = _joined(part["keys"], np.uint64)
    keys, counts, at = _summed(keys, _joined(part["counts"], "<u4").astype(np.int64))
    of = np.repeat(_joined(part["before"], np.uint64), _joined(part["sizes"], "<u4"))[at]
    before, followers = np.unique(of, return_counts=True)
    for n, k, c in ((PAIR, keys, counts), (FOLLOWED, before, followers)):
        q = level(c)
        out |= {f"keys{n}": k.tobytes(), f"levels{n}": q.astype(np.uint8).tobytes()}
        out["entries"] += int(q.sum())
    trim()
    return pd.DataFrame([out])[[c.split()[0] for c in _REDUCED.split(", ")]]


_REDUCED = "range int, tokens bigint, types bigint, entries bigint, keys1 binary, counts1 binary, keys2 binary, levels2 binary, keys3 binary, levels3 binary"


def _places(keys: np.ndarray, q: int | np.ndarray, size: np.ndarray | int, probe: int) -> np.ndarray:
    """Bit of probe number probe for (key, level q) in a slice of so many bits."""
    h = mix64(keys + np.asarray(q).astype(np.uint64) * GOLDEN)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * step) % np.asarray(size).astype(np.uint64)


def _tagged(keys: np.ndarray, order: int) -> np.ndarray:
    return keys ^ np.uint64(order)


def slice_of(r, bits: float) -> bytes:
    """The filter's slice of a reduced range."""
    size = int(max(64, np.ceil(r.entries * bits)))
    size += -size % 8
    mask = np.zeros(size, np.uint8)
    levels = level(np.frombuffer(r.counts1, "<i8")), np.frombuffer(r.levels2, np.uint8), np.frombuffer(r.levels3, np.uint8)
    for order, (keys, q) in enumerate(zip((r.keys1, r.keys2, r.keys3), levels), 1):
        keys, q = _tagged(np.frombuffer(keys, np.uint64), order), q.astype(np.int64)
        for at in range(1, int(q.max(initial=0)) + 1):
            some = keys[q >= at]
            for p in range(PROBES):
                mask[_places(some, at, size, p)] = 1
    return np.packbits(mask, bitorder="little").tobytes()


def _slices(bits: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame({"range": [r.range], "bits": [slice_of(r, bits)], "keys1": [r.keys1], "counts1": [r.counts1]})

    return run


class Filter:
    """The filter's slices; slice r holds the n-grams of range r."""

    def __init__(self, joined: np.ndarray, sizes: np.ndarray) -> None:
        """joined: the slices one after another; sizes: their bytes."""
        self.bits, self.n, self.sizes = joined, len(sizes), 8 * sizes
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, slice_: bytes) -> Filter:
        """A filter of one slice."""
        return cls(np.frombuffer(slice_, np.uint8), np.array([len(slice_)], np.int64))

    def levels(self, keys: np.ndarray, order: int, of: np.ndarray | None = None) -> np.ndarray:
        """Of distinct keys: the last level at which each is found. of: what their ranges go by, the keys themselves if not given."""
        r = _range(keys if of is None else of, self.n)
        size, start, tagged = self.sizes[r], self.starts[r], _tagged(keys, order)
        out, alive, at = np.zeros(len(keys), np.int64), np.flatnonzero(size > 0), 0
        while len(alive) and at < 64:
            at += 1
            for p in range(PROBES):
                bit = start[alive] + _places(tagged[alive], at, size[alive], p).astype(np.int64)
                alive = alive[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
            out[alive] = at
        return out


class Counts:
    """Exact token counts, sorted by hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        return np.where(self.keys[at] == tokens, self.counts[at], 0)


_SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base double, score double"


def smoothed(single: np.ndarray, both: np.ndarray, before: np.ndarray, followers: np.ndarray, total: int, types: int) -> np.ndarray:
    """log10 probability of each token from the counts of itself, of its pair, of its history and of the history's followers."""
    own = (single + 1) / (total + types + 1)
    followers = np.where(before > 0, np.maximum(followers, 1.0), 1.0)
    return np.log10((np.minimum(both, before) + followers * own) / (before + followers))


class Texts:
    """Tokens of some texts with what is distinct among them."""

    def __init__(self, held: list[bytes], known: WordHashes) -> None:
        each = [token_hashes(t, known) for t in held]
        self.n = np.array([len(x) for x in each], np.int64)
        self.starts = np.cumsum(self.n) - self.n
        tokens = np.concatenate(each)
        before = histories(tokens, self.starts)
        self.tokens, self.token_at = np.unique(tokens, return_inverse=True)
        self.histories = np.union1d(self.tokens, [START])  # the end of a text is followed by nothing
        self.history_at = np.searchsorted(self.histories, before)
        self.pairs, self.pair_of, _, self.pair_at = distinct_pairs(before, tokens)

    def scored(self, exact: np.ndarray, single: np.ndarray, both: np.ndarray, followers: np.ndarray, total: int, types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base, score) of each text: exact and single counts of tokens, pair counts, followers of histories."""
        c = exact[self.token_at]
        once = np.append(single, single[self.tokens == END][:1])  # texts begin as often as they end
        of = np.where(self.histories == START, len(single), np.searchsorted(self.tokens, self.histories))
        each = smoothed(single[self.token_at], both[self.pair_at], once[of][self.history_at], followers[self.history_at], total, types)
        sums = [np.add.reduceat(x, self.starts) for x in ((c > 0).astype(np.int64), np.log10(c + 1.0), each)]
        return sums[0], sums[1] - self.n * np.log10(total + types + 1), sums[2]


def _scored_batch(doc_ids: list, t: Texts, found: tuple) -> pa.RecordBatch:
    cols = (pa.array(doc_ids, pa.int64()), pa.array(t.n), *map(pa.array, found))
    return pa.RecordBatch.from_arrays(list(cols), names=[c.split()[0] for c in _SCORED.split(", ")])


def _score(shared, total: int, types: int, most: int = 4 << 20):
    """Scores with the whole filter and table in each worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, sizes, keys, counts = shared.value
        table, bloom, known = Counts(keys, counts), Filter(joined, sizes), WordHashes(150_000)

        def out(doc_ids: list, held: list[bytes]) -> pa.RecordBatch:
            t = Texts(held, known)
            single = count_at(bloom.levels(t.tokens, TOKEN))
            found = t.scored(table.of(t.tokens), single, count_at(bloom.levels(t.pairs, PAIR, t.pair_of)), count_at(bloom.levels(t.histories, FOLLOWED)), total, types)
            return _scored_batch(doc_ids, t, found)

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


def _ask(n_ranges: int):
    """A segment -> its distinct n-grams by range, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(150_000)
        for b in batches:
            for r in b.to_pylist():
                each = [token_hashes(t, known) for t in unpack(r["sizes"], r["n_bytes"], r["pack"])]
                starts = np.cumsum([0, *map(len, each)])[:-1]
                rows = [(k, r["seg"], n, keys, before, sizes) for k, n, keys, _, before, sizes in _pieces(n_ranges, np.concatenate(each), starts, False)]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["range", "seg", "n", "keys", "before", "sizes"])

    return run


_ANSWER = "seg bigint, range int, n int, levels binary, counts binary"


def _answer(asked: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
    """The n-grams asked of a range -> the level of each, a byte; of tokens exact counts, too, of pairs also their histories' levels."""
    bloom = Filter.of(bytes(made["bits"].iloc[0]) if len(made) else b"")
    table = Counts(_joined(made["keys1"], np.uint64), _joined(made["counts1"], "<i8"))
    rows = []
    for r in asked.itertuples(index=False):
        keys = np.frombuffer(r.keys, np.uint64)
        levels, counts = bloom.levels(keys, r.n).astype(np.uint8).tobytes(), None
        if r.n == TOKEN:
            counts = table.of(keys).astype("<i8").tobytes()
        else:
            rows.append((r.seg, r.range, FOLLOWED, bloom.levels(np.frombuffer(r.before, np.uint64), FOLLOWED).astype(np.uint8).tobytes(), None))
        rows.append((r.seg, r.range, r.n, levels, counts))
    trim()
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _ANSWER.split(", ")])


def _score_found(total: int, types: int):
    """A segment and the answers for its distinct n-grams -> the scores of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes(150_000)
        for b in batches:
            for r in b.to_pylist():
                t = Texts(list(unpack(r["sizes"], r["n_bytes"], r["pack"])), known)
                # ranges grow with the hash: their answers, one after another, are those of the sorted n-grams
                told = sorted(r["found"], key=lambda x: x["range"])
                counts = {n: count_at(np.frombuffer(b"".join(x["levels"] for x in told if x["n"] == n), np.uint8).astype(np.int64)) for n in (TOKEN, PAIR, FOLLOWED)}
                exact = np.frombuffer(b"".join(x["counts"] for x in told if x["n"] == TOKEN), "<i8")
                followers = np.zeros(len(t.histories))
                followers[np.searchsorted(t.histories, np.unique(t.pair_of))] = counts[FOLLOWED]
                yield _scored_batch(r["doc_ids"], t, t.scored(exact, counts[TOKEN], counts[PAIR], followers, total, types))

    return run


_CUT = "range int, bits binary, keys1 binary, counts1 binary"


def _gathered(cut: DataFrame, n_ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slices joined, their bytes, and token hashes and counts, a partition at a time: the driver holds them once."""
    sizes = np.zeros((2, n_ranges), np.int64)
    for r in cut.select("range", F.octet_length("bits"), F.octet_length("keys1")).collect():  # three numbers a range
        sizes[:, r[0]] = r[1], r[2] // 8
    at = np.cumsum(sizes, axis=1) - sizes
    joined = np.zeros(sizes[0].sum(), np.uint8)
    keys, counts = np.zeros(sizes[1].sum(), np.uint64), np.zeros(sizes[1].sum(), np.int64)
    for r in cut.toLocalIterator():
        first, here = at[:, r.range], sizes[:, r.range]
        joined[first[0] : first[0] + here[0]] = np.frombuffer(r.bits, np.uint8)
        keys[first[1] : first[1] + here[1]] = np.frombuffer(r.keys1, np.uint64)
        counts[first[1] : first[1] + here[1]] = np.frombuffer(r.counts1, "<i8")
    return joined, sizes[0], keys, counts


def lm_scores(documents: DataFrame, max_filter: int = MAX_FILTER, max_table: int = MAX_TABLE, segment: int = SEGMENT_TOKENS, bits: float = BITS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from whole texts that are not held out (remainder(7) is 2; a null doc_id is not).
    Null and empty texts are the end token alone. Repeated rows count as often as they are there.
    Without training texts all counts are 0. Tokens are told apart by 64-bit hashes. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length(utf8()))).head()[0] or 0
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    learn = texts(documents.where(F.coalesce(remainder(7) != 2, F.lit(True)))).select("text")
    counted = learn.mapInArrow(freeing(_count(n_ranges, segment)), _PIECES_SQL)
    reduced = materialize(counted.groupBy("range").applyInPandas(_reduce, _REDUCED), "ngrams")
    total, types, entries = (x or 0 for x in reduced.agg(F.sum("tokens"), F.sum("types"), F.sum("entries")).head())
    cut = reduced.select("range", "entries", "keys1", "counts1", "keys2", "levels2", "keys3", "levels3").mapInPandas(_slices(bits), _CUT)
    cut = materialize(cut, "filter", "none")
    release(reduced)
    if entries * bits <= 8 * max_filter and 16 * types <= max_table:
        shared = spark.sparkContext.broadcast(_gathered(cut, n_ranges))
        found = texts(documents).mapInArrow(freeing(_score(shared, total, types)), _SCORED)
    else:
        packed = pack(documents)
        asked = packed.select("seg", "sizes", "n_bytes", "pack").mapInArrow(freeing(_ask(n_ranges)), "range int, seg bigint, n int, keys binary, before binary, sizes binary")
        told = asked.groupBy("range").cogroup(cut.groupBy("range")).applyInPandas(_answer, _ANSWER)
        told = materialize(told.select("seg", F.struct("range", "n", "levels", "counts").alias("found")), "levels")
        found = with_rows(packed, told, "found").mapInArrow(freeing(_score_found(total, types)), _SCORED)
    return found.select("doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))
