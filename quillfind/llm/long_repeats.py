"""Removal of long repeats: bytes covered by a SPAN-byte string that also starts in a smaller doc_id.

Every SPAN-byte string has one anchor: the GRAM bytes of least hash in it. Equal strings have equal
anchors at equal places, so each document is cut into snippets, the runs of strings that share an
anchor. Anchors that occur in one document only are sorted out by their hashes. The distinct snippets of
the others meet by anchor in ranges of bounded size, where a run-length index is built over them
(run_index) and each is streamed over it: of each string comes the smallest document that has it. Bytes
decide in the index; hashes only bring candidates together.

Scale: texts are packed once into segments; each segment sends an anchor and a distinct snippet once, with
its least document there, and gets back runs of least documents, a few numbers a snippet. So a passage in
a third of all documents is a row a segment in its range, and no range holds a document's place. Segments
find their snippets' places again by themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, MIX1, materialize, mix64, read_table, trim
from .run_index import RunIndex
from .segments import pack, unpack, unzip, with_rows, zip_bytes

SPAN, GRAM = 50, 20
#: Text bytes for each hash range, snippet bytes that are matched at once, and strings that one index sorts.
RANGE_BYTES, LOT_BYTES, INDEX_STRINGS = 16 << 20, 4 << 20, 300_000
#: A missing doc_id ranks after all others.
NO_ID = np.iinfo(np.int64).max


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * GOLDEN + b
    x ^= x >> np.uint64(29)
    x *= MIX1
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k bytes, by doubling."""
    run, size, done, have = _BYTE[b], 1, None, 0
    while True:
        if k & size:
            done = run if done is None else _join(done[: len(run) - have], run[have:])
            have += size
        if 2 * size > k:
            return done[: max(0, len(b) - k + 1)]
        run, size = _join(run[:-size], run[size:]), 2 * size


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    run, size = h, 1
    while 2 * size <= width:
        run, size = np.minimum(run[:-size], run[size:]), 2 * size
    rest = width - size
    return np.minimum(run[: len(run) - rest], run[rest:]) if rest else run


def anchors(b: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first string) of each run of span-byte strings with one anchor hash; the last run ends at len(b) - span."""
    if len(b) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    least = sliding_min(gram_hashes(b, gram), span - gram + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return mix64(least[first]), first  # least hashes are small ones: spread anew, ranges are alike


def _six(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash."""
    return (h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _cuts(sorted48: np.ndarray, n: int) -> np.ndarray:
    """Where each of n ranges of 48-bit values begins, and the end."""
    return np.searchsorted((sorted48 >> np.uint64(8)) * np.uint64(n) >> np.uint64(40), np.arange(n + 1))


def _ids(doc_ids) -> np.ndarray:
    return np.array([NO_ID if x is None or x != x else int(x) for x in doc_ids], np.int64)


def _announce(n_ranges: int):
    """A segment -> its distinct anchors by range, and those that two of its documents have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                each = [np.unique(anchors(np.frombuffer(t, np.uint8))[0] >> np.uint64(16)) for t in unpack(r.sizes, r.n_bytes, r.pack)]
                found, counts = np.unique(np.concatenate(each), return_counts=True)
                out: list[tuple] = []
                for shared in (False, True):
                    some = found[(counts > 1) == shared]
                    cuts = _cuts(some, n_ranges)
                    out += [(k, r.seg, shared, _six(some[lo:hi] << np.uint64(16))) for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if lo < hi]
                if out:
                    yield pd.DataFrame(out, columns=["range", "seg", "shared", "keys"])
                    del out, each, found, counts
                trim()

    return run


def _meet(g: pd.DataFrame) -> pd.DataFrame:
    """The anchors of a range -> for each segment those that more than one document has."""
    trim()
    each = [_from_six(k) for k in g["keys"]]
    keys, row = np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each])
    by = np.argsort(keys, kind="stable")
    keys, row = keys[by], row[by]
    new = np.r_[True, keys[1:] != keys[:-1]]
    name = np.cumsum(new) - 1
    many = (np.bincount(name) > 1)[name] | g["shared"].to_numpy()[row]
    keys, seg = keys[many], g["seg"].to_numpy()[row[many]]
    by = np.argsort(seg, kind="stable")
    keys, seg = keys[by], seg[by]
    ends = np.flatnonzero(np.r_[seg[1:] != seg[:-1], True]) + 1 if len(seg) else []
    out, lo = [], 0
    for hi in ends:
        out.append((int(seg[lo]), _six(keys[lo:hi] << np.uint64(16))))
        lo = int(hi)
    return pd.DataFrame(out, columns=["seg", "keys"])


class _Snippets:
    """The snippets of a segment: where each is, and the distinct ones in order of range, then of appearance."""

    def __init__(self, r, shared: np.ndarray, n_ranges: int) -> None:
        key, doc, first, which = [], [], [], []
        names: dict[bytes, int] = {}
        keys: list[int] = []
        for i, t in enumerate(unpack(r.sizes, r.n_bytes, r.pack)):
            h, at = anchors(np.frombuffer(t, np.uint8))
            h = h >> np.uint64(16)
            ok = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h) if len(h) else []
            if not len(ok):
                continue
            n = np.diff(np.r_[at, len(t) - SPAN + 1])[ok]
            for k, a, m in zip(h[ok].tolist(), at[ok].tolist(), n.tolist()):
                j = names.setdefault(t[a : a + m + SPAN - 1], len(names))
                if j == len(keys):
                    keys.append(k)
                which.append(j)
            doc.append(np.full(len(ok), i))
            first.append(at[ok])
        self.doc, self.first = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (doc, first))
        self.keys = np.array(keys, np.uint64)
        self.texts = list(names)
        self.range = ((self.keys >> np.uint64(8)) * np.uint64(n_ranges) >> np.uint64(40)).astype(np.int64)
        self.order = np.argsort(self.range, kind="stable")
        self.which = np.array(which, np.int64)
        self.id = _ids(r.doc_ids)[self.doc]

    def by_range(self) -> Iterator[tuple[int, np.ndarray]]:
        """(range, distinct snippets in it)."""
        r = self.range[self.order]
        heads = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]).tolist() if len(r) else []
        for lo, hi in zip(heads, [*heads[1:], len(r)]):
            yield int(r[lo]), self.order[lo:hi]


def _shared(keys) -> np.ndarray:
    return np.unique(np.concatenate([_from_six(k) for k in keys]))


def _snippets(n_ranges: int):
    """A segment and its shared anchors -> distinct snippets by range: arrays of anchor, least document and length, and the bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.keys is None or not len(r.keys):
                    continue
                s = _Snippets(r, _shared(r.keys), n_ranges)
                least = np.full(len(s.texts), NO_ID, np.int64)
                np.minimum.at(least, s.which, s.id)
                out = []
                for k, at in s.by_range():
                    some = [s.texts[j] for j in at.tolist()]
                    data, counts = b"".join(some), np.array([len(x) for x in some]) - SPAN + 1
                    out.append((k, r.seg, len(at), _six(s.keys[at] << np.uint64(16)), zip_bytes(least[at].astype("<i8").tobytes()), zip_bytes(counts.astype("<u4").tobytes()), len(data), zip_bytes(data)))
                if out:
                    yield pd.DataFrame(out, columns=["range", "seg", "n", "keys", "ids", "counts", "size", "data"])
                del out, s
                trim()

    return run


_SNIPPETS = "range int, seg bigint, n bigint, keys binary, ids binary, counts binary, size bigint, data binary"
_TOLD = "seg bigint, range int, told binary"


def run_index(texts_: list[bytes], counts: np.ndarray, owners: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct snippets: (text, smallest document) of each span-byte string, strings in the texts' order."""
    index = RunIndex(texts_, counts, owners, span)
    return index.text, index.smallest()


def _match(g: pd.DataFrame) -> pd.DataFrame:
    """The snippets of a range -> for each segment the runs of least documents of its snippets' strings.

    Anchors are independent, so those of a range are taken in several lots, each of about LOT_BYTES.
    """
    lots = max(1, int(g["size"].sum()) // LOT_BYTES)
    found = []
    for lot in range(lots):
        found += _match_lot(g, lot, lots)
        trim()
    return pd.DataFrame(found, columns=["seg", "range", "told"])


def _match_lot(g: pd.DataFrame, lot: int, lots: int) -> list[tuple]:
    names: dict[bytes, int] = {}
    keys: list[int] = []
    name, entry, ids = [], [], []
    rows: list[tuple] = []
    for r in g.itertuples(index=False):
        n = np.frombuffer(unzip(r.counts, 4 * r.n), "<u4").astype(np.int64)
        key, ends = _from_six(r.keys), np.cumsum(n + SPAN - 1)
        own = np.flatnonzero(key % np.uint64(lots) == lot)
        if not len(own):
            continue
        data = unzip(r.data, r.size)
        for k, lo, hi in zip(key[own].tolist(), (ends - (n + SPAN - 1))[own].tolist(), ends[own].tolist()):
            i = names.setdefault(data[lo:hi], len(names))
            if i == len(keys):
                keys.append(k)
            name.append(i)
        rows.append((int(r.seg), int(r.range), len(own)))
        entry.append(own)
        ids.append(np.frombuffer(unzip(r.ids, 8 * r.n), "<i8")[own])
    if not name:
        return []
    name, listed = np.array(name), list(names)
    size = np.array([len(x) for x in listed], np.int64) - SPAN + 1
    owners = np.full(len(listed), NO_ID, np.int64)
    np.minimum.at(owners, name, np.concatenate(ids))
    # A snippet alone with its anchor shares its strings with its copies only: one run. The others go through the index.
    runs: list = [((int(n),), (int(o),)) for n, o in zip(size, owners)]
    _, of, n = np.unique(np.array(keys, np.uint64), return_inverse=True, return_counts=True)
    contested = np.flatnonzero(n[of] > 1)
    if len(contested):
        contested = contested[np.argsort(of[contested], kind="stable")]
        # Anchors are independent: some whole ones at a time bound the index's memory.
        step, group = np.cumsum(size[contested]) // INDEX_STRINGS, of[contested]
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        cuts = heads[np.r_[True, np.diff(step[heads]) > 0]].tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(contested)]):
            some = contested[lo:hi]
            text, least = run_index([listed[i] for i in some.tolist()], size[some], owners[some])
            new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (least[1:] != least[:-1])])
            lengths, of_text = np.diff(np.r_[new, len(text)]), text[new]
            bounds = np.searchsorted(of_text, np.arange(len(some) + 1)).tolist()
            lengths, values = lengths.tolist(), least[new].tolist()
            for k, i in enumerate(some.tolist()):
                runs[i] = (lengths[bounds[k] : bounds[k + 1]], values[bounds[k] : bounds[k + 1]])
    out, at = [], 0
    for (seg, k, m), own in zip(rows, entry):
        mine = [runs[i] for i in name[at : at + m].tolist()]
        at += m
        n_runs = np.array([len(x[0]) for x in mine], "<u4")
        lengths = np.array([v for x in mine for v in x[0]], "<u4")
        least = np.array([v for x in mine for v in x[1]], "<i8")
        head = np.array([m, len(lengths)], "<u8").tobytes()
        out.append((seg, k, zip_bytes(head + own.astype("<u4").tobytes() + n_runs.tobytes() + lengths.tobytes() + least.tobytes())))
    return out


def _spans(s: _Snippets, told) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, end) of what is covered in a segment, from the runs of its distinct snippets."""
    place = {}  # (range, entry) in the order in which the segment sent its snippets
    for k, at in s.by_range():
        place[k] = at
    n_runs, parts = np.zeros(len(s.texts), np.int64), []
    for k, blob in told:
        data = unzip_all(blob)
        m, total = (int(x) for x in np.frombuffer(data, "<u8", 2))
        of = place[k][np.frombuffer(data, "<u4", m, 16)]
        n = np.frombuffer(data, "<u4", m, 16 + 4 * m).astype(np.int64)
        n_runs[of] = n
        parts.append((np.repeat(of, n), np.frombuffer(data, "<u4", total, 16 + 8 * m).astype(np.int64), np.frombuffer(data, "<i8", total, 16 + 8 * m + 4 * total)))
    if not parts:
        return (np.empty(0, np.int64),) * 3
    of, length, least = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(of, kind="stable")
    length, least = length[by], least[by]
    first = np.cumsum(n_runs) - n_runs
    upto = np.cumsum(length)
    begin = upto - length - np.repeat((upto - length)[np.minimum(first, len(upto) - 1)], n_runs)
    n = n_runs[s.which]
    run = np.repeat(first[s.which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at = np.repeat(np.arange(len(s.which)), n)
    hit = least[run] < s.id[at]
    run, at = run[hit], at[hit]
    lo = s.first[at] + begin[run]
    return s.doc[at], lo, lo + length[run] + SPAN - 1


def _cut(n_ranges: int, keep_text: bool):
    """A segment and what the ranges told it -> a row for each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                doc = lo = hi = np.empty(0, np.int64)
                if r.told is not None and len(r.told):
                    doc, lo, hi = _spans(_Snippets(r, _shared(r.keys), n_ranges), [(x["range"], x["told"]) for x in r.told])
                by = np.lexsort((lo, doc))
                doc, lo, hi = doc[by], lo[by], hi[by]
                cuts = np.searchsorted(doc, np.arange(len(r.sizes) + 1))
                out = []
                for i, t in enumerate(unpack(r.sizes, r.n_bytes, r.pack)):
                    a, b = cuts[i], cuts[i + 1]
                    kept, at, n_spans, removed = [], 0, 0, 0
                    end = -1
                    for x, y in zip(lo[a:b].tolist(), hi[a:b].tolist()):
                        if x > end:
                            kept.append(t[at:x])
                            n_spans += 1
                            removed += y - x
                            at = end = y
                        elif y > end:
                            removed += y - end
                            at = end = y
                    kept.append(t[at:])
                    rest = b"".join(kept)
                    out.append((r.doc_ids[i], len(t), removed, n_spans, rest if keep_text else hashlib.sha256(rest).hexdigest()))
                frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if keep_text else "kept_sha256"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame
                del out, frame
                trim()

    return run


def unzip_all(data: bytes) -> bytes:
    """Decompress what zip_bytes made, its size unknown."""
    import pyarrow as pa

    return pa.CompressedInputStream(pa.BufferReader(bytes(data)), "zstd").read()


def ranges(packed: DataFrame) -> int:
    """How many hash ranges: one for RANGE_BYTES of text, and no fewer than there are shuffle partitions."""
    total = packed.agg(F.sum("n_bytes")).head()[0] or 0
    return max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))


def by_range(rows: DataFrame, n: int):
    """rows grouped by range, a task for about each of n ranges: they are bounded in text, not in what is left of it."""
    return rows.repartition(n, "range").groupBy("range")


def remove_long_repeats(documents: DataFrame, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, and kept (the bytes left) or kept_sha256.

    Null texts are empty. A null doc_id ranks after all others. Rows that repeat a doc_id do not
    remove from each other. Texts shorter than SPAN bytes keep all bytes. Other columns are ignored; an
    empty table gives no rows.
    """
    packed = pack(documents)
    n = ranges(packed)
    told = packed.select("seg", "sizes", "n_bytes", "pack").mapInPandas(_announce(n), "range int, seg bigint, shared boolean, keys binary")
    shared = materialize(by_range(told, n).applyInPandas(_meet, "seg bigint, keys binary"), "anchors", "none")
    known = with_rows(packed, shared, "keys")
    snippets = known.mapInPandas(_snippets(n), _SNIPPETS)
    least = by_range(snippets, n).applyInPandas(_match, _TOLD)
    least = materialize(least.select("seg", F.struct("range", "told").alias("told")), "runs", "none")
    kind = "kept_sha256 string" if digest else "kept binary"
    return with_rows(known, least, "told").mapInPandas(_cut(n, not digest), f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {kind}")


def op9_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_long_repeats(read_table(spark, sf_dir, "documents"), digest=True)
