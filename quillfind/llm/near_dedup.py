"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct shingles of SHINGLE words. Each of REGISTERS registers keeps the
least of exponentially distributed values over the set, truncated on a scale of base BASE: the
registers of a union are the maxima of the registers, and two registers are equal with a probability
close to the Jaccard similarity. Registers are banded; sets that share a band are candidates.
Candidates are estimated by the joint likelihood of the register comparison given both set sizes,
and those that are not hopeless are verified on full sets.

No group is expanded into pairs. Equal sets collapse into one node first. Then each band's group is a
star around its least node, estimated and verified; linked nodes form components. Only groups that
still hold several components are looked at again, in blocks: a task holds the full sets of a block
and compares, a member at a time, with all members of other components that share enough registers. It
joins components as it goes and returns the links that joined two, so rows grow with the members and
never with their pairs. Thus a pair that shares a band is in one component, or was rejected by its
sizes, registers or likelihood, or was verified on full sets.

With BANDS bands of 3 registers a pair at similarity 0.75 shares none with probability 2e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import WordHashes, freeing, keyed_stream, lower_words, materialize, mix64, named_texts, read_table, release, shingles
from .components import connected_components

SHINGLE, BANDS, ROWS, BASE, RATE = 5, 24, 3, 1.001, 20.0
REGISTERS = BANDS * ROWS
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: A candidate whose most likely similarity is below this, six deviations off, is not verified.
HOPELESS = 0.45
#: Equal registers, of all, that a pair at the threshold has but for six deviations.
LEAST_EQUAL = int(REGISTERS * SIMILAR / 100 - 6 * (REGISTERS * SIMILAR / 100 * (1 - SIMILAR / 100)) ** 0.5)
#: Members of a band's group, and shingles of theirs, that a task compares with as many others; rows of a star in a task.
GROUP_BLOCK, GROUP_SHINGLES, STAR_BLOCK = 2048, 2 << 20, 512

_SEEDS = mix64(np.arange(1, 2 * 512 + 1, dtype=np.uint64))
_XOR = (_SEEDS[:512] >> np.uint64(32)).astype(np.uint32)
_MUL = (_SEEDS[512:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_set(text: bytes, known: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than a shingle make one; no words, none."""
    h = known.array(lower_words(text))
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(shingles(h, min(SHINGLE, len(h))))


def sketch(s: np.ndarray, n: int = REGISTERS) -> np.ndarray:
    """n SetSketch registers of a non-empty set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        v = x[i : i + 1024, None] ^ _XOR[:n]
        v *= _MUL[:n]
        np.minimum(least, v.min(axis=0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65535).astype("<u2")


_GRID = np.linspace(0.0, 1.0, 101)


def likely_similarity(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, given how many registers are greater, less and equal and both set sizes."""
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    top = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    j = _GRID[None, :] * top
    p1, p2 = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = more[:, None] * np.log(np.maximum(p1, tiny)) + less[:, None] * np.log(np.maximum(p2, tiny)) + equal[:, None] * np.log(np.maximum(1 - p1 - p2, tiny))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], 1)[:, 0]


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Of each row's two sketches the likely similarity; -1 where the sizes alone rule a link out."""
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    out = np.full(len(n_b), -1.0)
    at = np.flatnonzero(100 * np.minimum(n_a, n_b) >= SIMILAR * np.maximum(n_a, n_b))
    if len(at):
        x, y = a[at], b[at]
        more, equal = (x > y).sum(axis=1), (x == y).sum(axis=1)
        out[at] = likely_similarity(more, a.shape[1] - more - equal, equal, n_a[at], n_b[at])
    return out


_SIGNS_SQL = "doc_id bigint, text binary, file bigint, place bigint, rank binary, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary"
#: Where a missing doc_id ranks: after all others.
_NO_RANK = b"\xff" * 9


def rank_of(doc_id: int | None) -> bytes:
    """Bytes that sort as doc_ids do, a missing one last."""
    return _NO_RANK if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def _doc_id_of(node: Column) -> Column:
    """The doc_id at the head of a node, null for a missing one."""
    known = F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.length(node) == 24, known.cast("bigint"))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    salt = mix64(np.arange(BANDS, dtype=np.uint64))
    for b in batches:
        n, keys, bands, sketches = [], [], [], []
        for text in b.column(1):
            s = shingle_set(text.as_py(), known)
            n.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            if len(s) > 1:
                r = sketch(s)
                w = r.reshape(BANDS, ROWS).astype(np.uint64)
                bands.append(mix64((w[:, 0] | w[:, 1] << np.uint64(16) | w[:, 2] << np.uint64(32)) ^ salt).view(np.int64).tolist())
                sketches.append(r.tobytes())
            else:  # sets of one shingle are linked to equal sets only
                bands.append([])
                sketches.append(None)
        ranks = [rank_of(i) for i in b.column(0).to_pylist()]
        more = [pa.array(ranks, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[c.split()[0] for c in _SIGNS_SQL.split(", ")])


def _regs(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<u2").reshape(-1, REGISTERS)


def _promising(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    return pd.Series(estimates(_regs(a), _regs(b), n_a.to_numpy(), n_b.to_numpy()) >= HOPELESS)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows star, node, text in order of stars, the text of the star itself first -> the linked pairs (a, b)."""
    known = WordHashes()
    last, of_a = None, np.empty(0, np.uint64)
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            s = shingle_set(text.as_py(), known)
            if a == b:
                last, of_a = a, s
                continue
            if a != last:
                raise AssertionError("a star without its text")
            both = len(np.intersect1d(of_a, s, assume_unique=True))
            if 100 * both >= SIMILAR * (len(of_a) + len(s) - both):
                out[0].append(a)
                out[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["a", "b"])


def _star_links(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full texts are linked, written. A star's text goes once to each STAR_BLOCK of its pairs."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    dealt = pairs.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / STAR_BLOCK)).cast("int"))
    rows = dealt.select("a", "block", F.col("b").alias("node")).unionByName(sizes.select("a", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / STAR_BLOCK) - 1).cast("int"))).alias("block"), F.col("a").alias("node")))
    rows = rows.join(full, "node").repartition("a", "block").sortWithinPartitions("a", "block", F.col("node") != F.col("a"))
    return materialize(rows.select("a", "node", "text").mapInArrow(freeing(_verify), "a binary, b binary"), "links")


def joining_links(sets: list[np.ndarray], comp: np.ndarray, may: Callable[[int], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links between members of different components, each of which joins two; may(i): which members are compared with i.

    A pair of different components that may be compared is linked, or is of one component in the end.
    """
    n = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(n) - n
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(names), bool)
    values, label, counts = np.unique(comp, return_inverse=True, return_counts=True)
    rest = label != counts.argmax()  # each pair of different components has a member outside the largest, at least
    for i in np.flatnonzero(rest).tolist():
        other = may(i) & (label != label[i]) & (100 * np.minimum(n, n[i]) >= SIMILAR * np.maximum(n, n[i]))
        other[:i] &= ~rest[:i]  # those saw i already
        at = np.flatnonzero(other)
        if not len(at):
            continue
        mine = ids[starts[i] : starts[i] + n[i]]
        own[mine] = True
        if 4 * n[at].sum() > len(ids):
            both = np.add.reduceat(own[ids], starts, dtype=np.int64)[at]
        else:
            ends = np.cumsum(n[at])
            both = np.add.reduceat(own[ids[np.repeat(starts[at] - (ends - n[at]), n[at]) + np.arange(ends[-1])]], ends - n[at], dtype=np.int64)
        own[mine] = False
        for j in at[100 * both >= SIMILAR * (n[at] + n[i] - both)].tolist():
            if label[j] != label[i]:
                yield i, j
                label[label == label[j]] = label[i]


def _across(key: tuple, g: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Of two blocks of a group (or of one alone) the links that join components.

    A pair is looked at in the first band only that both share.
    """
    band, lo, hi = key
    known = WordHashes()
    side, node, bands, regs = g["block"].to_numpy(), g["node"].to_numpy(), np.stack(g["bands"].to_numpy()), _regs(g["sketch"])
    here = int((bands[0] == band).argmax())

    def may(i: int) -> np.ndarray:
        out = side != side[i] if lo != hi else np.ones(len(g), bool)
        out[out] = (regs[out] == regs[i]).sum(axis=1) >= LEAST_EQUAL
        out[out] = (bands[out] == bands[i]).argmax(axis=1) == here
        return out

    found = list(joining_links([shingle_set(t, known) for t in g["text"]], g["comp"].to_numpy(), may))
    if found:
        a, b = (node[list(x)] for x in zip(*found))
        yield pd.DataFrame({"a": a, "b": b})


def near_duplicates(documents: DataFrame, row: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; with row, also the file and place that name it and stays.

    Null, empty and blank texts have no shingles and are linked with nothing. Equal sets are linked. A
    null doc_id ranks after all others: a component of such rows alone has no id. Rows that repeat a
    doc_id are compared by their own texts, and have the id in common. kept is doc_id = component_id
    (two nulls are equal here); stays is true for one row of each component and for all without
    shingles. Other columns are ignored; an empty table gives no rows.
    """
    signs = materialize(named_texts(documents, row).mapInArrow(freeing(_sign), _SIGNS_SQL), "signs")
    # A node is a distinct set, named by its least doc_id and its key.
    best = F.min(F.struct("rank", "file", "place")).alias("best")
    reps = signs.where("set_key IS NOT NULL").groupBy("set_key").agg(best, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = materialize(reps.withColumn("node", F.concat("best.rank", "set_key")), "reps")
    banded = reps.select("node", "n", F.posexplode("bands").alias("k", "band"))
    leaders = banded.groupBy("k", "band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).where("size > 1")
    leaders = materialize(leaders, "leaders")
    members = materialize(banded.drop("n").join(leaders, ["k", "band"]), "members")

    ids = members.select("node", F.expr("substring(node, -16, 16)").alias("set_key")).distinct()
    full = signs.select("set_key", "text").join(ids, "set_key").groupBy("node").agg(F.first("text").alias("text"))  # texts of one set are as good
    full = materialize(full, "texts")

    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    side = reps.where("sketch IS NOT NULL").select("node", "n", "sketch")
    stars = stars.join(side.toDF("b", "n_b", "s_b"), "b").join(side.toDF("a", "n_a", "s_a"), "a")
    may_link = F.pandas_udf(_promising, BooleanType())
    links = _star_links(materialize(stars.where(may_link("s_a", "s_b", "n_a", "n_b")).select("a", "b"), "pairs"), full)
    labels = connected_components(links)

    # Groups that still hold several components; of those with the same members the first band's alone.
    told = members.where("size > 2").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = told.groupBy("k", "band").agg(
        (F.min("comp") < F.max("comp")).alias("mixed"),
        F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node")), F.sum(F.hash("node").cast("bigint"))).alias("members"),
    )
    mixed = mixed.where("mixed").groupBy("members").agg(F.min(F.struct("k", "band")).alias("first")).select("first.*")
    told = told.join(mixed, ["k", "band"])
    n_blocks = F.greatest(F.ceil(F.col("size") / GROUP_BLOCK), F.ceil(F.col("shingles") / GROUP_SHINGLES)).cast("int")
    dealt = told.withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "comp")
    dealt = dealt.join(reps.select("node", "bands", "sketch"), "node").join(full, "node")
    found = materialize(keyed_stream(dealt, ["band", "lo", "hi"], ["node"], _across, "a binary, b binary"), "links")
    if not found.isEmpty():
        labels = connected_components(links.unionByName(found))

    named = reps.select("set_key", "node", "best").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = materialize(named.select("set_key", "comp", F.when(F.col("comp") == F.col("node"), F.col("best")).alias("best")), "named")
    release(members, full)
    out = signs.select("doc_id", "n_shingles", "set_key", "rank", "file", "place").join(named, "set_key", "left")
    comp = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(_doc_id_of(F.col("comp")))
    out = out.withColumn("component_id", comp).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = F.col("set_key").isNull() | F.coalesce(F.struct("rank", "file", "place").eqNullSafe(F.col("best")), F.lit(False))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *(["file", "place", stays.alias("stays")] if row else []))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.m = l.a),
k AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM k LEFT JOIN n USING (doc_id)
"""
