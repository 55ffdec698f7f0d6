"""Keyword search: tokens and the query grammar, compiled to a Column predicate."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = r"[a-z0-9\x{80}-\x{10FFFF}]+"
_TOKEN = re.compile("[a-z0-9\u0080-\U0010ffff]+")
COLUMNS = ("id", "type", "note_id", "content", "note_path", "note_name", "block_id")


class QueryError(ValueError):
    """A query that the grammar does not allow."""


def fts_tokens(c: Column) -> Column:
    """Runs of ASCII letters, digits and characters beyond ASCII; only ASCII is lower-cased."""
    return F.regexp_extract_all(F.translate(c, UPPER, LOWER), F.lit(f"({TOKEN})"), F.lit(1))


def query_tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.translate(str.maketrans(UPPER, LOWER)))


@dataclass(frozen=True)
class Term:
    tokens: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Op:
    kind: str
    left: object
    right: object
    distance: int = 10


_LEX = re.compile(r"\(|\)|[^\s()]+")


def parse(query: str):
    """AND (also unspoken), OR, NOT, NEAR or NEAR/n, parentheses, term*, column:term. None if no token is left."""
    words, at = _LEX.findall(query), 0

    def peek() -> str | None:
        return words[at] if at < len(words) else None

    def primary():
        nonlocal at
        word = peek()
        if word is None or word == ")" or word in ("OR", "AND", "NOT") or re.fullmatch(r"NEAR(/\d+)?", word):
            raise QueryError(f"malformed query: {query!r}")
        at += 1
        if word == "(":
            inner = union()
            if peek() != ")":
                raise QueryError(f"malformed query: {query!r}")
            at += 1
            return inner
        column = None
        head, colon, rest = word.partition(":")
        if colon and head in COLUMNS:
            column, word = head, rest
        found = query_tokens(word)
        return Term(tuple(found), word.endswith("*"), column) if found else None

    def near():
        nonlocal at
        left = primary()
        while (m := re.fullmatch(r"NEAR(?:/(\d+))?", peek() or "")):
            at += 1
            left = Op("NEAR", left, primary(), int(m[1] or 10))
        return left

    def without():
        nonlocal at
        left = near()
        while peek() == "NOT":
            at += 1
            left = Op("NOT", left, near())
        return left

    def both():
        nonlocal at
        left = without()
        while (word := peek()) is not None and word not in ("OR", ")"):
            if word == "AND":
                at += 1
            right = without()
            left = right if left is None else left if right is None else Op("AND", left, right)
        return left

    def union():
        nonlocal at
        left = both()
        while peek() == "OR":
            at += 1
            right = both()
            left = right if left is None else left if right is None else Op("OR", left, right)
        return left

    if not words:
        return None
    out = union()
    if at < len(words):
        raise QueryError(f"malformed query: {query!r}")
    return out


class TokenArrays:
    """Terms looked up in the tokens of each row: token arrays by column name."""

    def __init__(self, columns: dict[str, Column]) -> None:
        self.columns = columns

    def has(self, token: str, prefix: bool, column: str) -> Column:
        found = self.columns[column]
        return F.exists(found, lambda x: x.startswith(token)) if prefix else F.array_contains(found, token)

    def places(self, token: str, prefix: bool, column: str) -> Column:
        hits = F.transform(self.columns[column], lambda x, i: F.when(x.startswith(token) if prefix else x == token, i))
        return F.filter(hits, lambda i: i.isNotNull())


class FoundPostings:
    """Terms looked up in the postings found for a row: an array of (column, term, positions)."""

    def __init__(self, found: Column) -> None:
        self.found = found

    @staticmethod
    def _hit(x: Column, token: str, prefix: bool, column: str) -> Column:
        return (x["column"] == column) & (x["term"].startswith(token) if prefix else x["term"] == token)

    def has(self, token: str, prefix: bool, column: str) -> Column:
        return F.exists(self.found, lambda x: self._hit(x, token, prefix, column))

    def places(self, token: str, prefix: bool, column: str) -> Column:
        return F.flatten(F.transform(F.filter(self.found, lambda x: self._hit(x, token, prefix, column)), lambda x: x["positions"]))


def _chain(tree) -> tuple[list[Term], list[int]] | None:
    """The terms of a NEAR/NEAR/... chain and the distances between them; None if an operand is not a term of one token."""
    if isinstance(tree, Term):
        return ([tree], []) if len(tree.tokens) == 1 else None
    if not isinstance(tree, Op) or tree.kind != "NEAR" or not isinstance(tree.right, Term):
        return None
    head, last = _chain(tree.left), _chain(tree.right)
    return (head[0] + last[0], [*head[1], tree.distance]) if head and last else None


def _near(source, terms: list[Term], distances: list[int], default: str) -> Column:
    """Some place of each term such that each is within its distance of the place taken for the term before."""

    def at(t: Term) -> Column:
        return source.places(t.tokens[0], t.prefix, t.column or default)

    def around(places: Column, n: int) -> Column:
        return F.flatten(F.transform(places, lambda i: F.concat(F.sequence(i - n, i - 1), F.sequence(i + 1, i + n))))

    reached = at(terms[0])
    for t, distance in zip(terms[1:], distances):
        reached = F.array_intersect(at(t), around(reached, distance + 1))
    return F.coalesce(F.size(reached) > 0, F.lit(False))


def predicate(tree, source, default: str = "content") -> Column:
    """Does a row match? source tells where a term's tokens are: TokenArrays or FoundPostings."""
    if tree is None:
        return F.lit(False)
    if isinstance(tree, Term):
        out = None
        for i, token in enumerate(tree.tokens):
            one = source.has(token, tree.prefix and i == len(tree.tokens) - 1, tree.column or default)
            out = one if out is None else out & one
        return out
    if tree.kind == "NEAR" and (chain := _chain(tree)):
        if len({t.column or default for t in chain[0]}) > 1:
            return F.lit(False)  # places of different columns are never near
        return _near(source, *chain, default)
    left, right = predicate(tree.left, source, default), predicate(tree.right, source, default)
    if tree.kind == "OR":
        return left | right
    return left & ~right if tree.kind == "NOT" else left & right


def leaves(tree) -> list[Term]:
    if tree is None:
        return []
    return [tree] if isinstance(tree, Term) else leaves(tree.left) + leaves(tree.right)


def used_columns(tree) -> set[str]:
    return {t.column or "content" for t in leaves(tree)}


def wanted(tree, default: str = "content") -> Column:
    """Which postings (column, term) a query needs."""
    out = F.lit(False)
    for t in leaves(tree):
        for i, token in enumerate(t.tokens):
            hit = F.col("term").startswith(token) if t.prefix and i == len(t.tokens) - 1 else F.col("term") == token
            out = out | ((F.col("column") == (t.column or default)) & hit)
    return out


#: A token's byte for each byte of UTF-8, 0 where there is none; bytes of text that are indexed at once.
_BYTES = np.zeros(256, np.uint8)
_BYTES[128:] = np.arange(128, 256)
for _c in LOWER + "0123456789":
    _BYTES[ord(_c)] = _BYTES[ord(_c.upper())] = ord(_c)
PIECE = 1 << 20


def postings(content: DataFrame) -> DataFrame:
    """The keyword index of content: term, column, docid, note_id and the term's positions in that column.

    All postings of a row follow from the row, so nothing is exchanged; what is made together is in order of terms.
    """
    rows = content.select("docid", *[F.col(c).cast("string").alias(c) for c in COLUMNS])
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("column", T.StringType()), rows.schema["docid"], T.StructField("note_id", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column("content")), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
            cuts = np.r_[0, np.flatnonzero(np.diff(upto)) + 1, len(upto)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                piece = b.slice(lo, hi - lo)
                yield from (p for p in (_column_postings(piece, c) for c in COLUMNS) if p.num_rows)

    return rows.mapInArrow(run, schema)


def _column_postings(b: pa.RecordBatch, column: str) -> pa.RecordBatch:
    """Postings of one column of a batch, by term and row: tokens are runs of bytes, numbered in each row."""
    text = pc.fill_null(b.column(column).cast(pa.large_string()), "")
    n, (_, ends, data) = len(text), text.buffers()
    ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + n + 1]
    data = _BYTES[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = data != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]
    start = np.flatnonzero(first)
    row = np.searchsorted(ends, start, "right") - 1
    count = np.bincount(row, minlength=n)
    position = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
    offsets = np.r_[np.cumsum(inside)[start] - 1, inside.sum()].astype(np.int64)
    tokens = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
    order = pc.array_sort_indices(tokens.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # One number for term, row and position: sorted, it is the index.
    span = int(position.max(initial=0)) + 1
    packed = np.sort((place[tokens.indices.to_numpy()] * n + row) * span + position)
    key = packed // span
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    rows = pa.array(key[at] % max(n, 1))
    positions = pa.ListArray.from_arrays(pa.array(np.r_[at, len(key)], pa.int32()), pa.array(packed - key * span, pa.int32()))
    term = tokens.dictionary.take(pa.array(order)).take(pa.array(key[at] // max(n, 1))).cast(pa.string())
    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int8)), pa.array([column])).cast(pa.string())
    return pa.RecordBatch.from_arrays([term, names, b.column("docid").take(rows), b.column("note_id").take(rows), positions], ["term", "column", "docid", "note_id", "positions"])
