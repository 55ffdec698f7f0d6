"""Vector operators as Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column, kind: str) -> Column:
    return F.aggregate(c, F.lit(0).cast(kind), lambda a, x: a + x)


def _squares(v: Column, kind: str) -> Column:
    return _sum(F.transform(v, lambda x: x.cast(kind) * x.cast(kind)), kind)


def same_length(a: Column, b: Column, result: Column) -> Column:
    message = F.concat(F.lit("Vector dimension mismatch: "), F.size(a), F.lit(" vs "), F.size(b))
    return F.when(F.size(a) == F.size(b), result).otherwise(F.raise_error(message).cast("double"))


def l2_normalize(v: Column) -> Column:
    """v over its Euclidean length; a zero vector stays."""
    wide = v.cast("array<double>")
    size = F.sqrt(_squares(wide, "double"))
    return F.when(size == 0, wide).otherwise(F.transform(wide, lambda x: x / size))


def quantize_int8(v: Column) -> Column:
    """Clamped to [-1, 1], times 127, halves rounded up."""
    one = F.lit(1.0)
    return F.transform(v.cast("array<double>"), lambda x: F.floor(F.greatest(-one, F.least(one, x)) * 127.0 + 0.5).cast("tinyint"))


def process_vector(v: Column) -> Column:
    return quantize_int8(l2_normalize(v))


def dot_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return same_length(a, b, _sum(products, "double"))


def norm(v: Column) -> Column:
    """The Euclidean length of an int8 vector, from exact integer sums."""
    return F.sqrt(_squares(v, "bigint"))


def cosine_similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """(cos + 1) / 2 of int8 vectors from exact integer sums; 0 when either is zero. Norms known before are not computed again."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y), F.lit(0), lambda s, x: s + x).cast("double")
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    score = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise((dot / (na * nb) + 1) / 2)
    return same_length(a, b, score)


def hamming_bits(a: Column, b: Column) -> Column:
    """Differing places of two bit strings packed into integers."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two arrays of bits."""
    return same_length(a, b, _sum(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), "int"))
