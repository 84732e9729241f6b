"""Vector similarity, exact on arrays and by signatures on counted contexts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE_BITS = 32


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """C2 on one pair of vectors: each norm is held at ``eps`` or above."""
    norm_a = F.greatest(F.sqrt(dot(a, a)), F.lit(eps))
    norm_b = F.greatest(F.sqrt(dot(b, b)), F.lit(eps))
    return dot(a, b) / (norm_a * norm_b)


def signature_hash(token: Column) -> Column:
    """32 bits fixed by the token."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")


def signature_vote(value: Column, bit: int) -> Column:
    """+1 or -1: one bit of a :func:`signature_hash`."""
    return F.lit(1) - 2 * F.shiftright(value, bit).bitwiseAND(F.lit(1))


def signature_distance(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def signature_cosine(distance: Column) -> Column:
    """Cosine of the angle that random-hyperplane signatures estimate."""
    return F.cos(F.lit(math.pi / SIGNATURE_BITS) * distance)
