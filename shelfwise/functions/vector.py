"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    )


def l2_normalize(v: Column) -> Column:
    """``v / (|v| + 1e-12)`` as doubles."""
    return bind(
        F.struct(v.alias("v"), (norm(v) + F.lit(EPSILON)).alias("n")),
        lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]),
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Dot product of the two normalised vectors, without building them."""
    return dot(a, b) / ((norm(a) + F.lit(EPSILON)) * (norm(b) + F.lit(EPSILON)))


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """Deterministic stand-in for an embedding model.

    The 32 bytes of the SHA-256 digest, repeated to ``dim``, scaled to [-1, 1] and normalised.
    """
    def scaled(digest: Column) -> Column:
        byte = lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.lit(31)), lambda i: (byte(i) - F.lit(127.5)) / F.lit(127.5)
        )

    def spread(block: Column) -> Column:
        return F.slice(F.flatten(F.array_repeat(block, -(-dim // 32))), 1, dim)

    raw = bind(F.sha2(text, 256), lambda digest: spread(scaled(digest)))
    return bind(
        bind(raw, lambda v: F.struct(v.alias("v"), norm(v).alias("n"))),
        lambda s: F.transform(s["v"], lambda x: (x / s["n"]).cast("float")),
    )
