"""Vector similarity on ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from an inner product and the two norms; zero when a norm is zero."""
    return F.when(norm_a * norm_b == 0, F.lit(0.0)).otherwise(product / (norm_a * norm_b))


def cosine_similarity(a: Column, b: Column) -> Column:
    return cosine(dot(a, b), norm(a), norm(b))
