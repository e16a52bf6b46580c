"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of the products, from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def mean_vector(df: DataFrame, vector: str, group: list[str], weight: Column | None = None) -> DataFrame:
    """Mean by position within group; partial sums are combined before the shuffle."""
    w = weight if weight is not None else F.lit(1.0)
    rows = df.select(*group, w.alias("_w"), F.posexplode(vector).alias("_p", "_x"))
    means = rows.groupBy(*group, "_p").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    packed = means.groupBy(*group) if group else means.groupBy()
    return packed.agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(vector))
