"""Test statistics as column expressions; tails of distributions by Arrow-batched functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled two-proportion z; null where the pooled variance is 0 or a group is empty."""
    p = (k1 + k2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return F.when((n1 > 0) & (n2 > 0) & (se > 0), (k1 / n1 - k2 / n2) / se)


def proportion_difference_ci(k1: Column, n1: Column, k2: Column, n2: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Unpooled confidence interval of the difference of two proportions."""
    a, b = k1 / n1, k2 / n2
    half = z * F.sqrt(a * (1 - a) / n1 + b * (1 - b) / n2)
    return a - b - half, a - b + half


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a normal deviate."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if pd.notna(x) else None).astype("float64")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile: the t with two-sided tail 2 * (1 - p), by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic; null where either is null or df < 1."""
    ok = [pd.notna(a) and pd.notna(b) and b >= 1 for a, b in zip(t, df)]
    return pd.Series([t_two_sided(a, b) if k else None for a, b, k in zip(t, df, ok)], dtype="float64")


def holm(df: DataFrame, family: list[str], p: str, order: list[str], adjusted: str = "p_holm") -> DataFrame:
    """Holm's step-down within families. A missing p keeps its place in the family as if it were 1, and stays null."""
    filled = F.coalesce(F.col(p), F.lit(1.0))
    own = Window.partitionBy(*family).orderBy(filled, *order)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = filled * (size - F.row_number().over(own) + 1)
    ranked = df.withColumn("_step", step)
    up = Window.partitionBy(*family).orderBy(filled, *order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(adjusted, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_step").over(up)))).drop("_step")


def cluster_t(df: DataFrame, group: list[str], cluster: str, difference: str) -> DataFrame:
    """Paired cluster-robust (CR1) t test of mean difference 0: n, clusters, mean, t, df and status per group.

    Differences are summed per cluster first, so what the second step sees has one row per cluster. Null
    differences are left out. Fewer than two clusters: insufficient; a variance of (almost) 0: zero_variance.
    """
    per = df.filter(F.col(difference).isNotNull()).groupBy(*group, cluster).agg(F.sum(difference).alias("_s"), F.count(F.lit(1)).alias("_n"))
    # Sum over clusters of (s - n * mean)^2 from three sums.
    sums = per.groupBy(*group).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("clusters"), F.sum("_s").alias("_s"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"),
        F.sum(F.col("_s") * F.col("_n")).alias("_sn"), F.sum(F.col("_n") * F.col("_n")).alias("_nn"),
    )
    mean = F.col("_s") / F.col("n")
    squares = F.greatest(F.lit(0.0), F.col("_ss") - 2 * mean * F.col("_sn") + mean * mean * F.col("_nn"))
    out = sums.withColumn("mean", mean).withColumn("_var", F.when(F.col("clusters") > 1, squares / (F.col("n") * F.col("n")) * F.col("clusters") / (F.col("clusters") - 1)))
    status = F.when(F.col("clusters") < 2, "insufficient").when(F.col("_var") <= 1e-24, "zero_variance").otherwise("ok")
    return out.select(
        *group, "n", "clusters", "mean", F.when(status == "ok", F.col("mean") / F.sqrt("_var")).alias("t"), (F.col("clusters") - 1).alias("df"), status.alias("status")
    )
