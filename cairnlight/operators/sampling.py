"""Plain samples of cohorts: quotas with carry-over and fixed sizes, by repeatable hash ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlight.operators.ranking import hash_rank


def cohort_sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """size rows with the smallest hashes of their key (a top-k, so nothing is sorted whole); all rows if there are fewer."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), key)).orderBy("_h", key).limit(size).drop("_h")


def quota_sample(df: DataFrame, key: str, group: str, quotas: DataFrame, existing: DataFrame, seed: int = 42) -> DataFrame:
    """(key, group, kept): every group filled up to its quota, rows chosen before first.

    quotas: (group, quota); existing: keys of an earlier choice. Existing rows of a group are kept even beyond the quota.
    """
    had = df.join(existing.select(key).distinct(), key, "left_semi").select(key, group)
    open_ = df.join(existing.select(key), key, "left_anti").select(key, group)
    taken = had.groupBy(group).agg(F.count(F.lit(1)).alias("_t"))
    room = quotas.join(taken, group, "left").select(group, (F.col("quota") - F.coalesce("_t", F.lit(0))).alias("_room")).filter("_room > 0")
    new = hash_rank(open_, [group], [key], "_r", seed).join(room, group).filter("_r <= _room").select(key, group)
    return had.withColumn("kept", F.lit("before")).unionByName(new.withColumn("kept", F.lit("new")))
