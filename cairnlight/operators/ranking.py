"""Ranks without a task that must hold a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.session import written


def hash_order(*columns: str | Column, seed: int = 0) -> Column:
    """A pseudo-random but repeatable 64-bit order key."""
    return F.xxhash64(F.lit(seed), *columns)


def bucket_of(key: Column, buckets: int) -> Column:
    """Range bucket 0..buckets-1 of a 64-bit key: monotone in the key (buckets: a power of two)."""
    bits = buckets.bit_length() - 1
    return F.shiftright(key, 64 - bits) + F.lit(buckets // 2)


def hash_rank(
    df: DataFrame, group: list[str], id_columns: list[str], rank: str = "rank", seed: int = 0, buckets: int = 1024
) -> DataFrame:
    """1-based rank of each row in its group by a hash of id_columns (ties by the ids themselves).

    A window over the group alone would put a hot group into one task. Here the hash is cut
    into range buckets; rows are numbered within (group, bucket) and the number of rows in the
    group's earlier buckets is added. Null groups form a group. Repeated rows get ranks of their own.
    """
    keyed = df.withColumn("_key", hash_order(*id_columns, seed=seed)).withColumn(
        "_bucket", bucket_of(F.col("_key"), buckets)
    )
    filled = [F.coalesce(F.col(g).cast("string"), F.lit("\u0000")).alias(f"_g{i}") for i, g in enumerate(group)]
    keyed = keyed.withColumns({f"_g{i}": c for i, c in enumerate(filled)})
    names = [f"_g{i}" for i in range(len(group))]
    counts = keyed.groupBy(*names, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*names, "_bucket").orderBy("_key", *id_columns)
    return (
        keyed.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [*names, "_bucket"])
        .withColumn(rank, (F.col("_row") + F.col("_before")).cast("bigint"))
        .drop(*names, "_bucket", "_key", "_row", "_before")
    )


def running_total(
    df: DataFrame, group: list[str], value: str, id_columns: list[str], total: str, seed: int = 0, buckets: int = 1024
) -> DataFrame:
    """Running sum of value within group in hash order, by the same two steps as hash_rank. total must not be one of the columns used here."""
    if total in ("_bucket", "_key", "_sum", "_before"):
        raise ValueError(f"{total} is a column of the operator itself")
    keyed = df.withColumn("_key", hash_order(*id_columns, seed=seed)).withColumn(
        "_bucket", bucket_of(F.col("_key"), buckets)
    )
    sums = keyed.groupBy(*group, "_bucket").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*group, "_bucket").orderBy("_key", *id_columns)
    return (
        keyed.withColumn("_sum", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, [*group, "_bucket"])
        .withColumn(total, F.col("_sum") + F.col("_before"))
        .drop("_bucket", "_key", "_sum", "_before")
    )


def global_rank(df: DataFrame, value: str, rank: str, order: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """1-based rank of all rows by a numeric value, largest first, without one task that sorts them all.

    Without order, equal values share the smallest rank: rows are counted per value first, so a frequent value is one row.
    With order, rows are numbered, ties by its columns. Values are cut into buckets at approximate quantiles; the
    cut needs no accuracy, since buckets are monotone in the value and their sizes are counted. Null values come last.
    """
    probabilities = [i / buckets for i in range(1, buckets)]
    known = F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")))
    bounds = sorted(set(df.select(known.alias("_v")).approxQuantile("_v", probabilities, 0.01)), reverse=True)
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    keyed = df.withColumn("_v", known).withColumn("_b", F.size(F.filter(edges, lambda b: b > F.col("_v"))))
    rows = keyed if order is not None else keyed.groupBy("_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    size = F.count(F.lit(1)) if order is not None else F.sum("_n")
    counts = rows.groupBy("_b").agg(size.alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    offsets = counts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_b").orderBy(F.desc("_v"), *(order or []))
    if order is not None:
        ranked = rows.withColumn("_i", F.row_number().over(inside))
        return ranked.join(offsets, "_b").withColumn(rank, (F.col("_i") + F.col("_o")).cast("bigint")).drop("_b", "_v", "_i", "_o")
    upto = F.coalesce(F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = rows.withColumn("_i", upto).join(offsets, "_b").select("_b", "_v", (F.col("_i") + F.col("_o") + 1).cast("bigint").alias(rank))
    return keyed.join(values, ["_b", "_v"]).drop("_b", "_v")


def quantile(df: DataFrame, value: str, q: float, buckets: int = 256) -> DataFrame:
    """(quantile): the exact, linearly interpolated quantile of a numeric column, as one row; null where there is no value.

    Values are counted per range bucket (cut at approximate quantiles) and only the buckets that hold the two values beside the wanted place are sorted, so no
    task holds the column.
    """
    known = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    bounds = sorted(set(known.approxQuantile("_v", [i / buckets for i in range(1, buckets)], 0.001)))
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    counted = written(known.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.size(F.filter(edges, lambda b: b < F.col("_v")))))
    sizes = {r["_b"]: r["n"] for r in counted.groupBy("_b").agg(F.sum("_n").alias("n")).collect()}  # at most `buckets` rows
    place = q * (sum(sizes.values()) - 1)
    low, high, before, wanted = int(place // 1), int(-(-place // 1)), 0, {}
    for b in sorted(sizes):
        if before <= high and low < before + sizes[b]:
            wanted[b] = before
        before += sizes[b]
    if not wanted:
        return df.sparkSession.createDataFrame([(None,)], "quantile double")
    offsets = df.sparkSession.createDataFrame(sorted(wanted.items()), "_b int, _o bigint")
    upto = F.sum("_n").over(Window.partitionBy("_b").orderBy("_v")) + F.col("_o")
    near = counted.join(F.broadcast(offsets), "_b").withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n"))
    at = lambda k: F.max(F.when((F.col("_from") <= k) & (F.col("_to") > k), F.col("_v")))
    return near.agg(at(low).alias("a"), at(high).alias("b")).select((F.col("a") + (F.col("b") - F.col("a")) * F.lit(place - low)).alias("quantile"))
