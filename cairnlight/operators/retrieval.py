"""Top-k retrieval: dense, keyword and hybrid, with budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlight.functions.text import tokens
from cairnlight.functions.vectors import cosine, mean_vector, norm
from cairnlight.session import spread, written


def dense_top_k(vectors: DataFrame, query: list[float], k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score) of the k largest cosines with one query vector, ties by id: a scan with a top-k per task, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(id_column, cosine(F.col(vector), q).alias("score")).filter("score is not null")
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def dense_top_k_many(
    vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", slices: int | None = None
) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine of each query against all rows; ties by id.

    The stored side is cut into slices of at most 200,000 rows, one task holds one of them as a matrix and all queries
    pass by in batches; each slice gives k rows per query, and a window over these finds the best. Null vectors and vectors
    without length have no cosine and are left out. Nothing goes through the driver.
    """
    slices = slices or max(12, -(-vectors.count() // 200_000))
    usable = lambda df: df.filter(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0))
    kind = vectors.schema[id_column].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, held, matrix = -1, [], [], None
        for whole in batches:
            for part, pdf in whole.groupby("slice", sort=True):
                if part != at:
                    at, ids, held, matrix = part, [], [], None
                mine, asked = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
                ids += mine["id"].tolist()
                held += mine["v"].tolist()
                if asked.empty or not ids:
                    continue
                if matrix is None:
                    names = np.array(ids, dtype=object)
                    order = np.argsort(names, kind="stable")
                    names, matrix, held = names[order], np.array(held, dtype=np.float64)[order], []
                    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
                q = np.array(asked["v"].tolist(), dtype=np.float64)
                q /= np.linalg.norm(q, axis=1, keepdims=True)
                found_q, found_i, found_s = [], [], []
                for name, scores in zip(asked["id"], q @ matrix.T):
                    # Ids are in order, so a stable sort of the rows at or above the k-th score breaks ties by id.
                    floor = np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
                    best = np.flatnonzero(scores >= floor)
                    best = best[np.argsort(-scores[best], kind="stable")][:k]
                    found_q += [name] * len(best)
                    found_i += names[best].tolist()
                    found_s += scores[best].tolist()
                yield pd.DataFrame({"query_id": found_q, id_column: found_i, "score": found_s})

    sent = usable(queries).select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(1).alias("side"), F.col(id_column).alias("id"), F.col(vector).alias("v"))
    kept = usable(vectors).select(F.pmod(F.xxhash64(id_column), F.lit(slices)).cast("int").alias("slice"), F.lit(0).alias("side"), F.col(id_column).alias("id"), F.col(vector).alias("v"))
    placed = sent.unionByName(kept).repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "side")
    found = placed.mapInPandas(scan, f"query_id {kind}, {id_column} {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def occurrences(tokens_: Column, word: str) -> Column:
    return F.size(F.filter(tokens_, lambda x: x == word))


def bm25(docs: DataFrame, id_column: str, text: str, query: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of every document: Okapi BM25 of the query words over lower-case tokens, one pass for the statistics and one for the scores."""
    words = sorted({w.lower() for w in query})
    toks = F.col("_t")
    rows = spread(docs.select(id_column, text)).select(id_column, tokens(text).alias("_t")).select(id_column, F.size(toks).alias("len"), *[occurrences(toks, w).alias(f"tf{i}") for i, w in enumerate(words)])
    rows = written(rows)  # a few numbers a document; the texts are split once
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("len").alias("_avg"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"_df{i}") for i in range(len(words))])
    scored = rows.join(F.broadcast(stats))  # one row
    score: Column = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1)
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("_avg")))
    return scored.select(id_column, score.alias("score"))


def min_max(column: str, df: DataFrame) -> Column:
    """The column scaled by its least and largest value (a one-row aggregate)."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return (F.col(column) - F.lit(low)) / F.lit((high - low) + 1e-8) if low is not None else F.col(column)


def nearest_to_centroid(vectors: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, distance) of the k rows closest to the mean vector."""
    centre = mean_vector(vectors, vector, []).withColumnRenamed(vector, "_c")
    gap = F.sqrt(F.aggregate(F.zip_with(F.col(vector), F.col("_c"), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    return vectors.join(F.broadcast(centre)).select(id_column, gap.alias("distance")).orderBy("distance", id_column).limit(k)


def qa_turns(turns: DataFrame, conversation: str, order: list[str], role: str) -> DataFrame:
    """Turns with their question number: each user turn starts one; turns before the first are dropped."""
    w = Window.partitionBy(conversation).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("qa", F.sum((F.col(role) == "user").cast("int")).over(w)).filter("qa > 0")
