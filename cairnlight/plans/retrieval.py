"""Retrieval queries over embeddings, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlight.functions.text import has_all_words, has_phrase, keyword_overlap
from cairnlight.functions.vectors import cosine, mean_vector, norm
from cairnlight.operators import knowledge as K
from cairnlight.operators import retrieval as R
from cairnlight.operators.cohort import ordered_rank
from cairnlight.plans.registry import query
from cairnlight.session import table

COS = "list_dot_product(e.embedding, q.embedding) / (sqrt(list_dot_product(e.embedding, e.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding)))"
E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(vectors(spark, d).filter("vec_id = 0").first()["embedding"])


@query(f"WITH {E} SELECT e.vec_id, round({COS}, 6) AS score FROM e, (SELECT * FROM e WHERE vec_id = 0) q ORDER BY {COS} DESC, e.vec_id LIMIT 10")
def dense_top_k(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_top_k(vectors(spark, d), query_vector(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {E} SELECT e.vec_id, round({COS}, 6) AS score FROM e, (SELECT * FROM e WHERE vec_id = 0) q WHERE e.label IN (1, 3, 5) ORDER BY {COS} DESC, e.vec_id LIMIT 10")
def dense_top_k_filtered(spark: SparkSession, d: str) -> DataFrame:
    some = vectors(spark, d).filter(F.col("label").isin(1, 3, 5))
    return R.dense_top_k(some, query_vector(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH {E}, s AS (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS score FROM e, (SELECT * FROM e WHERE vec_id % 20 = 0) q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def dense_top_k_many(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set (every id divisible by 20) against all rows, in blocks."""
    found = R.dense_top_k_many(vectors(spark, d), vectors(spark, d).filter("vec_id % 20 = 0"), 5)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {E}, s AS (SELECT e.label, e.vec_id, {COS} AS score FROM e, (SELECT * FROM e WHERE vec_id = 0) q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM s)
    SELECT label || '-' || vec_id AS tagged, round(score, 6) AS score FROM r WHERE k <= 3 ORDER BY r.score DESC, vec_id LIMIT 10""")
def dense_multi_index(spark: SparkSession, d: str) -> DataFrame:
    """Each label is an index of its own: top 3 in each, ids tagged by index, then the global top 10."""
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, d)])
    s = vectors(spark, d).select("label", "vec_id", cosine(F.col("embedding"), q).alias("s"))
    w = Window.partitionBy("label").orderBy(F.desc("s"), "vec_id")
    top = s.withColumn("k", F.row_number().over(w)).filter("k <= 3").orderBy(F.desc("s"), "vec_id").limit(10)
    return top.select(F.concat_ws("-", "label", "vec_id").alias("tagged"), F.round("s", 6).alias("score"))


@query(f"WITH {E} SELECT vec_id, round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm FROM e")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query(f"""WITH {E}, x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM e), m AS (SELECT label, p, avg(x) AS m FROM x GROUP BY ALL)
    SELECT label, round(sum(m * m), 6) AS squared, round(sum(CASE WHEN p = 1 THEN m END), 6) AS first FROM m GROUP BY label""")
def vector_means(spark: SparkSession, d: str) -> DataFrame:
    m = mean_vector(vectors(spark, d), "embedding", ["label"])
    return m.select("label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"), F.round(F.col("embedding")[0], 6).alias("first"))


@query(f"""WITH {E}, x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM e), m AS (SELECT p, avg(x) AS m FROM x GROUP BY p), g AS (SELECT vec_id, sqrt(sum((x - m) * (x - m))) AS g FROM x JOIN m USING (p) GROUP BY vec_id)
    SELECT vec_id, round(g, 6) AS distance FROM g ORDER BY g, vec_id LIMIT 8""")
def centroid_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.nearest_to_centroid(vectors(spark, d), 8).select("vec_id", F.round("distance", 6).alias("distance"))


TF = r"len(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x = '{0}'))"
BM = f"""t AS (SELECT doc_id, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS len, {TF.format('fatigue')} AS a, {TF.format('itching')} AS b FROM documents WHERE text IS NOT NULL),
    g AS (SELECT count(*) AS n, avg(len) AS av, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM t),
    s AS (SELECT doc_id, ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * len / av)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * len / av)) AS score FROM t, g)"""


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(table(spark, d, "documents").filter("text is not null"), "doc_id", "text", ["fatigue", "itching"])


@query(f"WITH {BM} SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0")
def keyword_bm25(spark: SparkSession, d: str) -> DataFrame:
    return bm25_scores(spark, d).filter("score > 0").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {BM}, {E}, v AS (SELECT e.vec_id, {COS} AS c FROM e, (SELECT * FROM e WHERE vec_id = 0) q), h AS (SELECT doc_id, c, s.score AS k, (SELECT max(score) FROM s) AS mx, (SELECT min(score) FROM s) AS mn FROM s JOIN v ON vec_id = doc_id),
    x AS (SELECT doc_id, 0.6 * (c - (SELECT min(c) FROM h)) / ((SELECT max(c) - min(c) FROM h) + 1e-8) + 0.4 * (k - mn) / (mx - mn + 1e-8) AS score FROM h)
    SELECT doc_id, round(score, 6) AS score FROM x ORDER BY x.score DESC, doc_id LIMIT 15""")
def hybrid_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Dense and keyword scores, the first scaled over the candidates, the second over the whole corpus."""
    k = bm25_scores(spark, d)
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, d)])
    c = vectors(spark, d).select(F.col("vec_id").alias("doc_id"), cosine(F.col("embedding"), q).alias("c"))
    scaled = k.withColumn("k", R.min_max("score", k)).drop("score")
    h = scaled.join(c, "doc_id")
    x = h.withColumn("x", 0.6 * R.min_max("c", h) + 0.4 * F.col("k"))
    return x.orderBy(F.desc("x"), "doc_id").limit(15).select("doc_id", F.round("x", 6).alias("score"))


@query("""SELECT doc_id, round(((lower(text) LIKE '%itching%')::INT + (lower(text) LIKE '%ferritin%')::INT + (lower(text) LIKE '%skin clinic%')::INT) / 3.0, 6) AS overlap FROM documents WHERE text IS NOT NULL""")
def keyword_overlap_scores(spark: SparkSession, d: str) -> DataFrame:
    words = ["itching", "ferritin", "skin clinic"]
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.round(keyword_overlap("text", words), 6).alias("overlap"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])hay fever([^a-z0-9]|$)') AND lower(text) LIKE '%clinic%' AND lower(text) LIKE '%weeks%'""")
def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(has_phrase("text", "hay fever") & has_all_words("text", "weeks clinic")).select("doc_id")


@query(r"""WITH w AS (SELECT doc_id, source, n_chars // 4 AS cost FROM documents WHERE source IS NOT NULL), r AS (SELECT *, sum(cost) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM w)
    SELECT source, count(*) AS n, max(run) AS used FROM r WHERE run <= 8000 GROUP BY source""")
def budget_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Per source the documents in order that fit a token budget, up to the first that doesn't."""
    w = table(spark, d, "documents").filter("source is not null").select("doc_id", "source", F.expr("n_chars div 4").alias("cost"))
    kept = K.budget_prefix(w, ["source"], [F.col("doc_id")], "cost", 8000)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("used"))


@query("""WITH RECURSIVE w AS (SELECT provider_id, doc_id, n_chars // 4 AS cost, row_number() OVER (PARTITION BY provider_id ORDER BY doc_id) AS k FROM documents WHERE provider_id IS NOT NULL),
    r AS (SELECT provider_id, doc_id, cost, k, cost AS used, 0 AS batch FROM w WHERE k = 1
        UNION ALL SELECT w.provider_id, w.doc_id, w.cost, w.k, CASE WHEN used + w.cost > 2000 THEN w.cost ELSE used + w.cost END, CASE WHEN used + w.cost > 2000 THEN batch + 1 ELSE batch END FROM r JOIN w ON w.provider_id = r.provider_id AND w.k = r.k + 1)
    SELECT provider_id, doc_id, cost, batch FROM r""")
def budget_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of the documents of each provider, cut where the next one would overflow: a fold."""
    w = table(spark, d, "documents").filter("provider_id is not null").select("doc_id", "provider_id", F.expr("n_chars div 4").alias("cost"))
    return K.greedy_batches(w, "provider_id", "doc_id", "cost", 2000)


@query("""WITH t AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('view', 'signup') THEN 'user' ELSE 'assistant' END AS role FROM events),
    s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS qa FROM t) SELECT event_id, qa FROM s WHERE qa > 0""")
def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("event_type").isin("view", "signup"), "user").otherwise("assistant")
    return R.qa_turns(table(spark, d, "events").withColumn("role", role), "user_id", ["ts", "event_id"], "role").select("event_id", "qa")


@query("""WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'view') SELECT user_id, event_id, k FROM t WHERE k <= 3""")
def conversation_last_turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").filter("event_type = 'view'").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("user_id", "event_id", "k")


@query("SELECT vec_id, ntile(4) OVER (ORDER BY vec_id) AS fold FROM embeddings")
def report_folds(spark: SparkSession, d: str) -> DataFrame:
    """Four folds in the order of the ids; the first n % 4 have one more. Ranks come from range buckets, so no task sorts the table."""
    ranked = ordered_rank(vectors(spark, d).select("vec_id"), [], "vec_id", "_r")
    n = F.broadcast(vectors(spark, d).agg(F.count(F.lit(1)).alias("_n")))
    return ranked.join(n).select("vec_id", F.expr("int(if(_r <= _n % 4 * (_n div 4 + 1), (_r - 1) div (_n div 4 + 1), _n % 4 + (_r - 1 - _n % 4 * (_n div 4 + 1)) div greatest(_n div 4, 1)) + 1)").alias("fold"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM n) SELECT user_id, event_type AS vote FROM r WHERE k = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type"))["event_type"].alias("vote"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE k = 1""")
def state_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest row per key: what a job store with rising revisions holds. A partial max, so a hot key is no bottleneck."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return e.select("user_id", "event_type", "m.event_id", "m.value")
