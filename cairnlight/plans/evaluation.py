"""Evaluation queries: scored predictions are events (case = event_id, cluster = user_id, arm = event_type, score = value / (1 + value))."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlight.functions import metrics
from cairnlight.functions.stats import cluster_t, holm, student_p, t_quantile
from cairnlight.operators.shredding import ResultTables
from cairnlight.plans.registry import query
from cairnlight.session import table, written

SCORED = "s AS (SELECT event_id, user_id, event_type AS arm, value / (1 + value) AS score, ts FROM events)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("arm"), (F.col("value") / (1 + F.col("value"))).alias("score"), "ts")


@query(f"""WITH {SCORED} SELECT arm, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(min(score), 6) AS low, round(max(score), 6) AS high,
    round(quantile_cont(score, 0.5), 6) AS median, round(stddev_samp(score), 6) AS sample_sd FROM s GROUP BY arm""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return scored(spark, d).groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("score")).alias("mean"), r(F.stddev_pop("score")).alias("sd"), r(F.min("score")).alias("low"), r(F.max("score")).alias("high"),
        r(F.percentile("score", F.lit(0.5))).alias("median"), r(F.stddev_samp("score")).alias("sample_sd"),
    )


@query(f"""WITH {SCORED}, g AS (SELECT arm, user_id % 3 AS bin, score FROM s), a AS (SELECT arm, bin, count(*) AS n, avg(score) AS m FROM g GROUP BY GROUPING SETS ((arm, bin), (arm)))
    SELECT arm, bin, n, round(m, 6) AS mean FROM a""")
def score_levels(spark: SparkSession, d: str) -> DataFrame:
    """Rows per arm and bin, and subtotals per arm (bin null)."""
    g = scored(spark, d).select("arm", (F.col("user_id") % 3).alias("bin"), "score")
    return g.groupingSets([["arm", "bin"], ["arm"]], "arm", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"""WITH {SCORED}, g AS (SELECT user_id % 3 AS bin, arm, avg(score) AS m FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY m DESC, arm) AS k FROM g) SELECT bin, arm AS best, round(m, 6) AS mean FROM r WHERE k = 1""")
def best_arm(spark: SparkSession, d: str) -> DataFrame:
    g = scored(spark, d).groupBy((F.col("user_id") % 3).alias("bin"), "arm").agg(F.avg("score").alias("m"))
    w = Window.partitionBy("bin").orderBy(F.desc("m"), "arm")
    return g.withColumn("k", F.row_number().over(w)).filter("k = 1").select("bin", F.col("arm").alias("best"), F.round("m", 6).alias("mean"))


@query(f"""WITH {SCORED}, r AS (SELECT arm, score, row_number() OVER (PARTITION BY user_id, arm ORDER BY ts, event_id) AS rank FROM s) SELECT arm, round(avg(score / rank), 6) AS weighted FROM r GROUP BY arm""")
def rank_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id", "arm").orderBy("ts", "event_id")
    r = scored(spark, d).withColumn("rank", F.row_number().over(w))
    return r.groupBy("arm").agg(F.round(F.avg(F.col("score") / F.col("rank")), 6).alias("weighted"))


PAIRS = f"""{SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, arm ORDER BY ts, event_id) AS k FROM s),
    pairs AS (SELECT b.user_id, b.k, a.arm, a.score - b.score AS diff FROM n b JOIN n a ON a.user_id = b.user_id AND a.k = b.k AND a.arm <> 'view' WHERE b.arm = 'view')"""


def paired(spark: SparkSession, d: str) -> DataFrame:
    """The k-th score of every arm against the k-th of the baseline arm of the same user."""
    w = Window.partitionBy("user_id", "arm").orderBy("ts", "event_id")
    n = scored(spark, d).withColumn("k", F.row_number().over(w))
    base = n.filter("arm = 'view'").select("user_id", "k", F.col("score").alias("base"))
    return n.filter("arm <> 'view'").join(base, ["user_id", "k"]).select("user_id", "k", "arm", (F.col("score") - F.col("base")).alias("diff"))


@query(f"""WITH {PAIRS}, m AS (SELECT arm, count(*) AS n, avg(diff) AS mean, count(DISTINCT user_id) AS g FROM pairs GROUP BY arm), c AS (SELECT arm, user_id, sum(diff) AS s, count(*) AS k FROM pairs GROUP BY ALL),
    v AS (SELECT arm, sum((s - k * mean) * (s - k * mean)) AS q FROM c JOIN m USING (arm) GROUP BY arm)
    SELECT arm, n, g AS clusters, round(mean, 6) AS mean, round(mean / sqrt(q / (n * n) * g / (g - 1)), 4) AS t, g - 1 AS df FROM m JOIN v USING (arm)""")
def paired_cluster_t(spark: SparkSession, d: str) -> DataFrame:
    t = cluster_t(paired(spark, d), ["arm"], "user_id", "diff")
    return t.select("arm", "n", "clusters", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"), "df")


#: Two-sided tail of Student's t in SQL: the density integrated by Simpson's rule over 4,000 steps.
STUDENT = """(1 - 2 * abs(t) / 4000 / 3 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi() * df)
    * list_sum(list_transform(generate_series(0, 4000), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(t * i / 4000, 2) / df, -(df + 1) / 2.0))))"""
CLUSTER = f"""{PAIRS}, m AS (SELECT arm, count(*) AS n, avg(diff) AS mean, count(DISTINCT user_id) AS g FROM pairs GROUP BY arm), c AS (SELECT arm, user_id, sum(diff) AS s, count(*) AS k FROM pairs GROUP BY ALL),
    v AS (SELECT arm, sum((s - k * mean) * (s - k * mean)) AS q FROM c JOIN m USING (arm) GROUP BY arm),
    ts AS (SELECT arm, n, mean, mean / sqrt(q / (n * n) * g / (g - 1)) AS t, CAST(g - 1 AS DOUBLE) AS df FROM m JOIN v USING (arm))"""
HOLM = f"""{CLUSTER}, ps AS (SELECT arm, n, t, df, {STUDENT} AS p FROM ts), hs AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, arm) + 1) AS h FROM ps),
    holm AS (SELECT arm, n, t, p, least(1.0, max(h) OVER (ORDER BY p, arm ROWS UNBOUNDED PRECEDING)) AS p_holm FROM hs)"""


@query(f"WITH {HOLM} SELECT arm, n, round(t, 4) AS t, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM holm")
def paired_holm(spark: SparkSession, d: str) -> DataFrame:
    """The same tests with p and Holm's correction."""
    return _holm(spark, d).select("arm", "n", F.round("t", 4).alias("t"), F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


def _holm(spark: SparkSession, d: str) -> DataFrame:
    t = cluster_t(paired(spark, d), ["arm"], "user_id", "diff").withColumn("family", F.lit("all"))
    return holm(t.withColumn("p", student_p("t", "df")), ["family"], "p", ["arm"])


@query(f"""WITH RECURSIVE {CLUSTER}, b AS (SELECT arm, mean, abs(mean / t) AS se, df, CAST(0 AS DOUBLE) AS lo, CAST(50 AS DOUBLE) AS hi, 0 AS k FROM ts
    UNION ALL SELECT arm, mean, se, df, CASE WHEN {STUDENT.replace("t * i", "mid * i").replace("abs(t)", "mid")} > 0.05 THEN mid ELSE lo END, CASE WHEN {STUDENT.replace("t * i", "mid * i").replace("abs(t)", "mid")} > 0.05 THEN hi ELSE mid END, k + 1
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM b) WHERE k < 40)
    SELECT arm, round(mean, 5) AS mean, round(mean - se * lo, 5) AS low, round(mean + se * lo, 5) AS high FROM b WHERE k = 40""")
def arm_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference of each arm to the baseline with a 95 % interval from the clustered variance."""
    t = cluster_t(paired(spark, d), ["arm"], "user_id", "diff")
    rows = t.collect()  # one row per arm
    out = [(r["arm"], r["mean"], *((r["mean"] - q, r["mean"] + q) if r["t"] else (None, None))) for r in rows for q in [abs(r["mean"] / r["t"]) * t_quantile(0.975, r["df"]) if r["t"] else 0]]
    wide = spark.createDataFrame(out, "arm string, mean double, low double, high double")
    return wide.select("arm", *[F.round(c, 5).alias(c) for c in ("mean", "low", "high")])


@query("""WITH p AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) / 400.0 AS p FROM (SELECT DISTINCT p_brand FROM part)), f AS (SELECT CASE WHEN p_brand < 'Brand#2' THEN 'a' ELSE 'b' END AS family, p_brand, p FROM p),
    r AS (SELECT *, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, p_brand) + 1) AS s FROM f)
    SELECT family, p_brand, round(least(1.0, max(s) OVER (PARTITION BY family ORDER BY p, p_brand ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM r""")
def holm_families(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").select("p_brand").distinct()
    p = b.withColumn("p", F.row_number().over(Window.orderBy("p_brand")) / 400.0).withColumn("family", F.when(F.col("p_brand") < "Brand#2", "a").otherwise("b"))
    return holm(p, ["family"], "p", ["p_brand"]).select("family", "p_brand", F.round("p_holm", 6).alias("p_holm"))


@query(f"""WITH {SCORED} PIVOT (SELECT user_id, arm, score FROM s) ON arm IN ('click', 'error', 'purchase', 'signup', 'view') USING round(avg(score), 6) GROUP BY user_id""")
def score_pivot(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("user_id").pivot("arm", ["click", "error", "purchase", "signup", "view"]).agg(F.round(F.avg("score"), 6))


@query("SELECT event_type AS arm, count(*) AS n, round(avg(value / (1 + value)), 6) AS mean, TRUE AS inside, TRUE AS width_fits FROM events GROUP BY 1")
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The resampled intervals beside the means: whether the mean is inside, and whether the width is that of the normal interval of the ratio of sums over users, up to a fifth."""
    per = scored(spark, d).groupBy("arm", "user_id").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("k"))
    m = per.groupBy("arm").agg(F.sum("k").alias("n"), (F.sum("s") / F.sum("k")).alias("mean"))
    spread_ = per.join(m, "arm").groupBy("arm").agg((F.sqrt(F.sum(F.pow(F.col("s") - F.col("k") * F.col("mean"), 2))) / F.max("n")).alias("se"))
    wide = m.join(cluster_bootstrap(spark, d), "arm").join(spread_, "arm")
    ratio = (F.col("high") - F.col("low")) / (2 * 1.96 * F.col("se"))
    return wide.select("arm", "n", F.round("mean", 6).alias("mean"), F.col("mean").between(F.col("low"), F.col("high")).alias("inside"), ratio.between(0.8, 1.2).alias("width_fits"))


@query()
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Percentile interval of each arm's mean over 500 resamples of whole users.

    Each user draws its weights from a generator seeded with its own id (Poisson weights: the multinomial's
    limit), so every task resamples on its own and only 500 pairs of sums per arm are added up. Seeded draws aren't in SQL.
    """
    rounds = 500
    per = scored(spark, d).groupBy("arm", "user_id").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))

    def draw(batches):
        for pdf in batches:
            sums: dict = {}
            for arm, user, s, n in zip(pdf["arm"], pdf["user_id"], pdf["s"], pdf["n"]):
                w = np.random.Generator(np.random.PCG64(int(user))).poisson(1.0, rounds)
                a = sums.setdefault(arm, np.zeros((2, rounds)))
                a[0] += w * s
                a[1] += w * n
            yield pd.DataFrame([(arm, i, a[0, i], a[1, i]) for arm, a in sums.items() for i in range(rounds)], columns=["arm", "i", "s", "n"])

    totals = per.mapInPandas(draw, "arm string, i int, s double, n double").groupBy("arm", "i").agg((F.sum("s") / F.sum("n")).alias("mean"))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return totals.groupBy("arm").agg(q.alias("q")).select("arm", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


@query(f"""WITH {HOLM}, a AS (SELECT event_type AS arm, count(*) AS n, avg(value / (1 + value)) AS mean FROM events GROUP BY 1), d AS (SELECT arm, avg(diff) AS gain FROM pairs GROUP BY arm)
    SELECT arm, a.n, round(mean, 6) AS mean, TRUE AS interval_known, round(gain, 6) AS gain, round(t, 4) AS t, round(p_holm, 6) AS p_holm FROM a LEFT JOIN d USING (arm) LEFT JOIN holm USING (arm)
    UNION ALL SELECT 'equal average', NULL, round(avg(mean), 6), NULL, CASE WHEN count(*) FILTER (WHERE arm <> 'view') = count(gain) THEN round(avg(gain), 6) END, NULL, NULL FROM a LEFT JOIN d USING (arm)""")
def results_table(spark: SparkSession, d: str) -> DataFrame:
    """The main table: per arm the mean with its resampled interval, the gain over the baseline, t and Holm's p; an arm without pairs keeps its row, and
    a last row averages the arms with the same weight, its gain only if every arm has one."""
    means = scored(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    tests = _holm(spark, d).select("arm", "t", "p_holm")
    gain = paired(spark, d).groupBy("arm").agg(F.avg("diff").alias("gain"))
    wide = written(means.join(cluster_bootstrap(spark, d), "arm", "left").join(gain, "arm", "left").join(tests, "arm", "left"))
    rounded = lambda c, k: F.round(c, k)
    rows = wide.select("arm", "n", rounded("mean", 6).alias("mean"), (F.col("low") <= F.col("high")).alias("interval_known"), rounded("gain", 6).alias("gain"), rounded("t", 4).alias("t"), rounded("p_holm", 6).alias("p_holm"))
    whole = F.count_if(F.col("arm") != "view") == F.count("gain")
    last = wide.agg(F.avg("mean").alias("mean"), F.when(whole, F.avg("gain")).alias("gain")).select(
        F.lit("equal average").alias("arm"), F.lit(None).cast("bigint").alias("n"), rounded("mean", 6).alias("mean"), F.lit(None).cast("boolean").alias("interval_known"),
        rounded("gain", 6).alias("gain"), F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("p_holm"),
    )
    return rows.unionByName(last)


@query("""WITH g AS (SELECT user_id % 3 AS bin, event_type AS arm, avg(value / (1 + value)) AS m, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT bin, max(CASE WHEN arm = 'view' THEN m END) AS base FROM g GROUP BY bin)
    SELECT arm, round(avg(m - base), 6) AS equal_mean, count(*) AS groups FROM g JOIN w USING (bin) WHERE arm <> 'view' GROUP BY arm HAVING count(*) = 3""")
def equal_group_gain(spark: SparkSession, d: str) -> DataFrame:
    """Mean gain with every group counting the same; only arms that all groups have."""
    g = scored(spark, d).groupBy((F.col("user_id") % 3).alias("bin"), "arm").agg(F.avg("score").alias("m"))
    w = g.groupBy("bin").agg(F.max(F.when(F.col("arm") == "view", F.col("m"))).alias("base"))
    rows = g.join(w, "bin").filter("arm <> 'view'").groupBy("arm").agg(F.round(F.avg(F.col("m") - F.col("base")), 6).alias("equal_mean"), F.count(F.lit(1)).alias("groups"))
    return rows.filter("groups = 3")


@query("""WITH u AS (SELECT user_id, user_id % 2 AS side, avg(value / (1 + value)) AS m, count(*) AS n, sum(value / (1 + value)) AS s FROM events GROUP BY user_id), t AS (SELECT side, sum(n) AS n, sum(s) / sum(n) AS m FROM u GROUP BY side),
    v AS (SELECT u.side, sum((s - u.n * t.m) * (s - u.n * t.m)) / (any_value(t.n) * any_value(t.n)) AS v FROM u JOIN t ON t.side = u.side GROUP BY u.side), g AS (SELECT count(*) AS g, sum(n) AS nn FROM u)
    SELECT round(a.m - b.m, 6) AS difference, round((a.m - b.m) / sqrt((va.v + vb.v) * g / (g - 1) * (nn - 1) / (nn - 2)), 4) AS t, g - 1 AS df FROM t a, t b, v va, v vb, g WHERE a.side = 1 AND b.side = 0 AND va.side = 1 AND vb.side = 0""")
def two_group_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two groups of users with the clustered variance of a regression on the group (its small-sample factor included)."""
    u = scored(spark, d).groupBy("user_id").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n")).withColumn("side", F.col("user_id") % 2)
    side = u.groupBy("side").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("g"))
    m = F.col("s") / F.col("n")
    side = side.withColumn("m", m).withColumn("v", (F.col("ss") - 2 * m * F.col("sn") + m * m * F.col("nn")) / (F.col("n") * F.col("n")))
    sign = F.when(F.col("side") == 1, 1).otherwise(-1)
    both = side.agg(F.sum(sign * F.col("m")).alias("d"), F.sum("v").alias("v"), F.sum("g").alias("g"), F.sum("n").alias("n"))
    t = F.col("d") / F.sqrt(F.col("v") * F.col("g") / (F.col("g") - 1) * (F.col("n") - 1) / (F.col("n") - 2))
    return both.select(F.round("d", 6).alias("difference"), F.round(t, 4).alias("t"), (F.col("g") - 1).alias("df"))


@query("""WITH p AS (SELECT user_id, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, count(*) / greatest(1, date_diff('second', min(ts), max(ts))) AS rate FROM events GROUP BY user_id)
    SELECT user_id, round(p50, 6) AS p50, round(p95, 6) AS p95, round(rate, 8) AS rate FROM p""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    second = lambda c: F.date_trunc("second", c).cast("timestamp").cast("bigint")
    seconds = second(F.max("ts")) - second(F.min("ts"))
    return table(spark, d, "events").groupBy("user_id").agg(
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"),
        F.round(F.count(F.lit(1)) / F.greatest(F.lit(1), seconds), 8).alias("rate"),
    )


@query("""WITH d AS (SELECT o_custkey, max(o_totalprice) AS price FROM orders GROUP BY o_custkey, o_orderdate) SELECT o_custkey, count(*) AS responses, round(sum(price), 2) AS cost FROM d GROUP BY o_custkey""")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Costs of distinct responses: repeated ones count once."""
    one = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("price"))
    return one.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("responses"), F.round(F.sum("price"), 2).alias("cost"))


@query("""WITH l AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL)
    SELECT source, min(n_chars) AS low, max(CASE WHEN k = n // 2 + 1 THEN n_chars END) AS median, max(CASE WHEN k = (9 * (n - 1)) // 10 + 1 THEN n_chars END) AS p90, max(n_chars) AS high FROM l GROUP BY source""")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank statistics of text lengths per source, from counts per length, so no group is sorted whole."""
    n = table(spark, d, "documents").filter("source is not null").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("source").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0)
    r = n.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("source")))
    at = lambda k: F.min(F.when(F.col("upto") >= F.expr(k), F.col("n_chars")))
    return r.groupBy("source").agg(F.min("n_chars").alias("low"), at("n div 2 + 1").alias("median"), at("(9 * (n - 1)) div 10 + 1").alias("p90"), F.max("n_chars").alias("high"))


@query("""WITH j AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events) SELECT k, count(*) AS n, round(sum(greatest(0.0, (value - 0.5 * k) / 100)), 6) AS score FROM j GROUP BY k""")
def plan_scores(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    return j.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.greatest(F.lit(0.0), (F.col("value") - 0.5 * F.col("k")) / 100)), 6).alias("score"))


@query("""SELECT result_id, CASE WHEN status = 'not_processed' THEN 'pending' WHEN status <> 'completed' THEN 'error' WHEN schema_version = 1 AND (assessment_plan_raw IS NULL OR trim(assessment_plan_raw) = '') THEN 'missing_generation'
    WHEN l.id IS NULL THEN 'missing_reference' WHEN l.n = 0 THEN 'skipped_no_recorded_plan' ELSE 'eligible' END AS state
    FROM results r LEFT JOIN (SELECT id, max(coalesce(len(plan), 0)) AS n FROM test_labels WHERE id IS NOT NULL GROUP BY id) l ON l.id = r.id""")
def scoring_states(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "test_labels").filter("id is not null").groupBy("id").agg(F.max(F.greatest(F.coalesce(F.size("plan"), F.lit(0)), F.lit(0))).alias("n")).withColumn("_known", F.lit(True))
    r = table(spark, d, "results").join(labels, "id", "left")
    blank = (F.col("schema_version") == 1) & (F.col("assessment_plan_raw").isNull() | (F.trim("assessment_plan_raw") == ""))
    state = (
        F.when(F.col("status") == "not_processed", "pending").when(F.col("status") != "completed", "error").when(blank, "missing_generation")
        .when(F.col("_known").isNull(), "missing_reference").when(F.col("n") == 0, "skipped_no_recorded_plan").otherwise("eligible")
    )
    return r.select("result_id", state.alias("state"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_name, id ORDER BY revision DESC, result_id DESC) AS k FROM results) SELECT run_name, id, result_id, revision, status FROM r WHERE k = 1""")
def results_latest_revision(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "results").select("run_name", "id", "revision", "result_id", "status")
    m = r.groupBy("run_name", "id").agg(F.max(F.struct("revision", "result_id", "status")).alias("m"))
    return m.select("run_name", "id", "m.result_id", "m.revision", "m.status")


def _tables(spark: SparkSession, d: str) -> ResultTables:
    return ResultTables(table(spark, d, "results"))


#: The model slots of all results in SQL: from variants, and one for each row without variants or with predictions or an evaluation of its own.
JSON_OF = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid({0} ->> '$') THEN CAST({0} ->> '$' AS JSON) ELSE {0} END"
SLOTS = rf"""vs AS (SELECT result_id, {JSON_OF.format("CAST(variants AS JSON)")} AS v FROM results WHERE trim(coalesce(variants, '')) <> '' AND json_valid(variants)),
    vk AS (SELECT result_id, v, unnest(json_keys(v)) AS variant, generate_subscripts(json_keys(v), 1) - 1 AS ordinal FROM vs WHERE json_type(v) = 'OBJECT'),
    pk AS (SELECT result_id, variant, unnest(json_keys(plans)) AS model, plans FROM (SELECT result_id, variant, json_extract(v, '$."' || variant || '".assessment_plans') AS plans FROM vk) WHERE json_type(plans) = 'OBJECT'),
    slots AS (SELECT result_id, variant, model, json_extract(plans, '$."' || model || '"') AS slot FROM pk
        UNION ALL SELECT result_id, '', '', json_object('status', status, 'predictions', CASE WHEN json_valid(predictions) THEN CAST(predictions AS JSON) END, 'evaluation', CASE WHEN json_valid(evaluation) THEN CAST(evaluation AS JSON) END)
            FROM results WHERE trim(coalesce(variants, '')) = '' OR trim(coalesce(predictions, '')) <> '' OR trim(coalesce(evaluation, '')) <> '')"""


def ranked_sql(name: str, field: str) -> str:
    """SQL: the entries of a list or an object of a slot with their rank."""
    return f"""{name}_l AS (SELECT result_id, variant, model, {JSON_OF.format("x")} AS x FROM (SELECT result_id, variant, model, json_extract(slot, '$.{field}') AS x FROM slots)),
    {name} AS (SELECT result_id, variant, model, CAST(coalesce(try_cast(json_extract_string(e, '$.rank') AS INTEGER), place) AS INTEGER) AS rank, e FROM (
        SELECT result_id, variant, model, i AS place, json_extract(x, '$[' || (i - 1) || ']') AS e FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(x) AS BIGINT))) AS i FROM {name}_l WHERE json_type(x) = 'ARRAY')
        UNION ALL SELECT result_id, variant, model, coalesce(try_cast(k AS INTEGER), i), json_extract(x, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(x)) AS k, generate_subscripts(json_keys(x), 1) AS i FROM {name}_l WHERE json_type(x) = 'OBJECT')))"""


SCALAR = "CASE WHEN json_type({0}) IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE {0} ->> '$' END"
PLANS = f"""{ranked_sql('p', 'predictions')}, pl AS (SELECT result_id, variant, model, rank, CASE WHEN json_type(x) = 'VARCHAR' AND substr(ltrim(x ->> '$'), 1, 1) IN ('[', '{{') AND json_valid(x ->> '$') THEN CAST(x ->> '$' AS JSON) ELSE x END AS x
        FROM (SELECT result_id, variant, model, rank, json_extract(e, '$.plan') AS x FROM p)),
    items AS (SELECT result_id, variant, model, rank, CAST(i AS INTEGER) AS step, json_extract(x, '$[' || (i - 1) || ']') AS item FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(x) AS BIGINT))) AS i FROM pl WHERE json_type(x) = 'ARRAY')
        UNION ALL SELECT result_id, variant, model, rank, 1, x FROM pl WHERE json_type(x) NOT IN ('ARRAY', 'NULL'))"""
METRICS = f"""{ranked_sql('en', 'evaluation')}, pa AS (SELECT result_id, variant, model, rank, part, json_extract(e, '$.' || part || '.metrics') AS ms FROM en, (VALUES ('condition'), ('plan')) t(part)),
    me AS (SELECT result_id, variant, model, rank, part, metric, json_extract(ms, '$."' || metric || '"') AS m FROM (SELECT *, unnest(json_keys(ms)) AS metric FROM pa WHERE json_type(ms) = 'OBJECT')),
    mv AS (SELECT * FROM me WHERE json_type(m) = 'OBJECT')"""


@query(f"WITH {SLOTS} SELECT result_id AS record, variant, CAST(ordinal AS INTEGER) AS ordinal FROM vk")
def p5_variants(spark: SparkSession, d: str) -> DataFrame:
    """Variants; the node numbers that link the tables are checked by p5_links."""
    return _tables(spark, d).variants().select("record", "variant", "ordinal")


@query(f"WITH {SLOTS} SELECT result_id AS record, variant, model, json_extract_string(slot, '$.status') AS status, {SCALAR.format("json_extract(slot, '$.error')")} AS error, json_extract_string(slot, '$.error.type') AS error_type FROM slots")
def p5_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).outputs().select("record", "variant", "model", "status", "error", "error_type")


@query(f"WITH {SLOTS}, {ranked_sql('p', 'predictions')} SELECT result_id AS record, variant, model, rank, {SCALAR.format("json_extract(e, '$.condition')")} AS condition FROM p")
def p5_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).predictions().select("record", "variant", "model", "rank", "condition")


@query(f"WITH {SLOTS}, {PLANS} SELECT result_id AS record, variant, model, rank, step, text FROM (SELECT *, CASE WHEN json_type(item) = 'OBJECT' THEN json_extract_string(item, '$.text') ELSE {SCALAR.format('item')} END AS text FROM items WHERE json_type(item) <> 'NULL') WHERE json_type(item) <> 'OBJECT' OR text IS NOT NULL")
def p5_plan_items(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).plan_items().select("record", "variant", "model", "rank", "step", "text")


@query(f"WITH {SLOTS}, {METRICS} SELECT result_id AS record, variant, model, rank, part, metric, json_extract_string(m, '$.status') AS status, try_cast(json_extract_string(m, '$.value') AS DOUBLE) AS value FROM mv")
def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).scores().select("record", "variant", "model", "rank", "part", "metric", "status", "value")


@query(f"""WITH {SLOTS}, {METRICS}, r AS (SELECT *, json_extract(m, '$.runs') AS runs FROM mv), j AS (SELECT *, CAST(i - 1 AS INTEGER) AS ordinal, json_extract(runs, '$[' || (i - 1) || ']') AS x FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(runs) AS BIGINT))) AS i FROM r WHERE json_type(runs) = 'ARRAY'))
    SELECT result_id AS record, variant, model, rank, part, metric, ordinal, json_extract_string(x, '$.judge') AS judge, try_cast(json_extract_string(x, '$.score') AS DOUBLE) AS score FROM j WHERE json_type(x) = 'OBJECT'""")
def p5_judge_scores(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).judge_scores().select("record", "variant", "model", "rank", "part", "metric", "ordinal", "judge", "score")


@query(f"""WITH {SLOTS}, {PLANS}, {METRICS} SELECT 'outputs' AS child, (SELECT count(*) FROM pk) AS n, 0 AS orphans UNION ALL SELECT 'predictions', (SELECT count(*) FROM p), 0
    UNION ALL SELECT 'plan_items', (SELECT count(*) FROM items WHERE json_type(item) <> 'NULL'), 0 UNION ALL SELECT 'scores', (SELECT count(*) FROM mv), 0""")
def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each child table that name a parent, and how many of them have none: the flat tables are linked by record, root and node."""
    t = _tables(spark, d)
    outputs, predictions = t.outputs(), t.predictions()
    pairs = (
        ("outputs", outputs.filter("variant_node is not null"), "variant_node", t.variants()), ("predictions", predictions, "slot_node", outputs),
        ("plan_items", t.plan_items(), "prediction_node", predictions), ("scores", t.scores(), "slot_node", outputs),
    )
    out = None
    for name, child, key, parent in pairs:
        up = parent.select("record", "root", F.col("node").alias(key), F.lit(True).alias("_p"))
        one = child.select("record", "root", key).join(up, ["record", "root", key], "left").agg(F.lit(name).alias("child"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("_p").isNull()).alias("orphans"))
        out = one if out is None else out.unionByName(one)
    return out


#: The variants with their JSON, and the slots with the fields of the row that SLOTS doesn't need.
OBJECT_OF = JSON_OF.format("CASE WHEN json_valid({0}) THEN CAST({0} AS JSON) END")
HELD = rf"""va AS (SELECT result_id, variant, json_extract(v, '$."' || variant || '"') AS x FROM vk),
    none AS (SELECT * FROM results WHERE trim(coalesce(variants, '')) = '' OR trim(coalesce(predictions, '')) <> '' OR trim(coalesce(evaluation, '')) <> ''),
    ns AS (SELECT result_id, variant, model, json_extract(plans, '$."' || model || '"') AS slot FROM pk)"""


@query(f"""WITH {SLOTS}, {HELD}, o AS (SELECT result_id, variant, json_extract(x, '$.assessment_plan_prompts') AS p FROM va UNION ALL SELECT result_id, '', {OBJECT_OF.format("assessment_plan_prompts")} FROM none)
    SELECT result_id AS record, variant, json_extract_string(p, '$.system') AS system, json_extract_string(p, '$.user') AS user FROM o WHERE json_type(p) = 'OBJECT'""")
def p5_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).prompts().select("record", "variant", "system", "user")


@query(f"""WITH {SLOTS}, {HELD} SELECT result_id AS record, variant, model, json_extract_string(slot, '$.assessment_plan_raw') AS raw FROM ns WHERE json_exists(slot, '$.assessment_plan_raw')
    UNION ALL SELECT result_id, '', '', assessment_plan_raw FROM none WHERE assessment_plan_raw IS NOT NULL""")
def p5_answers(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).answers().select("record", "variant", "model", "raw")


@query(f"""WITH {SLOTS}, {HELD}, r AS (SELECT result_id, variant, model, json_extract(slot, '$.model_responses') AS x FROM ns UNION ALL SELECT result_id, '', '', {OBJECT_OF.format("model_responses")} FROM none),
    l AS (SELECT result_id, variant, model, '' AS step, x FROM r WHERE json_type(x) = 'ARRAY' UNION ALL SELECT result_id, variant, model, k, json_extract(x, '$."' || k || '"') FROM (SELECT *, unnest(json_keys(x)) AS k FROM r WHERE json_type(x) = 'OBJECT')),
    c AS (SELECT *, i - 1 AS ordinal, json_extract(x, '$[' || (i - 1) || ']') AS e FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(x) AS BIGINT))) AS i FROM l WHERE json_type(x) = 'ARRAY'))
    SELECT result_id AS record, variant, model, step, CAST(ordinal AS INTEGER) AS ordinal, {', '.join(f"json_extract_string(e, '$.{k}') AS {k}" for k in ("reported_model", "response_id", "request_id"))},
    {', '.join(f"try_cast(json_extract_string(e, '$.token_usage.{k}') AS BIGINT) AS {k}" for k in ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens"))} FROM c WHERE json_type(e) = 'OBJECT'""")
def p5_responses(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).responses().drop("root", "node", "slot_node")


COMPONENTS = f"""co AS (SELECT result_id, variant, json_extract(x, '$.components') AS c FROM va UNION ALL SELECT result_id, '', {OBJECT_OF.format("components")} FROM results),
    ce AS (SELECT result_id, variant, name, json_extract(c, '$."' || name || '"') AS e FROM (SELECT *, unnest(json_keys(c)) AS name FROM co WHERE json_type(c) = 'OBJECT'))"""


@query(f"""WITH {SLOTS}, {HELD}, {COMPONENTS} SELECT result_id AS record, variant, name, json_extract_string(e, '$.component') AS component, json_extract_string(e, '$.status') AS status,
    try_cast(json_extract_string(e, '$.settings.top_k') AS BIGINT) AS top_k FROM ce WHERE json_type(e) = 'OBJECT'""")
def p5_components(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).components().drop("root", "node", "owner_node")


@query(f"""WITH {SLOTS}, {HELD}, {COMPONENTS}, k AS (SELECT result_id, variant, name, json_extract(e, '$.capture.retrieval_keywords') AS x FROM ce),
    w AS (SELECT *, json_extract(x, '$[' || (i - 1) || ']') AS word FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(x) AS BIGINT))) AS i FROM k WHERE json_type(x) = 'ARRAY'))
    SELECT result_id AS record, variant, name, CAST(i - 1 AS INTEGER) AS ordinal, word ->> '$' AS keyword FROM w WHERE json_type(word) NOT IN ('OBJECT', 'ARRAY', 'NULL')""")
def p5_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).keywords().drop("root", "node", "component_node")


@query(r"""WITH slots AS (
        SELECT result_id, '' AS variant, '' AS model, CAST(predictions AS JSON) AS p FROM results WHERE variants IS NULL AND predictions IS NOT NULL
        UNION ALL SELECT result_id, variant, model, json_extract(plans, '$."' || model || '".predictions') FROM (
            SELECT result_id, variant, plans, unnest(json_keys(plans)) AS model FROM (
                SELECT result_id, variant, json_extract(v, '$."' || variant || '".assessment_plans') AS plans FROM (
                    SELECT result_id, v, unnest(json_keys(v)) AS variant FROM (
                        SELECT result_id, CASE WHEN json_type(CAST(variants AS JSON)) = 'VARCHAR' THEN CAST(CAST(variants AS JSON) ->> '$' AS JSON) ELSE CAST(variants AS JSON) END AS v FROM results WHERE variants IS NOT NULL))))),
    lists AS (SELECT result_id, variant, model, CASE WHEN json_type(p) = 'VARCHAR' THEN CAST(p ->> '$' AS JSON) ELSE p END AS p FROM slots),
    ranked AS (
        SELECT result_id, variant, model, i AS rank, json_extract(p, '$[' || (i - 1) || '].plan') AS plan FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(p) AS BIGINT))) AS i FROM lists WHERE json_type(p) = 'ARRAY')
        UNION ALL SELECT result_id, variant, model, CAST(k AS BIGINT), json_extract(p, '$."' || k || '".plan') FROM (SELECT *, unnest(json_keys(p)) AS k FROM lists WHERE json_type(p) = 'OBJECT')),
    items AS (
        SELECT result_id, variant, model, rank, i AS step, json_extract(plan, '$[' || (i - 1) || ']') AS item FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(plan) AS BIGINT))) AS i FROM ranked WHERE json_type(plan) = 'ARRAY')
        UNION ALL SELECT result_id, variant, model, rank, 1, plan FROM ranked WHERE json_type(plan) = 'VARCHAR')
    SELECT DISTINCT result_id, variant, model, CAST(rank AS INTEGER) AS rank, CAST(step AS INTEGER) AS step FROM items WHERE json_type(item) <> 'NULL'""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    items = _tables(spark, d).plan_items()
    return items.selectExpr("record as result_id", "variant", "model", "rank", "step").distinct()


@query()
def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    """BLEU, ROUGE-1, -2, -L and a unigram METEOR of each subjective against the objective of the same record; formulas are tested on known pairs."""
    rows = table(spark, d, "test").filter("subjective is not null and objective is not null").select("id", F.col("subjective").alias("candidate"), F.col("objective").alias("reference"))
    return metrics.text_metrics(rows, "id", "candidate", "reference")
