"""Generic relational operators over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlight.functions.text import condition_code, node_name, person_uuid
from cairnlight.plans.registry import query
from cairnlight.session import table

LINES = "l AS (SELECT o_custkey, o_orderkey, least(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS d, p_brand, l_returnflag, o_orderpriority, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
CUT = f"{LINES}, cut AS (SELECT o_custkey, min(d) AS cutoff FROM l WHERE p_brand = 'Brand#2' AND l_returnflag = 'R' GROUP BY o_custkey)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their order and part; d is the earlier of the two dates (a missing one is ignored)."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    return joined.withColumn("d", F.least(F.to_date("l_shipdate"), F.to_date("o_orderdate")))


def customer_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).filter("p_brand = 'Brand#2' and l_returnflag = 'R'").groupBy("o_custkey").agg(F.min("d").alias("cutoff"))


@query(f"WITH {CUT} SELECT o_custkey, cutoff FROM cut")
def customer_first_returns(spark: SparkSession, d: str) -> DataFrame:
    return customer_cutoffs(spark, d)


@query(f"WITH {CUT} SELECT p_type, o_orderpriority, count(*) AS n, count(DISTINCT l.o_custkey) AS customers FROM l JOIN cut ON cut.o_custkey = l.o_custkey AND d < cutoff GROUP BY ALL")
def customer_history_features(spark: SparkSession, d: str) -> DataFrame:
    before = lines(spark, d).join(customer_cutoffs(spark, d), "o_custkey").filter("d < cutoff")
    return before.groupBy("p_type", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def customers_with_large_orders(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def names_union(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return n.unionByName(table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


@query("SELECT p_brand FROM part EXCEPT SELECT p_brand FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity > 49.5")
def brands_except(spark: SparkSession, d: str) -> DataFrame:
    hit = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_quantity > 49.5").select(F.col("l_partkey").alias("p_partkey"))
    part = table(spark, d, "part")
    return part.select("p_brand").subtract(part.join(hit, "p_partkey").select("p_brand"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def nations_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT * FROM (SELECT o_custkey, o_orderpriority FROM orders EXCEPT ALL SELECT o_custkey, '5-LOW' FROM orders)")
def priorities_except_all(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_custkey", "o_orderpriority").exceptAll(o.select("o_custkey", F.lit("5-LOW").alias("o_orderpriority")))


@query("""WITH r AS (SELECT o_custkey, o_orderpriority, min(o_orderdate) AS d, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY d, k) AS seen FROM r GROUP BY o_custkey""")
def ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Values in the order they were first seen."""
    r = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("d"), F.min("o_orderkey").alias("k"))
    seen = F.array_sort(F.collect_list(F.struct("d", "k", "o_orderpriority")))
    return r.groupBy("o_custkey").agg(F.array_join(F.transform(seen, lambda s: s["o_orderpriority"]), ",").alias("seen"))


@query("""SELECT CASE WHEN p_size < 10 THEN '0-9' WHEN p_size < 20 THEN '10-19' WHEN p_size < 30 THEN '20-29' WHEN p_size < 40 THEN '30-39' ELSE '40+' END AS bin, count(*) AS n FROM part GROUP BY bin""")
def size_bins(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    b = F.when(s < 10, "0-9").when(s < 20, "10-19").when(s < 30, "20-29").when(s < 40, "30-39").otherwise("40+")
    return table(spark, d, "part").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY o_custkey), y AS (SELECT o_custkey, (year(d) - 1995) + (month(d) - 1) / 12.0 AS y FROM f)
    SELECT CASE WHEN y < 0.5 THEN 'a' WHEN y < 1 THEN 'b' WHEN y < 2 THEN 'c' WHEN y < 4 THEN 'd' ELSE 'e' END AS bin, count(*) AS n FROM y GROUP BY bin""")
def first_order_timing(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
    y = (F.year("d") - 1995) + (F.month("d") - 1) / 12.0
    b = F.when(y < 0.5, "a").when(y < 1, "b").when(y < 2, "c").when(y < 4, "d").otherwise("e")
    return f.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT s_suppkey, s_acctbal, avg(CASE WHEN s_acctbal <> 0 THEN s_acctbal END) OVER () AS m, stddev_pop(CASE WHEN s_acctbal <> 0 THEN s_acctbal END) OVER () AS sd FROM supplier) SELECT s_suppkey, round((s_acctbal - m) / sd, 6) AS z FROM x WHERE s_acctbal <> 0""")
def nonzero_z_scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").filter("s_acctbal <> 0")
    stats = s.agg(F.avg("s_acctbal").alias("m"), F.stddev_pop("s_acctbal").alias("sd"))
    return s.join(F.broadcast(stats)).select("s_suppkey", F.round((F.col("s_acctbal") - F.col("m")) / F.col("sd"), 6).alias("z"))


@query(r"""SELECT id, lower(coalesce(nullif(regexp_extract(id, '([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$', 1), ''), id)) AS person,
    regexp_replace(regexp_replace(id, '_?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$', ''), '^nota_', '') AS condition, upper(trim(source)) AS node FROM test""")
def id_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test").select("id", person_uuid("id").alias("person"), condition_code("id").alias("condition"), node_name("source").alias("node"))


@query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL) SELECT user_id, day, n, round(avg(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling FROM b""")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(-2, 0)
    return b.select("user_id", "day", "n", F.round(F.avg("v").over(w), 6).alias("rolling"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n")
    )


@query("""WITH e AS (SELECT user_id, min(ts) AS cutoff FROM events WHERE event_type = 'purchase' AND value > 150 GROUP BY user_id), b AS (SELECT user_id, min(ts) AS first FROM events GROUP BY user_id)
    SELECT b.user_id, cutoff IS NOT NULL AS positive, count(*) AS n FROM b LEFT JOIN e ON e.user_id = b.user_id JOIN events x ON x.user_id = b.user_id AND (cutoff IS NULL OR x.ts < cutoff) GROUP BY ALL""")
def event_history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cut = e.filter("event_type = 'purchase' and value > 150").groupBy("user_id").agg(F.min("ts").alias("cutoff"))
    kept = e.join(cut, "user_id", "left").filter("cutoff is null or ts < cutoff")
    return kept.groupBy("user_id", F.col("cutoff").isNotNull().alias("positive")).agg(F.count(F.lit(1)).alias("n"))
