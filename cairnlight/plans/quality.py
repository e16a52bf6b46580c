"""Leak and quality checks, and text serialization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlight.functions.dates import local_date
from cairnlight.functions.text import clean_text, condition_code, replace_terms, sub_phrases, without_tag
from cairnlight.operators.probes import confusion, grouped_probe, probe_counts
from cairnlight.plans.cohort import TARGET, cutoffs, day_sql, encounters, observations
from cairnlight.plans.registry import query
from cairnlight.session import table

NAMED = r"n AS (SELECT DISTINCT trim(lower(regexp_replace(reasondescription, '\s*\([^()]*\)\s*$', ''))) AS term FROM encounters WHERE reasondescription IS NOT NULL)"


@query(f"""WITH {NAMED} SELECT id, CASE WHEN lower(subjective) LIKE '%iron deficiency%' THEN 'description' WHEN lower(subjective) LIKE '%iron%' AND lower(subjective) LIKE '%deficiency%' THEN 'words' WHEN subjective LIKE '%{TARGET}%' THEN 'code' END AS leak
    FROM test WHERE lower(subjective) LIKE '%iron deficiency%' OR (lower(subjective) LIKE '%iron%' AND lower(subjective) LIKE '%deficiency%') OR subjective LIKE '%{TARGET}%'""")
def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    """First hit wins: the description, then all its words in any order, then the code."""
    low = F.lower("subjective")
    hit = F.when(F.contains(low, F.lit("iron deficiency")), "description").when(F.contains(low, F.lit("iron")) & F.contains(low, F.lit("deficiency")), "words").when(F.contains(F.col("subjective"), F.lit(TARGET)), "code")
    return table(spark, d, "test").select("id", hit.alias("leak")).filter("leak is not null")


@query(r"""WITH c AS (SELECT id, replace(regexp_replace(regexp_replace(regexp_replace(id, '_?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$', ''), '^nota_', ''), '^$', '~'), '_', ' ') AS term, string_split_regex(text, '[\r\n]+') AS lines FROM corpus WHERE text IS NOT NULL),
    l AS (SELECT id, term, unnest(lines) AS line FROM c) SELECT id, count(*) AS n FROM l WHERE contains(lower(line), term) GROUP BY id""")
def leak_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a serialised record that name its own condition."""
    term = F.regexp_replace(F.regexp_replace(condition_code("id"), "^$", "~"), "_", " ")
    lines = table(spark, d, "corpus").filter("text is not null").select("id", term.alias("term"), F.explode(F.split("text", "[\r\n]+")).alias("line"))
    return lines.filter(F.contains(F.lower("line"), F.col("term"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {NAMED}, w AS (SELECT term, string_split(term, ' ') AS w FROM n), r AS (SELECT term, unnest(generate_series(2, len(w))) AS k, w FROM w WHERE len(w) >= 2),
    s AS (SELECT term, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM r) SELECT DISTINCT term, phrase FROM s""")
def leak_phrases(spark: SparkSession, d: str) -> DataFrame:
    terms = encounters(spark, d).filter("reasondescription is not null").select(without_tag("reasondescription").alias("term")).distinct()
    return terms.select("term", F.explode(sub_phrases("term")).alias("phrase")).distinct()


@query("""SELECT id, count(*) FILTER (WHERE p LIKE 'Review in%') AS reviews, count(*) FILTER (WHERE p LIKE 'Start %') AS starts, count(*) FILTER (WHERE p IS NULL) AS nulls FROM (SELECT id, unnest(plan) AS p FROM test_labels WHERE id IS NOT NULL) GROUP BY id""")
def plan_keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "test_labels").filter("id is not null").select("id", F.explode("plan").alias("p"))
    return p.groupBy("id").agg(F.count_if(F.col("p").startswith("Review in")).alias("reviews"), F.count_if(F.col("p").startswith("Start ")).alias("starts"), F.count_if(F.col("p").isNull()).alias("nulls"))


@query("SELECT patient, bool_or(description ILIKE '%pressure%') AS pressure, bool_or(description = 'Ferritin') AS ferritin, count(DISTINCT code) AS codes FROM observations WHERE patient IS NOT NULL GROUP BY patient")
def review_indicators(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).filter("patient is not null").groupBy("patient").agg(
        F.bool_or(F.contains(F.lower("description"), F.lit("pressure"))).alias("pressure"), F.bool_or(F.col("description") == "Ferritin").alias("ferritin"), F.countDistinct("code").alias("codes")
    )


@query("SELECT count(*) AS n FROM (SELECT DISTINCT patient FROM encounters WHERE patient IS NOT NULL) WHERE patient NOT IN (SELECT patient FROM encounters WHERE reasoncode IS NOT NULL AND patient IS NOT NULL)")
def review_no_antecedent(spark: SparkSession, d: str) -> DataFrame:
    e = encounters(spark, d).filter("patient is not null")
    return e.select("patient").distinct().join(e.filter("reasoncode is not null").select("patient"), "patient", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT description, count(DISTINCT patient) AS patients FROM observations WHERE description IS NOT NULL GROUP BY description), r AS (SELECT patient, count(*) AS n FROM observations WHERE patient IS NOT NULL GROUP BY patient)
    SELECT description, patients, (SELECT quantile_cont(n, 0.5) FROM r) AS median_rows FROM d ORDER BY patients DESC, description LIMIT 40""")
def dataset_top_descriptions(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    top = o.filter("description is not null").groupBy("description").agg(F.countDistinct("patient").alias("patients")).orderBy(F.desc("patients"), "description").limit(40)
    median = o.filter("patient is not null").groupBy("patient").agg(F.count(F.lit(1)).alias("n")).agg(F.percentile("n", F.lit(0.5)).alias("median_rows"))
    return top.join(F.broadcast(median))


@query("""WITH l AS (SELECT id, min(lower(trim(condition, chr(9) || ' '))) AS condition FROM test_labels WHERE id IS NOT NULL GROUP BY id), t AS (SELECT t.id, condition, length(subjective) AS n FROM test t JOIN l USING (id) WHERE subjective IS NOT NULL AND condition IS NOT NULL),
    r AS (SELECT id, row_number() OVER (PARTITION BY condition ORDER BY id) AS a, row_number() OVER (ORDER BY n DESC, id) AS b, row_number() OVER (ORDER BY n, id) AS c FROM t) SELECT id FROM r WHERE a <= 2 OR b <= 3 OR c <= 1""")
def pilot_sample(spark: SparkSession, d: str) -> DataFrame:
    """Two records per condition, the three longest and the shortest: a bounded report, by top-k and not by a global window."""
    named = F.lower(F.regexp_replace("condition", r"^\s+|\s+$", ""))
    l = table(spark, d, "test_labels").filter("id is not null").groupBy("id").agg(F.min(named).alias("condition")).filter("condition is not null")
    t = table(spark, d, "test").filter("subjective is not null").select("id", F.char_length("subjective").alias("n")).join(l, "id")
    firsts = t.withColumn("a", F.row_number().over(Window.partitionBy("condition").orderBy("id"))).filter("a <= 2").select("id")
    return firsts.union(t.orderBy(F.desc("n"), "id").limit(3).select("id")).union(t.orderBy("n", "id").limit(1).select("id")).distinct()


@query(r"""WITH a AS (SELECT id, regexp_extract_all(coalesce(subjective, ''), '\d+') AS s, regexp_extract_all(coalesce(objective, ''), '\d+') AS o FROM test)
    SELECT id, len(list_distinct(list_filter(s, lambda x: NOT list_contains(o, x)))) AS unsupported FROM a""")
def quality_numbers(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct numbers of one text the other doesn't have."""
    numbers = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), 1)
    return table(spark, d, "test").select("id", F.size(F.array_except(numbers("subjective"), numbers("objective"))).alias("unsupported"))


@query("SELECT count(*) AS n FROM ((SELECT id, text FROM corpus EXCEPT SELECT id, text FROM corpus) UNION ALL (SELECT id, text FROM corpus EXCEPT SELECT id, text FROM corpus))")
def quality_reproducible(spark: SparkSession, d: str) -> DataFrame:
    """Rows that differ between two reads of a table, both ways; multisets are compared by hash counts, not by the texts."""
    side = lambda k: table(spark, d, "corpus").select(F.xxhash64("id", "text").alias("h"), F.lit(k).alias("k"))
    both = side(1).unionByName(side(-1)).groupBy("h").agg(F.sum("k").alias("n")).filter("n <> 0")
    return both.agg(F.count(F.lit(1)).alias("n"))


@query()
def text_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Texts with entities resolved and control characters dropped, and two terms replaced; compared with Python's html module in the tests."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(replace_terms(clean_text("text"), {"hay fever": "[CONDITION]", "fever": "[SIGN]"}).cast("binary")).alias("digest"))


@query(f"""WITH e AS (SELECT patient, string_agg(lower(description), '; ' ORDER BY d, code, id) AS history FROM (SELECT DISTINCT patient, id, code, description, {day_sql('start')} AS d FROM encounters WHERE patient IS NOT NULL) WHERE d IS NOT NULL GROUP BY patient)
    SELECT patient, 'HISTORY' || chr(10) || '- ' || replace(history, '; ', chr(10) || '- ') AS text FROM e""")
def serialize_history(spark: SparkSession, d: str) -> DataFrame:
    """One section of a serialised patient: a line per encounter, oldest first."""
    e = encounters(spark, d).filter("patient is not null").select("patient", "id", "code", F.lower("description").alias("t"), local_date("start").alias("d")).distinct().filter("d is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("d", "code", "id", "t"))), lambda s: F.concat(F.lit("- "), s["t"]))
    return e.groupBy("patient").agg(F.concat(F.lit("HISTORY\n"), F.array_join(lines, "\n")).alias("text"))


@query()
def probe_condition(spark: SparkSession, d: str) -> DataFrame:
    """Confusion table of a text probe (TF-IDF and balanced logistic regression, folds by patient): held-out predictions of the target against the rest."""
    counts = probe_counts(encounters(spark, d), observations(spark, d), cutoffs(spark, d))
    return confusion(grouped_probe(counts, "patient", "terms", "pairs", "label"), "label", "prediction")
