"""Reviews: grids, summaries, verdicts, repairs, embeddings by field, manifests, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlight.functions.dates import local_date
from cairnlight.functions.stats import proportion_difference_ci
from cairnlight.functions.text import person_uuid
from cairnlight.functions.vectors import cosine
from cairnlight.operators import knowledge as K
from cairnlight.operators import review as R
from cairnlight.operators.components import connected_components
from cairnlight.operators.probes import grouped_classes
from cairnlight.plans.cohort import CUTOFFS, TARGET, cutoffs, day_sql, encounters, observations
from cairnlight.plans.knowledge import MERGES, edges, merges, nodes
from cairnlight.plans.registry import query
from cairnlight.plans.retrieval import BM, COS, E, bm25_scores, query_vector, vectors
from cairnlight.session import table, written


@query("""WITH v AS (SELECT user_id % 3 AS bin, event_type AS arm, CASE WHEN user_id % 7 <> 0 THEN value END AS x FROM events), g AS (SELECT bin, arm FROM (SELECT DISTINCT bin FROM v), (SELECT DISTINCT arm FROM v UNION SELECT 'refund'))
    SELECT g.bin, g.arm, count(x) AS n, count(*) FILTER (WHERE v.arm IS NOT NULL AND x IS NULL) AS missing, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(max(x), 6) AS max
    FROM g LEFT JOIN v ON v.bin = g.bin AND v.arm = g.arm GROUP BY ALL""")
def describe_grid(spark: SparkSession, d: str) -> DataFrame:
    """Statistics per bin and arm over the full grid, with counts of missing values; an arm that nobody has keeps its rows."""
    v = table(spark, d, "events").select((F.col("user_id") % 3).alias("bin"), F.col("event_type").alias("arm"), F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("x"))
    arms = v.select("arm").distinct().unionByName(spark.createDataFrame([("refund",)], "arm string"))
    grid = v.select("bin").distinct().join(F.broadcast(arms))  # names of a few bins and arms
    out = R.described(v, ["bin", "arm"], "x", grid)
    return out.select("bin", "arm", "n", "missing", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "max")])


@query(f"""WITH p AS (SELECT patient, min({day_sql('start')}) AS first, count(*) AS n FROM encounters WHERE patient IS NOT NULL GROUP BY patient), c AS (SELECT encounterclass AS kind, count(*) AS n FROM encounters GROUP BY 1)
    SELECT 'patients' AS what, count(*) * 1.0 AS value FROM p UNION ALL SELECT 'mean encounters', round(avg(n), 6) FROM p UNION ALL SELECT 'median years', median(2026 - year(first)) FROM p WHERE first IS NOT NULL
    UNION ALL SELECT 'oldest years', max(2026 - year(first)) FROM p UNION ALL SELECT 'class ' || coalesce(kind, 'none'), round(100.0 * n / (SELECT sum(n) FROM c), 6) FROM c""")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts, the share of each class of encounters and the spread of the years since the first one."""
    e = encounters(spark, d)
    p = e.filter("patient is not null").groupBy("patient").agg(F.min(local_date("start")).alias("first"), F.count(F.lit(1)).alias("n"))
    years = F.lit(2026) - F.year("first")
    one = p.agg(F.count(F.lit(1)).cast("double").alias("patients"), F.round(F.avg("n"), 6).alias("mean encounters"), F.percentile(years, F.lit(0.5)).alias("median years"), F.max(years).cast("double").alias("oldest years"))
    flat = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one.columns]), F.array(*[F.col(f"`{c}`") for c in one.columns]))).alias("what", "value"))
    kinds = e.groupBy(F.coalesce("encounterclass", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    share = kinds.join(F.broadcast(kinds.agg(F.sum("n").alias("_all")))).select(F.concat(F.lit("class "), "kind").alias("what"), F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("value"))
    return flat.unionByName(share)


LIVES = f"lives AS (SELECT patient, min({day_sql('start')}) AS born, max({day_sql('start')}) AS died, count(*) AS n FROM encounters WHERE patient IS NOT NULL GROUP BY patient)"


def lives(spark: SparkSession, d: str) -> DataFrame:
    day = local_date("start")
    return encounters(spark, d).filter("patient is not null").groupBy("patient").agg(F.min(day).alias("born"), F.max(day).alias("died"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {CUTOFFS}, {LIVES} SELECT l.patient, born, CASE WHEN cutoff IS NULL OR died < cutoff THEN died END AS died, CASE WHEN cutoff IS NULL THEN n END AS total FROM lives l LEFT JOIN cutoffs c ON c.patient = l.patient")
def rule_patient_projection(spark: SparkSession, d: str) -> DataFrame:
    """Patient rows as they were known at the cutoff: totals over the whole life are blanked, and so is an end on or after the cutoff."""
    l = lives(spark, d).join(cutoffs(spark, d), "patient", "left")
    return l.select("patient", "born", F.when(F.col("cutoff").isNull() | (F.col("died") < F.col("cutoff")), F.col("died")).alias("died"), F.when(F.col("cutoff").isNull(), F.col("n")).alias("total").cast("bigint").alias("total"))


@query(f"""WITH {CUTOFFS}, {LIVES}, s AS (SELECT DISTINCT e.patient, e.reasoncode AS pathology, year({day_sql('start')}) - year(born) AS age_begin, year({day_sql('stop')}) - year(born) AS age_end, year(cutoff) - year(born) AS cut
        FROM encounters e JOIN lives l ON l.patient = e.patient LEFT JOIN cutoffs c ON c.patient = e.patient WHERE e.reasoncode IS NOT NULL)
    SELECT patient, pathology, age_begin, CASE WHEN cut IS NULL OR age_end < cut THEN age_end END AS age_end FROM s WHERE pathology <> '{TARGET}' AND age_begin IS NOT NULL AND (cut IS NULL OR age_begin < cut)""")
def rule_symptom_ages(spark: SparkSession, d: str) -> DataFrame:
    """Rows dated by age only: the target's own rows go, those that begin at or after the age at the cutoff too, and later ends are blanked."""
    e = encounters(spark, d).filter("reasoncode is not null").join(lives(spark, d), "patient").join(cutoffs(spark, d), "patient", "left")
    age = lambda c: F.year(c) - F.year("born")
    rows = e.select("patient", F.col("reasoncode").alias("pathology"), age(local_date("start")).alias("age_begin"), age(local_date("stop")).alias("age_end"), age("cutoff").alias("cut")).distinct()
    kept = rows.filter((F.col("pathology") != TARGET) & F.col("age_begin").isNotNull() & (F.col("cut").isNull() | (F.col("age_begin") < F.col("cut"))))
    return kept.select("patient", "pathology", "age_begin", F.when(F.col("cut").isNull() | (F.col("age_end") < F.col("cut")), F.col("age_end")).alias("age_end"))


@query(f"""WITH {BM}, {E}, v AS (SELECT e.vec_id, {COS} AS c FROM e, (SELECT * FROM e WHERE vec_id = 0) q), cand AS (SELECT vec_id, c, coalesce(s.score, 0) AS k FROM v LEFT JOIN s ON s.doc_id = vec_id ORDER BY c DESC, vec_id LIMIT 50),
    m AS (SELECT vec_id, 0.6 * (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER () + 1e-8) + 0.4 * (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER () + 1e-8) AS score FROM cand)
    SELECT vec_id, round(score, 5) AS score FROM m ORDER BY score DESC, vec_id LIMIT 10""")
def hybrid_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Ten hits from five times as many dense candidates, dense and keyword scores scaled by the candidates' own smallest and largest."""
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, d)])
    dense = vectors(spark, d).select("vec_id", cosine(F.col("embedding"), q).alias("c")).orderBy(F.desc("c"), "vec_id").limit(50)
    cand = dense.join(bm25_scores(spark, d).select(F.col("doc_id").alias("vec_id"), F.col("score").alias("k")), "vec_id", "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    w = Window.partitionBy()  # fifty rows
    scaled = lambda c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-8)
    out = cand.select("vec_id", (0.6 * scaled("c") + 0.4 * scaled("k")).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)
    return out.select("vec_id", F.round("score", 5).alias("score"))


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS term FROM documents WHERE text IS NOT NULL), f AS (SELECT term, count(*) AS n FROM w GROUP BY term), t AS (SELECT count(*) AS t FROM documents),
    r AS (SELECT doc_id, w.term, round(ln(t / n), 4) AS score FROM w JOIN f USING (term), t), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM r)
    SELECT doc_id, count(*) AS terms, round(sum(score), 2) AS score, min(term) AS first FROM k WHERE rank <= 30 AND (score >= 3 OR rank <= 10) GROUP BY doc_id""")
def phrase_contributions(spark: SparkSession, d: str) -> DataFrame:
    """The dominant terms of each document by their contribution: those over a threshold, at least ten and at most thirty."""
    docs = table(spark, d, "documents")
    w = docs.filter("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), 1))).alias("term"))
    f = w.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    scored = w.join(f, "term").join(F.broadcast(docs.agg(F.count(F.lit(1)).alias("t")))).select("doc_id", "term", F.round(F.ln(F.col("t") / F.col("n")), 4).alias("score"))
    best = R.bounded_terms(scored, "doc_id", "term", "score", 3.0)
    return best.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("score"), 2).alias("score"), F.min("term").alias("first"))


@query("SELECT doc_id, 'top' AS how FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 15) UNION ALL SELECT doc_id, 'random' FROM (SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 15)")
def chunk_selection(spark: SparkSession, d: str) -> DataFrame:
    """The first fifteen units, and fifteen in the order of a hash: a sampling operator."""
    docs = table(spark, d, "documents").select("doc_id")
    top = docs.orderBy("doc_id").limit(15).withColumn("how", F.lit("top"))
    return top.unionByName(docs.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(15).withColumn("how", F.lit("random")))


@query("""WITH r AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM (SELECT DISTINCT id FROM test WHERE id IS NOT NULL)), s AS (SELECT id, place FROM r ORDER BY md5(id), id LIMIT 100) SELECT id, place, row_number() OVER (ORDER BY place) AS ordinal FROM s""")
def cohort_sample_in_order(spark: SparkSession, d: str) -> DataFrame:
    """A hundred records without replacement in the order of a hash, numbered in the order of the input again."""
    from cairnlight.operators.cohort import ordered_rank

    ids = table(spark, d, "test").filter("id is not null").select("id").distinct()
    placed = ordered_rank(ids, [], "id", "place")
    some = placed.orderBy(F.md5(F.col("id").cast("binary")), "id").limit(100)
    return some.withColumn("ordinal", F.row_number().over(Window.partitionBy().orderBy("place")))  # a hundred rows


@query(f"""WITH RECURSIVE {MERGES}, n AS (SELECT component, count(*) AS n FROM c GROUP BY component), big AS (SELECT component FROM n ORDER BY n DESC, component LIMIT 1),
    g AS (SELECT e.source, e.target, cs.component FROM e JOIN c cs ON cs.node = source),
    w AS (SELECT 'root' AS kind, '' AS part, source, target, 1 AS len FROM g UNION ALL SELECT 'leaf', '', source, target, 2 FROM g UNION ALL SELECT 'largest component', '', source, target, 1 FROM g WHERE component IN (SELECT component FROM big) UNION ALL SELECT 'weighted components', component, source, target, 1 FROM g),
    m AS (SELECT kind, part, count(*) AS m FROM w GROUP BY ALL), i AS (SELECT kind, part, count(*) AS w FROM w WHERE substr(source, 1, len) = substr(target, 1, len) GROUP BY ALL),
    k AS (SELECT kind, part, x, count(*) AS d FROM (SELECT kind, part, substr(source, 1, len) AS x FROM w UNION ALL SELECT kind, part, substr(target, 1, len) FROM w) GROUP BY ALL),
    q AS (SELECT m.kind, m.part, m.m, coalesce(i.w, 0) / m.m - (SELECT sum(pow(d / (2 * m.m), 2)) FROM k WHERE k.kind = m.kind AND k.part = m.part) AS q FROM m LEFT JOIN i ON i.kind = m.kind AND i.part = m.part)
    SELECT kind, round(sum(q * n) / sum(n), 6) AS modularity FROM (SELECT kind, q, CASE WHEN kind = 'weighted components' THEN (SELECT n FROM n WHERE n.component = part) ELSE 1 END AS n FROM q) GROUP BY kind""")
def graph_modularities(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the upper and the lower level of communities (here by the first one or two characters of a node), of the largest component, and of all components weighted by their nodes."""
    e = written(merges(spark, d))
    parts = written(connected_components(e, "source", "target"))
    member = lambda n: parts.select("node", F.substring("node", 1, n).alias("community"))
    big = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = e.join(parts.join(F.broadcast(big), "component", "left_semi").select(F.col("node").alias("source")), "source", "left_semi")
    each = K.modularity_by(e, member(1), parts.select("node", F.col("component").alias("part")))
    sizes = parts.groupBy(F.col("component").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    weighted = each.join(sizes, "part").agg((F.sum(F.col("modularity") * F.col("n")) / F.sum("n")).alias("modularity"))
    rows = [("root", K.modularity(e, member(1))), ("leaf", K.modularity(e, member(2))), ("largest component", K.modularity(inside, member(1))), ("weighted components", weighted)]
    out = None
    for kind, df in rows:
        one = df.select(F.lit(kind).alias("kind"), F.round("modularity", 6).alias("modularity"))
        out = one if out is None else out.unionByName(one)
    return out


WORDS_SQL = r"list_distinct(list_filter(list_transform(string_split_regex(replace(regexp_replace(lower({0}), '\s*\([^()]*\)\s*$', ''), '-', ' '), '\s+'), lambda w: regexp_replace(w, '^[.,;:()\[\]]+|[.,;:()\[\]]+$', '', 'g')), lambda w: length(w) >= 4))"


@query(rf"""WITH r AS (SELECT DISTINCT o.patient, o.description AS sign, e.reasoncode AS condition FROM observations o JOIN encounters e ON e.id = o.encounter WHERE o.patient IS NOT NULL AND o.description IS NOT NULL AND e.reasoncode IS NOT NULL),
    names AS (SELECT DISTINCT reasondescription || ' pressure' AS name FROM encounters WHERE reasoncode = '{TARGET}' AND reasondescription IS NOT NULL), t AS (SELECT DISTINCT unnest({WORDS_SQL.format('name')}) AS word FROM names),
    ours AS (SELECT sign, count(DISTINCT patient) AS patients FROM r WHERE condition = '{TARGET}' GROUP BY sign), sw AS (SELECT sign, unnest({WORDS_SQL.format('sign')}) AS word FROM ours),
    sh AS (SELECT sign, list_sort(list(DISTINCT word)) AS words FROM sw JOIN t USING (word) GROUP BY sign), oth AS (SELECT sign, count(DISTINCT condition) AS others FROM r WHERE condition <> '{TARGET}' GROUP BY sign)
    SELECT sign, patients, array_to_string(words, ',') AS words, coalesce(others, 0) AS others, CASE WHEN coalesce(others, 0) >= 3 THEN 'shared' WHEN coalesce(others, 0) = 0 THEN 'giveaway' ELSE 'ambiguous' END AS verdict
    FROM ours JOIN sh USING (sign) LEFT JOIN oth USING (sign)""")
def sign_overlap_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Signs of the target's patients that share a word with its names, and whether other conditions have them too."""
    e = encounters(spark, d).filter("id is not null and reasoncode is not null").select(F.col("id").alias("encounter"), F.col("reasoncode").alias("condition"))
    signs = observations(spark, d).filter("patient is not null and description is not null").select("patient", "encounter", F.col("description").alias("sign")).join(e, "encounter").select("patient", "sign", "condition").distinct()
    names = encounters(spark, d).filter((F.col("reasoncode") == TARGET) & F.col("reasondescription").isNotNull()).select(F.concat("reasondescription", F.lit(" pressure")).alias("name")).distinct()
    return R.overlap_verdicts(signs, F.col("condition") == TARGET, names, "patient", "sign", "condition").withColumn("words", F.array_join("words", ","))


@query("""WITH f AS (SELECT DISTINCT description AS feature FROM observations WHERE description IS NOT NULL UNION SELECT DISTINCT description FROM encounters WHERE description IS NOT NULL)
    SELECT feature, CASE WHEN lower(feature) LIKE '%ferritin%' OR lower(feature) LIKE '%iron%' THEN 'leak' WHEN lower(feature) LIKE '%pressure%' OR lower(feature) LIKE '%rate%' OR lower(feature) LIKE '%temperature%' THEN 'clinical' ELSE 'other' END AS class FROM f""")
def probe_feature_classes(spark: SparkSession, d: str) -> DataFrame:
    """Features of a probe as possible leaks, clinical findings or others, by signals in their names."""
    f = observations(spark, d).select(F.col("description").alias("feature")).unionByName(encounters(spark, d).select(F.col("description").alias("feature"))).filter("feature is not null").distinct()
    return f.select("feature", R.feature_class(F.col("feature"), ["ferritin", "iron"], ["pressure", "rate", "temperature"]).alias("class"))


@query("""WITH k AS (SELECT * FROM (VALUES ('blood', 'pressure'), ('blood', 'count'), ('weight', 'mass'), ('weight', 'weight'), ('heart', 'rate')) t(class, word))
    SELECT patient, class, count(DISTINCT code) AS codes FROM observations JOIN k ON contains(lower(description), word) WHERE patient IS NOT NULL GROUP BY ALL""")
def keyword_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes by keywords, several for a row where several fit: distinct codes of each patient and class. Descriptions meet the keywords once each, not row by row."""
    k = spark.createDataFrame([("blood", "pressure"), ("blood", "count"), ("weight", "mass"), ("weight", "weight"), ("heart", "rate")], "class string, word string")
    o = observations(spark, d).filter("patient is not null and description is not null").select("patient", "description", "code").distinct()
    names = o.select("description").distinct().join(F.broadcast(k), F.contains(F.lower("description"), F.col("word"))).select("description", "class").distinct()
    return o.join(names, "description").groupBy("patient", "class").agg(F.countDistinct("code").alias("codes"))


@query(f"""WITH r AS (SELECT patient, bool_or(description ILIKE '%pressure%') AS pressure, bool_or(description ILIKE '%creatinine%' OR description ILIKE '%kidney%') AS kidney, count(DISTINCT code) AS codes, count(DISTINCT category) AS categories,
        max(CASE WHEN description ILIKE '%pressure%' THEN try_cast(value AS DOUBLE) END) AS top_pressure, date_diff('day', min({day_sql('date')}), max({day_sql('date')})) AS span FROM observations WHERE patient IS NOT NULL GROUP BY patient)
    SELECT patient, pressure, kidney, codes, categories, top_pressure, span FROM r""")
def patient_indicators(spark: SparkSession, d: str) -> DataFrame:
    """One row of indicators per patient: classes, kidney signs, the highest pressure, distinct counts and the span in days."""
    low, day = F.lower("description"), local_date("date")
    has = lambda *w: F.greatest(*[F.contains(low, F.lit(x)) for x in (*w, w[0])])
    return observations(spark, d).filter("patient is not null").groupBy("patient").agg(
        F.bool_or(has("pressure")).alias("pressure"), F.bool_or(has("creatinine", "kidney")).alias("kidney"), F.countDistinct("code").alias("codes"), F.countDistinct("category").alias("categories"),
        F.max(F.when(has("pressure"), F.col("value").try_cast("double"))).alias("top_pressure"), F.date_diff(F.max(day), F.min(day)).alias("span"),
    )


@query(f"""WITH {CUTOFFS}, sub AS (SELECT DISTINCT patient FROM observations WHERE description ILIKE '%pressure%' AND patient IS NOT NULL), p AS (SELECT s.patient, c.patient IS NOT NULL AS pos FROM sub s LEFT JOIN cutoffs c ON c.patient = s.patient),
    h AS (SELECT DISTINCT e.patient, e.code FROM encounters e JOIN sub USING (patient) WHERE e.code IS NOT NULL), t AS (SELECT count(*) FILTER (WHERE pos) AS np, count(*) FILTER (WHERE NOT pos) AS nn FROM p),
    k AS (SELECT code, count(*) FILTER (WHERE pos) AS a, count(*) FILTER (WHERE NOT pos) AS b FROM h JOIN p USING (patient) GROUP BY code)
    SELECT code, a, b, round(a / np, 6) AS p_pos, round(b / nn, 6) AS p_neg, round(a / np - b / nn - 1.96 * sqrt(a / np * (1 - a / np) / np + b / nn * (1 - b / nn) / nn), 6) AS low FROM k, t WHERE np > 0 AND nn > 0""")
def subcohort_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates inside a part of the cohort (patients with a pressure reading), with the interval of their difference."""
    sub = observations(spark, d).filter("patient is not null").filter(F.contains(F.lower("description"), F.lit("pressure"))).select("patient").distinct()
    p = written(sub.join(cutoffs(spark, d).select("patient", F.lit(True).alias("_p")), "patient", "left").select("patient", F.coalesce("_p", F.lit(False)).alias("pos")))
    t = p.agg(F.count_if("pos").alias("np"), F.count_if(~F.col("pos")).alias("nn")).filter("np > 0 and nn > 0")
    k = encounters(spark, d).filter("code is not null").select("patient", "code").distinct().join(p, "patient").groupBy("code").agg(F.count_if("pos").alias("a"), F.count_if(~F.col("pos")).alias("b"))
    low, _ = proportion_difference_ci(F.col("a"), F.col("np"), F.col("b"), F.col("nn"))
    return k.join(F.broadcast(t)).select("code", "a", "b", F.round(F.col("a") / F.col("np"), 6).alias("p_pos"), F.round(F.col("b") / F.col("nn"), 6).alias("p_neg"), F.round(low, 6).alias("low"))


@query("""WITH r AS (SELECT code, encounterclass AS class, id, count(*) AS gates FROM encounters WHERE code IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY CASE class WHEN 'inpatient' THEN 2 WHEN 'emergency' THEN 1 ELSE 0 END DESC, gates DESC, id) AS k FROM r) SELECT code, class, gates, id FROM k WHERE k = 1""")
def best_row_per_code(spark: SparkSession, d: str) -> DataFrame:
    """The row of each code with the highest class, then the most entries, then the first id."""
    r = encounters(spark, d).filter("code is not null and id is not null").groupBy("code", F.col("encounterclass").alias("class"), "id").agg(F.count(F.lit(1)).alias("gates"))
    rank = F.when(F.col("class") == "inpatient", 2).when(F.col("class") == "emergency", 1).otherwise(0)
    return R.best_per_code(r, "code", rank, F.col("gates"), "id").select("code", "class", "gates", "id")


@query("""WITH i AS (SELECT id, row_number() OVER (ORDER BY id) AS ordinal FROM (SELECT DISTINCT id FROM test WHERE id IS NOT NULL)), l AS (SELECT DISTINCT id FROM test_labels WHERE id IS NOT NULL AND condition IS NOT NULL)
    SELECT 'kept' AS what, ordinal, i.id FROM i JOIN l USING (id) UNION ALL SELECT 'dropped', count(*), NULL FROM (SELECT id FROM l WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT id FROM l UNION ALL SELECT id FROM l)""")
def output_repair(spark: SparkSession, d: str) -> DataFrame:
    """Output lines, each three times: whole, cut off, and with a field too many; those for unknown ids and all but the first whole one go, the rest is put into input order."""
    from cairnlight.operators.cohort import ordered_rank

    ids = table(spark, d, "test").filter("id is not null").select("id").distinct()
    inputs = written(ordered_rank(ids, [], "id", "ordinal"))
    l = table(spark, d, "test_labels").filter("id is not null and condition is not null").groupBy("id").agg(F.min("condition").alias("condition"))
    whole = F.to_json(F.struct("id", "condition"))
    lines = l.select("id", F.explode(F.array(F.struct(F.lit("a").alias("k"), whole.alias("line")), F.struct(F.lit("b").alias("k"), F.expr("substring(to_json(struct(id, condition)), 1, 20)").alias("line")), F.struct(F.lit("c").alias("k"), F.to_json(F.struct("id", "condition", F.lit("x").alias("more"))).alias("line")))).alias("x"))
    outputs = written(lines.select(F.concat("id", F.lit(" "), "x.k").alias("place"), "x.line"))
    kept, dropped = R.repaired(outputs, inputs, "line", "place", ["id", "condition"])
    return kept.select(F.lit("kept").alias("what"), "ordinal", "id").unionByName(dropped.agg(F.lit("dropped").alias("what"), F.count(F.lit(1)).alias("ordinal"), F.lit(None).cast("string").alias("id")))


@query("""WITH a AS (SELECT DISTINCT id FROM test WHERE id IS NOT NULL), b AS (SELECT id, count(*) AS n FROM test_labels WHERE id IS NOT NULL GROUP BY id)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'unknown' WHEN n > 1 THEN 'repeated' ELSE 'fine' END AS state FROM a FULL JOIN b ON a.id = b.id""")
def output_id_states(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a conversion's output against its input: missing, unknown, repeated or fine."""
    a = table(spark, d, "test").filter("id is not null").select("id").distinct().withColumn("_a", F.lit(True))
    b = table(spark, d, "test_labels").filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("_a").isNull(), "unknown").when(F.col("n") > 1, "repeated").otherwise("fine")
    return a.join(b, "id", "full_outer").select("id", state.alias("state"))


def toy_encoder(texts: list[str]) -> list[list[float]]:
    """Letter counts: stands for a model, which is given from outside."""
    return [[float(len(t)), float(t.count("a")), float(t.count("e"))] for t in texts]


FIELDS = ("document.text", "corpus.text", "entity.description")


@query("""SELECT 'document.text' AS field, CAST(doc_id AS VARCHAR) AS id, length(text) AS n, length(text) - length(replace(text, 'a', '')) AS a FROM documents
    UNION ALL SELECT 'entity.description', code, length(t), length(t) - length(replace(t, 'a', '')) FROM (SELECT code, max(description) AS t FROM observations WHERE code IS NOT NULL GROUP BY code)""")
def embedded_fields(spark: SparkSession, d: str) -> DataFrame:
    """Two of three known text fields embedded in batches by an encoder given from outside: the first two numbers of each vector."""
    entities = observations(spark, d).filter("code is not null").groupBy("code").agg(F.max("description").alias("t"))
    fields = {
        "document.text": (table(spark, d, "documents"), F.col("doc_id"), F.col("text")), "corpus.text": (table(spark, d, "corpus"), F.col("id"), F.col("text")), "entity.description": (entities, F.col("code"), F.col("t")),
    }
    got = R.embedded(R.field_texts(fields, ["document.text", "entity.description"]), toy_encoder)
    return got.select("field", "id", F.col("vector")[0].cast("bigint").alias("n"), F.col("vector")[1].cast("bigint").alias("a"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS n FROM documents WHERE source IS NOT NULL""")
def embedded_after_update(spark: SparkSession, d: str) -> DataFrame:
    """Only texts that are new or changed are embedded again; the vectors of the others are kept."""
    docs = table(spark, d, "documents").filter("source is not null").select(F.lit("document.text").alias("field"), F.col("doc_id").cast("string").alias("id"), "text", "lang")
    old = written(R.embedded(docs.filter("lang = 'en'").drop("lang"), toy_encoder).select("field", "id", "vector"))
    todo = docs.drop("lang").join(old.select("field", "id"), ["field", "id"], "left_anti")
    merged = old.unionByName(R.embedded(todo, toy_encoder).select("field", "id", "vector"))
    return merged.select("id", F.col("vector")[0].cast("bigint").alias("n"))


@query("SELECT name, rows, TRUE AS same FROM (SELECT 'corpus' AS name, count(*) AS rows FROM corpus UNION ALL SELECT 'dev', count(*) FROM dev UNION ALL SELECT 'test', count(*) FROM test)")
def release_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Rows and content hash of the tables of a release, and whether another order of the rows has the same hash."""
    names = ("test", "dev", "corpus")
    one = R.manifest({n: table(spark, d, n) for n in names})
    two = R.manifest({n: table(spark, d, n).repartition(7) for n in names})
    return one.join(two.select("name", F.col("digest").alias("_d")), "name").select("name", "rows", (F.col("digest") == F.col("_d")).alias("same"))


@query("""WITH m AS (SELECT DISTINCT encounter AS unit, code AS title FROM observations WHERE encounter IS NOT NULL AND code IS NOT NULL), e AS (SELECT a.title AS s, b.title AS t FROM m a JOIN m b ON a.unit = b.unit AND a.title < b.title GROUP BY ALL)
    SELECT 'node' AS kind, count(DISTINCT title) AS n FROM m UNION ALL SELECT 'edge', count(*) FROM e UNION ALL SELECT 'frame', 6""")
def graphml_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The graph of codes as GraphML lines, in order: how many of each kind."""
    lines = R.graphml_lines(nodes(spark, d), edges(spark, d))
    kind = F.when(F.col("line").startswith("<node "), "node").when(F.col("line").startswith("<edge "), "edge").otherwise("frame")
    return lines.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'nation' AS index, n_nationkey AS own, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region UNION ALL SELECT 'supplier', CAST(s_suppkey AS BIGINT), CAST(s_suppkey AS VARCHAR) FROM supplier")
def multi_index_back(spark: SparkSession, d: str) -> DataFrame:
    """Records of a merged context (numbers shifted by the largest number before) mapped back to the index they came from and their own number."""
    sides = [
        ("nation", table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) as number", "n_name as name")), ("region", table(spark, d, "region").selectExpr("cast(r_regionkey as bigint) as number", "r_name as name")),
        ("supplier", table(spark, d, "supplier").selectExpr("cast(s_suppkey as bigint) as number", "cast(s_suppkey as string) as name")),
    ]
    merged, offsets, low = None, [], 0
    for index, df in sides:
        top = (df.agg(F.max("number")).first()[0] or 0) + 1
        moved = df.withColumn("number", F.col("number") + low)
        merged = moved if merged is None else merged.unionByName(moved)
        offsets.append((index, low, low + top))
        low += top
    return R.mapped_back(merged, spark.createDataFrame(offsets, "index string, low bigint, high bigint")).select("index", "own", "name")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(id, person, label) of test ids with a condition, one each."""
    named = F.lower(F.regexp_replace("condition", r"^\s+|\s+$", ""))
    l = table(spark, d, "test_labels").filter("id is not null").groupBy("id").agg(F.min(named).alias("label"), F.bool_or(F.coalesce("has_presenting_evidence", F.lit(False))).alias("evidence"))
    return l.filter("label is not null").withColumn("person", F.lower(person_uuid("id")))


LABELLED = r"""l AS (SELECT id, min(lower(regexp_replace(condition, '^\s+|\s+$', '', 'g'))) AS label FROM test_labels WHERE id IS NOT NULL GROUP BY id), t AS (SELECT DISTINCT id FROM test WHERE id IS NOT NULL)"""
PROBED = f"WITH {LABELLED} SELECT label, count(*) AS n, TRUE AS held_out FROM l JOIN t USING (id) WHERE label IS NOT NULL GROUP BY label"


def probe_result(predicted: DataFrame) -> DataFrame:
    """Per class: how many rows were predicted by a model that hasn't seen their person."""
    return predicted.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction").isNotNull()).alias("held_out"))


def text_rows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "test").filter("id is not null").groupBy("id").agg(F.max("subjective").alias("s"), F.max("objective").alias("o"))
    return labelled(spark, d).join(t, "id")


@query(PROBED)
def probe_shape(spark: SparkSession, d: str) -> DataFrame:
    """Can the condition be told from the shape of the texts alone (lengths, lines, digits, words)?"""
    r = text_rows(spark, d).withColumns({c: F.coalesce(c, F.lit("")) for c in ("s", "o")})
    of = lambda c: [F.char_length(c), F.size(F.split(c, r"\n")), F.char_length(F.regexp_replace(c, r"\D", "")), F.size(F.split(c, r"\s+"))]
    return probe_result(grouped_classes(r.withColumn("x", F.array(*[F.ln(v + F.lit(1.0)) for c in ("s", "o") for v in of(c)])), "person", "label", "x"))


@query(PROBED)
def probe_signs(spark: SparkSession, d: str) -> DataFrame:
    """The condition from signs and readings: which of twenty frequent words of the findings stand in them, and the numbers' mean."""
    r = text_rows(spark, d).withColumn("low", F.lower(F.coalesce("o", F.lit(""))))
    words = r.select(F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("([a-z]{5,})"), 1))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(20)
    names = [x["w"] for x in words.collect()]  # the twenty most frequent
    numbers = F.transform(F.regexp_extract_all("low", F.lit(r"(\d+)"), 1), lambda x: F.least(x.try_cast("double"), F.lit(1e6)))
    mean = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.greatest(F.size(numbers), F.lit(1))
    flags = [F.contains("low", F.lit(w)).cast("double") for w in names]
    return probe_result(grouped_classes(r.withColumn("x", F.array(F.ln(mean + 1), *flags)), "person", "label", "x"))


@query(PROBED)
def probe_shortcuts(spark: SparkSession, d: str) -> DataFrame:
    """The condition from what says nothing about it: number of encounters, years of history, years since the first one."""
    l = lives(spark, d).select(F.lower("patient").alias("person"), "born", "died", "n").groupBy("person").agg(F.min("born").alias("born"), F.max("died").alias("died"), F.sum("n").alias("n"))
    r = labelled(spark, d).join(table(spark, d, "test").filter("id is not null").select("id").distinct(), "id").join(l, "person", "left")
    x = [F.ln(F.coalesce("n", F.lit(0)) + F.lit(1.0)), F.coalesce(F.year("died") - F.year("born"), F.lit(0)).cast("double"), F.coalesce(F.lit(2026) - F.year("born"), F.lit(0)).cast("double")]
    return probe_result(grouped_classes(r.withColumn("x", F.array(*x)), "person", "label", "x"))


@query(PROBED)
def probe_presence(spark: SparkSession, d: str) -> DataFrame:
    """The condition from one flag: whether there is presenting evidence."""
    r = labelled(spark, d).join(table(spark, d, "test").filter("id is not null").select("id").distinct(), "id")
    return probe_result(grouped_classes(r.withColumn("x", F.array(F.col("evidence").cast("double"))), "person", "label", "x"))
