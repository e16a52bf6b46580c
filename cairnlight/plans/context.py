"""Search contexts, hierarchies, parsers and record rules over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlight.functions import parsing
from cairnlight.functions.dates import local_date
from cairnlight.functions.text import person_uuid, without_tag
from cairnlight.functions.vectors import cosine, mean_vector, unit
from cairnlight.operators import context as X
from cairnlight.operators import knowledge as K
from cairnlight.plans.cohort import TARGET, cutoffs, day_sql, encounters, observations
from cairnlight.plans.knowledge import EDGES, edges, mentions, merges, nodes
from cairnlight.plans.registry import UNESCAPED, query
from cairnlight.plans.retrieval import COS, E, query_vector, vectors
from cairnlight.session import table, written


@query(f"""WITH {EDGES}, s AS (SELECT title, row_number() OVER (ORDER BY frequency DESC, title) AS place FROM nodes ORDER BY frequency DESC, title LIMIT 6),
    rel AS (SELECT source, target, weight, CAST(ceil(log2(weight + 1)) AS BIGINT) AS cost FROM edges), u AS (SELECT unit, title, CAST(20 AS BIGINT) AS cost FROM m),
    rep AS (SELECT CASE WHEN title < '93' THEN 0 ELSE 1 END AS community, title, CAST(40 AS BIGINT) AS cost FROM nodes), ent AS (SELECT title, CAST(10 AS BIGINT) AS cost FROM nodes),
    a AS (SELECT 'report' AS part, CAST(community AS VARCHAR) AS id, cost, sum(cost) OVER (ORDER BY n DESC, community) AS run, 100 AS cap FROM (SELECT community, count(DISTINCT title) AS n, max(cost) AS cost FROM rep WHERE title IN (SELECT title FROM s) GROUP BY community)),
    e AS (SELECT 'entity' AS part, title AS id, cost, sum(cost) OVER (ORDER BY place, title) AS run, 100 AS cap FROM ent JOIN s USING (title)),
    net AS (SELECT *, CASE WHEN source IN (SELECT title FROM s) AND target IN (SELECT title FROM s) THEN 'in' ELSE 'out' END AS network FROM rel WHERE source IN (SELECT title FROM s) OR target IN (SELECT title FROM s)),
    r AS (SELECT 'relationship' AS part, source || '~' || target AS id, cost, sum(cost) OVER (ORDER BY network, weight DESC, source || '~' || target ROWS UNBOUNDED PRECEDING) AS run, 100 AS cap FROM net),
    t AS (SELECT DISTINCT unnest([source, target]) AS title FROM net), l AS (SELECT unit, count(DISTINCT title) AS links FROM u WHERE title IN (SELECT title FROM t) GROUP BY unit),
    f AS (SELECT unit, min(place) AS place, max(cost) AS cost, any_value(links) AS links FROM u JOIN s USING (title) JOIN l USING (unit) GROUP BY unit),
    w AS (SELECT 'unit' AS part, unit AS id, cost, sum(cost) OVER (ORDER BY place, links DESC, unit ROWS UNBOUNDED PRECEDING) AS run, 200 AS cap FROM f),
    x AS (SELECT * FROM a UNION ALL SELECT * FROM e UNION ALL SELECT * FROM r UNION ALL SELECT * FROM w) SELECT part, id, cost FROM x WHERE run <= cap""")
def search_local_context(spark: SparkSession, d: str) -> DataFrame:
    n = written(nodes(spark, d))
    top = n.orderBy(F.desc("frequency"), "title").limit(6)
    selected = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("frequency"), "title"))).select("title", "place")
    e = written(edges(spark, d)).withColumn("cost", F.ceil(F.log2(F.col("weight") + 1)))
    big = lambda k: F.lit(k).cast("bigint").alias("cost")
    units = mentions(spark, d).distinct().select("unit", "title", big(20))
    reports = n.select(F.when(F.col("title") < "93", 0).otherwise(1).alias("community"), "title", big(40))
    return X.local_context(n.select("title", big(10)), e, units, reports, written(selected), 400)


@query(f"""WITH {E}, b AS (SELECT e.vec_id, {COS} AS score FROM e, (SELECT * FROM e WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 20),
    r AS (SELECT doc_id, n_chars // 4 AS cost, sum(n_chars // 4) OVER (ORDER BY score DESC, vec_id ROWS UNBOUNDED PRECEDING) AS run FROM b JOIN documents ON doc_id = vec_id) SELECT doc_id, cost FROM r WHERE run <= 3000""")
def search_basic_context(spark: SparkSession, d: str) -> DataFrame:
    """Vector top-k of text units, then the prefix that fits the budget."""
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, d)])
    best = vectors(spark, d).select("vec_id", cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)
    units = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.expr("n_chars div 4").alias("cost"))
    rows = best.join(units, "vec_id").withColumn("g", F.lit(0))
    return K.budget_prefix(rows, ["g"], [F.desc("score"), F.col("vec_id")], "cost", 3000).select(F.col("vec_id").alias("doc_id"), "cost")


@query("""WITH r AS (SELECT source AS point, count(*) AS n, sum(n_chars) % 97 AS score FROM documents WHERE source IS NOT NULL GROUP BY source), k AS (SELECT *, sum(10) OVER (ORDER BY score DESC, point) AS run FROM r WHERE score > 0) SELECT point, score FROM k WHERE run <= 50""")
def search_global_points(spark: SparkSession, d: str) -> DataFrame:
    """Map-reduce of a global search with a stand-in for the model's rating: a number from the sizes."""
    r = table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.sum("n_chars") % 97).alias("score"))
    scores = written(r.select("source", "score"))
    rate = lambda b: b.join(scores, "source").select("batch", F.col("source").alias("point"), "score", F.lit(10).alias("cost"))
    return X.global_points(scores.withColumn("cost", F.lit(30)), "source", "cost", 60, rate, 50).select("point", "score")


@query(f"""WITH {EDGES}, b AS (SELECT source AS a, target AS action, CAST(weight AS DOUBLE) AS w FROM edges UNION ALL SELECT target, source, weight FROM edges),
    s0 AS (SELECT title AS action, CAST(frequency AS DOUBLE) AS score FROM nodes ORDER BY frequency DESC, title LIMIT 4), c1 AS (SELECT action FROM s0 ORDER BY score DESC, action LIMIT 3),
    f1 AS (SELECT b.action, max(w) AS score FROM b JOIN c1 ON b.a = c1.action WHERE b.action NOT IN (SELECT action FROM s0) GROUP BY b.action),
    s1 AS (SELECT action, score, action IN (SELECT action FROM c1) AS answered, 0 AS depth FROM s0 UNION ALL SELECT action, score, FALSE, 1 FROM f1), c2 AS (SELECT action FROM s1 WHERE NOT answered ORDER BY score DESC, action LIMIT 3),
    f2 AS (SELECT b.action, max(w) AS score FROM b JOIN c2 ON b.a = c2.action WHERE b.action NOT IN (SELECT action FROM s1) GROUP BY b.action)
    SELECT action, score, answered OR action IN (SELECT action FROM c2) AS answered, depth FROM s1 UNION ALL SELECT action, score, FALSE, 2 FROM f2""")
def search_drift(spark: SparkSession, d: str) -> DataFrame:
    """Follow-ups are the neighbours in the graph of codes, scored by weight: two rounds of the best three."""
    e = written(edges(spark, d))
    both = written(e.select(F.col("source").alias("a"), F.col("target").alias("action"), "weight").union(e.select("target", "source", "weight")))
    start = nodes(spark, d).orderBy(F.desc("frequency"), "title").limit(4).select(F.col("title").alias("action"), F.col("frequency").cast("double").alias("score"))
    follow = lambda chosen, n: both.join(chosen.withColumnRenamed("action", "a"), "a").groupBy("action").agg(F.max("weight").cast("double").alias("score"))
    return X.drift_search(start, follow, 2, 3)


@query("""WITH d AS (SELECT source, coalesce(lang, 'none') AS lang, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL), s AS (SELECT sum(n) AS s FROM d),
    t AS (SELECT source AS community, NULL AS parent, 0 AS level, sum(n) * 100 // any_value(s) AS rating FROM d, s GROUP BY source UNION ALL SELECT source || '/' || lang, source, 1, n * 100 // s FROM d, s),
    a AS (SELECT community FROM t WHERE level = 0 AND rating >= 3), b AS (SELECT community, parent FROM t WHERE level = 1 AND rating >= 3 AND parent IN (SELECT community FROM a))
    SELECT community FROM a WHERE community NOT IN (SELECT parent FROM b) UNION ALL SELECT community FROM b""")
def search_dynamic_selection(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents and, below them, their languages, rated by their share in percent: relevant ones are replaced by their relevant children."""
    n = written(table(spark, d, "documents").filter("source is not null").groupBy("source", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("n")))
    total = F.broadcast(n.agg(F.sum("n").alias("s")))
    top = n.groupBy(F.col("source").alias("community")).agg(F.sum("n").alias("n")).withColumns({"parent": F.lit(None).cast("string"), "level": F.lit(0)})
    low = n.select(F.concat("source", F.lit("/"), "lang").alias("community"), "n", F.col("source").alias("parent"), F.lit(1).alias("level"))
    t = top.unionByName(low).join(total).select("community", "parent", "level", F.expr("n * 100 div s").alias("rating"))
    return X.selected_communities(written(t), "rating", 3)


@query("""WITH r AS (SELECT source AS community, doc_id AS item, n_chars AS rank, n_chars // 4 AS cost FROM documents WHERE source IS NOT NULL), t AS (SELECT community, sum(cost) AS cost FROM r GROUP BY community),
    l AS (SELECT *, sum(cost) OVER (PARTITION BY community ORDER BY rank DESC, item ROWS UNBOUNDED PRECEDING) AS run FROM r WHERE community IN (SELECT community FROM t WHERE cost > 9000) AND community <> 'progress_note')
    SELECT community, 'valid' AS kind, cost FROM t WHERE cost <= 9000 UNION ALL SELECT community, 'trimmed', sum(cost) FROM l WHERE run <= 9000 GROUP BY community
    UNION ALL SELECT community, 'substituted', 700 FROM t WHERE community = 'progress_note' AND cost > 9000""")
def context_levels(spark: SparkSession, d: str) -> DataFrame:
    """Contexts over a budget: one community has finished reports below it, the others are trimmed."""
    r = table(spark, d, "documents").filter("source is not null").select(F.col("source").alias("community"), F.col("doc_id").alias("item"), F.col("n_chars").alias("rank"), F.expr("n_chars div 4").alias("cost"))
    reports = spark.createDataFrame([("a", 400), ("b", 300), ("c", 8500)], "community string, cost bigint")
    parents = spark.createDataFrame([("a", "progress_note"), ("b", "progress_note")], "community string, parent string")
    return X.level_contexts(r, reports, parents, 9000)


@query("""WITH a AS (SELECT n_nationkey AS community, CASE WHEN n_nationkey % 4 = 0 THEN -1 ELSE n_nationkey END AS number, n_name AS id FROM nation), b AS (SELECT r_regionkey AS community, CASE WHEN r_regionkey = 0 THEN -1 ELSE r_regionkey END AS number, r_name AS id FROM region)
    SELECT number, id || '-n' AS id, 'n' AS index FROM a UNION ALL SELECT CASE WHEN number = -1 THEN -1 ELSE number + (SELECT max(number) + 1 FROM a) END, id || '-r', 'r' FROM b""")
def multi_index_offsets(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").selectExpr("if(n_nationkey % 4 = 0, -1, n_nationkey) as number", "n_name as id")
    b = table(spark, d, "region").selectExpr("if(r_regionkey = 0, -1, r_regionkey) as number", "r_name as id")
    return X.shifted_indexes([("n", a), ("r", b)], "number", "id")


@query("""SELECT '-----Regions-----' || chr(10) || 'r_regionkey|r_name' || chr(10) || string_agg(r_regionkey || '|' || r_name, chr(10) ORDER BY r_regionkey) AS context FROM region""")
def context_rendering(spark: SparkSession, d: str) -> DataFrame:
    return X.context_table(table(spark, d, "region"), "Regions", ["r_regionkey", "r_name"], [F.col("r_regionkey")])


@query("""SELECT encounter AS unit, upper(description) AS title, min(upper(coalesce(category, 'none'))) AS type FROM observations WHERE encounter IS NOT NULL AND description IS NOT NULL GROUP BY ALL""")
def parse_entity_tuples(spark: SparkSession, d: str) -> DataFrame:
    """Tuples as an extraction model writes them, made from the observations and parsed again."""
    t = F.concat(F.lit('("entity"<|>'), F.lower("description"), F.lit("<|>"), F.coalesce("category", F.lit("none")), F.lit("<|>"), F.coalesce("code", F.lit("")), F.lit(")"))
    rows = observations(spark, d).filter("encounter is not null and description is not null").groupBy(F.col("encounter").alias("unit")).agg(F.concat(F.array_join(F.collect_list(t), "##"), F.lit("<|COMPLETE|>")).alias("text"))
    return parsing.extracted_entities(rows, "unit", "text").select("unit", "title", "type")


@query("SELECT result_id, coalesce(json_valid(assessment_plan_raw) AND json_type(CASE WHEN json_valid(assessment_plan_raw) THEN assessment_plan_raw END) = 'OBJECT', FALSE) AS strict FROM results WHERE assessment_plan_raw IS NOT NULL")
def parse_strict_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are strict JSON objects."""
    r = table(spark, d, "results").filter("assessment_plan_raw is not null")
    return r.select("result_id", parsing.strict_json("assessment_plan_raw").isNotNull().alias("strict"))


@query()
def parse_repaired_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are strict JSON objects, and those that can be repaired; rules are tested on known texts."""
    r = table(spark, d, "results").filter("assessment_plan_raw is not null")
    return r.select("result_id", parsing.strict_json("assessment_plan_raw").isNotNull().alias("strict"), parsing.lenient_json("assessment_plan_raw").isNotNull().alias("repaired"))


@query(rf"""WITH u AS (SELECT doc_id, {UNESCAPED} AS u FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(regexp_extract_all(u, '[A-Z][a-z0-9]+(?:[ -][A-Z]?[a-z0-9]+)?(?:-[a-z]+)*|[a-z]+-[a-z]+(?:-[a-z]+)*')) AS p FROM u), w AS (SELECT doc_id, p, string_split_regex(p, '[ -]') AS w FROM p),
    f AS (SELECT DISTINCT doc_id, upper(p) AS title FROM w WHERE (len(w) > 1 OR regexp_matches(p, '^[A-Z]')) AND len(list_filter(w, lambda x: x = '' OR length(x) > 15)) = 0) SELECT title, count(*) AS frequency FROM f GROUP BY title""")
def text_noun_phrases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").filter("text is not null").select("doc_id", F.explode(parsing.phrases("text")).alias("title"))
    return p.groupBy("title").agg(F.count(F.lit(1)).alias("frequency"))


@query(f"""SELECT id, CASE WHEN stop IS NULL OR stop = '' THEN '' ELSE code END AS code, CASE WHEN {day_sql('stop')} > DATE '2025-06-30' THEN '' ELSE stop END AS stop FROM encounters""")
def rule_open_encounters(spark: SparkSession, d: str) -> DataFrame:
    """Running totals are blanked where the end is open; ends after the reference day are cleared."""
    open_ = F.col("stop").isNull() | (F.col("stop") == "")
    return encounters(spark, d).select("id", F.when(open_, "").otherwise(F.col("code")).alias("code"), F.when(local_date("stop") > F.lit("2025-06-30").cast("date"), "").otherwise(F.col("stop")).alias("stop"))


@query("""SELECT category, count(*) AS n FROM observations WHERE coalesce(type, '') = 'numeric' AND coalesce(category, '') NOT IN ('social-history', 'survey') AND NOT (coalesce(description, '') ILIKE '%score%' OR coalesce(description, '') ILIKE '%weight%') GROUP BY category""")
def rule_serial_filters(spark: SparkSession, d: str) -> DataFrame:
    """Numeric observations outside some categories and without any of the terms to drop."""
    terms = F.array(F.lit("score"), F.lit("weight"))
    dropped = F.exists(terms, lambda t: F.contains(F.lower(F.coalesce("description", F.lit(""))), t))
    kept = observations(spark, d).filter((F.coalesce("type", F.lit("")) == "numeric") & ~F.coalesce("category", F.lit("")).isin("social-history", "survey") & ~dropped)
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, CASE WHEN plan IS NULL OR len(plan) = 0 OR len(list_filter(plan, lambda x: x IS NOT NULL AND trim(x) <> '')) = 0 THEN 'missing' WHEN len(list_filter(plan, lambda x: lower(trim(x)) IN ('none recorded', 'none'))) > 0 THEN 'none'
    WHEN len(list_filter(plan, lambda x: regexp_matches(lower(x), 'see (the )?record|note attached'))) > 0 THEN 'artifact' ELSE 'available' END AS state, coalesce(has_presenting_evidence, false) AS eligible FROM test_labels WHERE id IS NOT NULL""")
def rule_plan_states(spark: SparkSession, d: str) -> DataFrame:
    plan = F.coalesce("plan", F.array().cast("array<string>"))
    said = F.filter(plan, lambda x: x.isNotNull() & (F.trim(x) != ""))
    state = (
        F.when(F.size(said) == 0, "missing").when(F.exists(said, lambda x: F.lower(F.trim(x)).isin("none recorded", "none")), "none")
        .when(F.exists(said, lambda x: F.lower(x).rlike("see (the )?record|note attached")), "artifact").otherwise("available")
    )
    return table(spark, d, "test_labels").filter("id is not null").select("id", state.alias("state"), F.coalesce("has_presenting_evidence", F.lit(False)).alias("eligible"))


@query(f"""SELECT reasoncode, count(*) AS n, count(DISTINCT patient) AS patients FROM encounters WHERE reasoncode IN ('{TARGET}', '710020', '999') GROUP BY reasoncode""")
def rule_code_set(spark: SparkSession, d: str) -> DataFrame:
    """Codes of a configured list (comments and repeats leave, entries that aren't numeric raise) against the data."""
    codes = read_codes(f"# targets\n{TARGET}\n710020 # headache\n710020\n\n999\n")
    return encounters(spark, d).filter(F.col("reasoncode").isin(codes)).groupBy("reasoncode").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patient").alias("patients"))


def read_codes(text: str) -> list[str]:
    """Sorted distinct codes of a list with one code a line; # starts a comment."""
    found = sorted({c for line in text.splitlines() if (c := line.split("#")[0].strip())})
    if bad := [c for c in found if not c.isdigit()]:
        raise ValueError(f"not a code: {bad[0]}")
    return found


@query(f"""WITH c AS (SELECT patient, min({day_sql('start')}) AS cutoff FROM encounters WHERE reasoncode = '{TARGET}' GROUP BY patient), e AS (SELECT DISTINCT patient, description, {day_sql('start')} AS b, {day_sql('stop')} AS s FROM encounters)
    SELECT e.patient, description, b, CASE WHEN s >= cutoff THEN NULL ELSE s END AS s FROM e JOIN c ON c.patient = e.patient WHERE b < cutoff AND description <> 'Symptom visit'""")
def rule_symptom_history(spark: SparkSession, d: str) -> DataFrame:
    """Episodes begun before the cutoff, without the target's own; ends on or after it are blanked."""
    e = encounters(spark, d).select("patient", "description", local_date("start").alias("b"), local_date("stop").alias("s")).distinct()
    kept = e.join(cutoffs(spark, d), "patient").filter("b < cutoff and description <> 'Symptom visit'")
    return kept.select("patient", "description", "b", F.when(F.col("s") >= F.col("cutoff"), None).otherwise(F.col("s")).alias("s"))


@query(f"""WITH {EDGES}, s AS (SELECT title FROM nodes ORDER BY frequency DESC, title LIMIT 3), n AS (SELECT target AS title, weight FROM edges WHERE source IN (SELECT title FROM s) UNION ALL SELECT source, weight FROM edges WHERE target IN (SELECT title FROM s))
    SELECT title, sum(weight) AS rank FROM n WHERE title NOT IN (SELECT title FROM s) GROUP BY title ORDER BY rank DESC, title LIMIT 6""")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the matched entities by their total weight, the matched ones excluded: an oversampled match after exclusion."""
    s = F.broadcast(nodes(spark, d).orderBy(F.desc("frequency"), "title").limit(3).select("title"))
    e = written(edges(spark, d))
    both = e.select("source", F.col("target").alias("title"), "weight").union(e.select("target", "source", "weight"))
    near = both.join(s.withColumnRenamed("title", "source"), "source", "left_semi").join(s, "title", "left_anti")
    return near.groupBy("title").agg(F.sum("weight").alias("rank")).orderBy(F.desc("rank"), "title").limit(6)


@query(f"""WITH {E}, p AS (SELECT vec_id // 4 AS doc, 1 + vec_id % 4 AS w, embedding FROM e), x AS (SELECT doc, w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM p), m AS (SELECT doc, i, sum(w * x) / sum(w) AS m FROM x GROUP BY ALL), n AS (SELECT doc, sqrt(sum(m * m)) AS n FROM m GROUP BY doc)
    SELECT doc, round(max(CASE WHEN i = 1 THEN m / n END), 6) AS first, round(sum(m / n), 6) AS total FROM m JOIN n USING (doc) GROUP BY doc""")
def embed_split_texts(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of the parts of a text as one: weighted by their tokens, then scaled to length 1."""
    p = vectors(spark, d).select(F.expr("vec_id div 4").alias("doc"), (1 + F.col("vec_id") % 4).alias("w"), "embedding")
    m = mean_vector(p, "embedding", ["doc"], F.col("w")).withColumn("u", unit(F.col("embedding")))
    return m.select("doc", F.round(F.col("u")[0], 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH l AS (SELECT id, min(lower(trim(condition, chr(9) || ' '))) AS condition FROM test_labels WHERE id IS NOT NULL GROUP BY id), j AS (SELECT t.id, l.condition, t.source FROM test t LEFT JOIN l USING (id))
    SELECT CASE WHEN condition IS NULL THEN 'no_label' ELSE 'labelled' END AS state, source, count(*) AS n FROM j GROUP BY ALL""")
def labels_preflight(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one merge of inputs and labels with a state for what has no label."""
    named = F.lower(F.regexp_replace("condition", r"^\s+|\s+$", ""))
    one = table(spark, d, "test_labels").filter("id is not null").groupBy("id").agg(F.min(named).alias("condition"))
    j = table(spark, d, "test").select("id", "source").join(one, "id", "left")
    return j.groupBy(F.when(F.col("condition").isNull(), "no_label").otherwise("labelled").alias("state"), "source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT e.patient, p.item FROM (SELECT DISTINCT patient, lower(replace(trim(regexp_replace(reasondescription, '\\s*\\([^()]*\\)\\s*$', '')), ' ', '_')) AS condition FROM encounters WHERE reasondescription IS NOT NULL AND patient IS NOT NULL) e
    JOIN (SELECT lower(trim(condition, chr(9) || ' ')) AS condition, id, unnest(plan) AS item FROM test_labels WHERE condition IS NOT NULL AND id IS NOT NULL) p ON p.condition = e.condition AND lower(right(p.id, 36)) = e.patient WHERE item IS NOT NULL""")
def plan_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Plan items of a patient's label for each condition the patient was seen for."""
    e = encounters(spark, d).filter("reasondescription is not null and patient is not null").select("patient", F.replace(without_tag("reasondescription"), F.lit(" "), F.lit("_")).alias("condition")).distinct()
    named = F.lower(F.regexp_replace("condition", r"^\s+|\s+$", ""))
    p = table(spark, d, "test_labels").filter("condition is not null and id is not null").select(named.alias("condition"), person_uuid("id").alias("patient"), F.explode("plan").alias("item")).filter("item is not null")
    return e.join(p, ["patient", "condition"]).select("patient", "item").distinct()


@query("""WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(old_patient_id)) AS s, lower(trim(new_patient_id)) AS t FROM patient_merges WHERE old_patient_id IS NOT NULL AND new_patient_id IS NOT NULL),
    a AS (SELECT s AS node FROM e WHERE s NOT IN (SELECT t FROM e) UNION SELECT t FROM a JOIN e ON s = node), b AS (SELECT t AS node FROM e WHERE t NOT IN (SELECT s FROM e) UNION SELECT s FROM b JOIN e ON t = node)
    SELECT DISTINCT node, CASE WHEN node NOT IN (SELECT s FROM e) THEN NULL WHEN node < '5' THEN 'visible' WHEN node < 'a' THEN 'hidden' ELSE 'skip' END AS class FROM a WHERE node IN (SELECT node FROM b)""")
def graph_gate_classes(spark: SparkSession, d: str) -> DataFrame:
    """States on a way through the merges' graph with a made-up gate by their first letter; classes are tested on a fixture."""
    e = written(merges(spark, d).select("source", "target"))
    ends = e.select(F.col("target").alias("node")).join(e.select(F.col("source").alias("node")), "node", "left_anti")
    starts = e.select(F.col("source").alias("node")).join(e.select(F.col("target").alias("node")), "node", "left_anti")
    gates = e.select(F.col("source").alias("node"), F.when(F.col("source") < "5", "visible").when(F.col("source") < "a", "hidden").otherwise("skip").alias("gate"))
    return X.gate_classes(e, gates, written(ends.distinct()), written(starts.distinct()))
