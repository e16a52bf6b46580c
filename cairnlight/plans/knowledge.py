"""Knowledge-graph queries: codes observed in one encounter are mentions in one text unit; merges of patients are a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.functions.text import estimated_tokens, joined_id, sentences, token_chunks, tokens
from cairnlight.operators import knowledge as K
from cairnlight.operators.communities import community_table, hierarchical_leiden
from cairnlight.operators.components import connected_components
from cairnlight.operators.ranking import global_rank
from cairnlight.plans.registry import query
from cairnlight.session import spread, table, written

MENTIONS = "m AS (SELECT DISTINCT encounter AS unit, code AS title FROM observations WHERE encounter IS NOT NULL AND code IS NOT NULL)"
NODES = f"{MENTIONS}, nodes AS (SELECT title, count(DISTINCT unit) AS frequency FROM m GROUP BY title)"
EDGES = f"{NODES}, edges AS (SELECT a.title AS source, b.title AS target, count(*) AS weight FROM m a JOIN m b ON a.unit = b.unit AND a.title < b.title GROUP BY ALL)"
PMI = f"""{EDGES}, pmi AS (SELECT source, target, weight / (SELECT sum(weight) FROM edges) * log2(weight / (SELECT sum(weight) FROM edges)
    / (s.frequency / (SELECT sum(frequency) FROM nodes) * (t.frequency / (SELECT sum(frequency) FROM nodes)))) AS weight FROM edges JOIN nodes s ON s.title = source JOIN nodes t ON t.title = target)"""
DEGREE = f"{EDGES}, degree AS (SELECT title, count(*) AS degree FROM (SELECT source AS title FROM edges UNION ALL SELECT target FROM edges) GROUP BY title)"
WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations").select(F.col("encounter").alias("unit"), F.col("code").alias("title")).filter("unit is not null and title is not null")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).groupBy("title").agg(F.countDistinct("unit").alias("frequency"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return K.cooccurrence(mentions(spark, d), "title", "unit")


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT doc_id, w, unnest(generate_series(0, greatest(CAST(ceil((len(w) - 10) / 40) AS BIGINT) - 1, 0))) AS i FROM w WHERE len(w) > 0)
    SELECT doc_id, i AS chunk, len(w[i * 40 + 1 : i * 40 + 50]) AS n_tokens, md5(array_to_string(w[i * 40 + 1 : i * 40 + 50], ' ')) AS digest FROM s""")
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    words = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", tokens("text").alias("t"))  # split once, not once a chunk
    chunks = words.select("doc_id", F.posexplode(token_chunks(F.col("t"), 50, 10)).alias("chunk", "w"))
    return chunks.select("doc_id", "chunk", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, len({WORDS}) AS n_tokens, CAST(round(length(text) / 4) AS INTEGER) AS estimated FROM documents WHERE text IS NOT NULL")
def text_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(tokens("text")).alias("n_tokens"), estimated_tokens("text").alias("estimated"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '[\r\n\x01]+'), lambda x: trim(x) <> '')) AS n FROM documents""")
def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences per document; the split looks behind, for which the SQL puts a mark."""
    return table(spark, d, "documents").select("doc_id", F.size(sentences("text")).alias("n"))


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS key FROM documents LEFT JOIN (SELECT DISTINCT source FROM documents) USING (source) WHERE source IS NULL")
def documents_without_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("source is null").select("doc_id", F.col("doc_id").cast("string").alias("key"))


@query("SELECT doc_id, count(*) OVER (PARTITION BY coalesce(text, '') || coalesce(source, '')) AS same FROM documents")
def document_ids(spark: SparkSession, d: str) -> DataFrame:
    """How many documents have the id of each: SHA-512 over text and source."""
    ids = table(spark, d, "documents").select("doc_id", joined_id("text", "source").alias("id"))
    return ids.join(ids.groupBy("id").agg(F.count(F.lit(1)).alias("same")), "id").select("doc_id", "same")


@query(f"WITH {NODES} SELECT title, frequency FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return K.nodes_from_mentions(mentions(spark, d), "title", "unit").select("title", "frequency")


@query(f"WITH {EDGES} SELECT source, target, weight FROM edges")
def graph_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


@query(f"WITH {DEGREE} SELECT title, degree FROM degree")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return K.degrees(edges(spark, d))


@query(f"WITH {DEGREE} SELECT source, target, weight, coalesce(s.degree, 0) + coalesce(t.degree, 0) AS combined_degree FROM edges LEFT JOIN degree s ON s.title = source LEFT JOIN degree t ON t.title = target")
def graph_combined_degree(spark: SparkSession, d: str) -> DataFrame:
    e = written(edges(spark, d))
    return K.with_combined_degree(e, K.degrees(e))


@query(f"WITH {PMI} SELECT source, target, round(weight, 6) AS weight FROM pmi")
def graph_pmi(spark: SparkSession, d: str) -> DataFrame:
    return K.pmi_weights(edges(spark, d), nodes(spark, d)).select("source", "target", F.round("weight", 6).alias("weight"))


@query(f"WITH {PMI}, p AS (SELECT source, target, round(weight, 6) AS w FROM pmi) SELECT source, target, round(2.0 / (60 + rank() OVER (ORDER BY w DESC)), 8) AS weight FROM p")
def graph_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Both ranks read the weight that PMI has already replaced, as in the reference's pipeline."""
    p = written(graph_pmi(spark, d))
    return K.rank_fusion(p, "weight", "weight").select("source", "target", F.round("weight", 8).alias("weight"))


@query(f"""WITH {DEGREE}, ego AS (SELECT title FROM degree ORDER BY degree DESC, title LIMIT 1),
    k AS (SELECT n.title FROM nodes n LEFT JOIN degree USING (title) WHERE frequency >= 2 AND coalesce(degree, 0) >= 1 AND n.title NOT IN (SELECT title FROM ego)),
    l AS (SELECT * FROM edges WHERE source IN (SELECT title FROM k) AND target IN (SELECT title FROM k))
    SELECT source, target, weight FROM l WHERE weight >= (SELECT quantile_cont(weight, 0.4) FROM l)""")
def graph_pruned(spark: SparkSession, d: str) -> DataFrame:
    return K.pruned(nodes(spark, d), written(edges(spark, d)))


@query(f"WITH {EDGES} SELECT avg(weight) + 1.5 * stddev_pop(weight) AS threshold, count(*) AS n FROM edges")
def graph_weight_threshold(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).agg((F.avg("weight") + 1.5 * F.stddev_pop("weight")).alias("threshold"), F.count(F.lit(1)).alias("n"))


MERGES = """e AS (SELECT DISTINCT lower(trim(old_patient_id)) AS source, lower(trim(new_patient_id)) AS target, 1 AS weight FROM patient_merges WHERE old_patient_id IS NOT NULL AND new_patient_id IS NOT NULL),
    b AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), r AS (SELECT a, b FROM b UNION SELECT r.a, b.b FROM r JOIN b ON r.b = b.a),
    c AS (SELECT a AS node, min(least(a, b)) AS component FROM r GROUP BY a)"""


def merges(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "patient_merges").select(F.lower(F.trim("old_patient_id")).alias("source"), F.lower(F.trim("new_patient_id")).alias("target"))
    return m.filter("source is not null and target is not null").distinct().withColumn("weight", F.lit(1))


@query(f"WITH RECURSIVE {MERGES} SELECT node, component FROM c")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(merges(spark, d), "source", "target")


@query(f"WITH RECURSIVE {MERGES}, n AS (SELECT component, count(*) AS n FROM c GROUP BY component ORDER BY n DESC, component LIMIT 1) SELECT node FROM c JOIN n USING (component)")
def graph_largest_component(spark: SparkSession, d: str) -> DataFrame:
    return K.largest_component(merges(spark, d))


@query(f"""WITH RECURSIVE {MERGES}, m AS (SELECT count(*) AS m FROM e), i AS (SELECT cs.component AS k, count(*) AS w FROM e JOIN c cs ON cs.node = source GROUP BY ALL),
    g AS (SELECT component AS k, count(*) AS d FROM (SELECT source AS x FROM e UNION ALL SELECT target FROM e) JOIN c ON c.node = x GROUP BY ALL)
    SELECT round(sum(coalesce(w, 0) / m - pow(d / (2 * m), 2)), 6) AS modularity FROM g LEFT JOIN i USING (k), m""")
def graph_modularity(spark: SparkSession, d: str) -> DataFrame:
    e = written(merges(spark, d))
    return K.modularity(e, connected_components(e, "source", "target").withColumnRenamed("component", "community")).select(F.round("modularity", 6).alias("modularity"))


@query(f"""WITH RECURSIVE {MERGES}, g AS (SELECT component, count(*) AS n FROM c GROUP BY component) SELECT 'nodes at the top' AS what, (SELECT count(*) FROM c) AS n UNION ALL SELECT 'nodes twice at a level', 0 UNION ALL SELECT 'children outside their parent', 0
    UNION ALL SELECT 'communities over a component border', 0 UNION ALL SELECT 'communities that hang apart', 0 UNION ALL SELECT 'modularity below that of components', 0""")
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the communities of the graph of merges (hierarchical Leiden, at most 10 nodes where they can be divided)."""
    e = written(merges(spark, d))
    c = written(hierarchical_leiden(e))
    top = c.filter("level = 0").select("node", "community")
    parts = written(connected_components(e, "source", "target"))
    up = c.select("node", (F.col("level") + 1).alias("level"), F.col("community").alias("parent"), F.lit(True).alias("_in"))
    inner = e.join(c.select(F.col("node").alias("source"), "level", "community"), "source").join(c.select(F.col("node").alias("target"), "level", F.col("community").alias("_c")), ["target", "level"]).filter("community = _c")
    name = lambda x: F.concat(F.col("community"), F.lit("|"), F.col(x))
    islands = connected_components(inner.select(name("source").alias("source"), name("target").alias("target")), "source", "target")
    held = islands.select(F.substring_index("node", "|", 1).alias("community"), "component").distinct().groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    ours, theirs = K.modularity(e, top), K.modularity(e, parts.withColumnRenamed("component", "community"))
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    checks = (
        count(top, "nodes at the top"), count(c.groupBy("node", "level").count().filter("count > 1"), "nodes twice at a level"),
        count(c.filter("level > 0").join(up, ["node", "level", "parent"], "left").filter("_in is null"), "children outside their parent"),
        count(c.join(parts, "node").groupBy("community").agg(F.countDistinct("component").alias("k")).filter("k > 1"), "communities over a component border"),
        count(held.filter("n > 1"), "communities that hang apart"),
        count(ours.join(theirs.withColumnRenamed("modularity", "_m")).filter("modularity < _m - 1e-9"), "modularity below that of components"),
    )
    out = checks[0]
    for x in checks[1:]:
        out = out.unionByName(x)
    return out


@query(f"WITH RECURSIVE {MERGES} SELECT (SELECT count(*) FROM c) AS nodes, (SELECT count(*) FROM e) AS relationships, TRUE AS children_fit, '2026-01-01' AS period")
def community_tables(spark: SparkSession, d: str) -> DataFrame:
    """The community table (level, parent, children, size, relationships, period): its top level has all nodes, children add up to their parent; relationships inside and between."""
    e = written(merges(spark, d))
    c = written(hierarchical_leiden(e))
    t = written(community_table(c, e, "2026-01-01"))
    kids = t.filter("parent is not null").groupBy(F.col("parent").alias("community")).agg(F.sum("size").alias("_s"), F.count(F.lit(1)).alias("_k"))
    fit = t.join(kids, "community", "left").agg(F.bool_and(F.coalesce(F.col("_s") == F.col("size"), F.size("children") == 0) & (F.size("children") == F.coalesce("_k", F.lit(0)))).alias("children_fit"))
    a, b = (c.filter("level = 0").select(F.col("node").alias(x), F.col("community").alias(y)) for x, y in (("source", "_a"), ("target", "_b")))
    between = e.join(a, "source").join(b, "target").filter("_a <> _b").agg(F.count(F.lit(1)).alias("_n"))
    top = t.filter("level = 0").agg(F.sum("size").cast("bigint").alias("nodes"), F.sum("relationships").alias("_r"), F.max("period").alias("period"))
    return top.join(between).join(fit).select("nodes", (F.col("_r") + F.col("_n")).cast("bigint").alias("relationships"), "children_fit", "period")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(old_patient_id)) AS s, lower(trim(new_patient_id)) AS t FROM patient_merges),
    starts AS (SELECT s AS node FROM e WHERE s NOT IN (SELECT t FROM e WHERE t IS NOT NULL)), r AS (SELECT node FROM starts UNION SELECT t FROM r JOIN e ON s = node) SELECT node FROM r""")
def graph_forward_reach(spark: SparkSession, d: str) -> DataFrame:
    e = written(merges(spark, d))
    starts = e.select(F.col("source").alias("node")).join(e.select(F.col("target").alias("node")), "node", "left_anti")
    return K.reachable(e, starts)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(old_patient_id)) AS s, lower(trim(new_patient_id)) AS t FROM patient_merges WHERE old_patient_id IS NOT NULL AND new_patient_id IS NOT NULL),
    blocked AS (SELECT t AS node FROM e GROUP BY t HAVING count(*) >= 2), ends AS (SELECT DISTINCT t AS node FROM e WHERE t NOT IN (SELECT s FROM e) AND t NOT IN (SELECT node FROM blocked)),
    r AS (SELECT node FROM ends UNION SELECT s FROM r JOIN e ON t = node WHERE s NOT IN (SELECT node FROM blocked)) SELECT node FROM r""")
def graph_backward_reach(spark: SparkSession, d: str) -> DataFrame:
    """All that leads to a last node without passing a node into which several were merged."""
    e = written(merges(spark, d))
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    blocked = written(e.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("node"))
    ends = e.select(F.col("target").alias("node")).distinct().join(e.select(F.col("source").alias("node")), "node", "left_anti")
    return K.reachable(back, ends, blocked)


@query(f"""WITH {EDGES}, s AS (SELECT title FROM nodes ORDER BY frequency DESC, title LIMIT 5)
    SELECT source, target, weight, CASE WHEN source IN (SELECT title FROM s) AND target IN (SELECT title FROM s) THEN 'in' ELSE 'out' END AS network
    FROM edges WHERE source IN (SELECT title FROM s) OR target IN (SELECT title FROM s)""")
def graph_networks(spark: SparkSession, d: str) -> DataFrame:
    chosen = nodes(spark, d).orderBy(F.desc("frequency"), "title").limit(5)
    return K.network_relationships(edges(spark, d), chosen)


@query(f"""WITH {EDGES}, s AS (SELECT title FROM nodes ORDER BY frequency DESC, title LIMIT 5), n AS (SELECT CASE WHEN source IN (SELECT title FROM s) THEN target ELSE source END AS title,
    CASE WHEN source IN (SELECT title FROM s) THEN source ELSE target END AS link, weight FROM edges WHERE (source IN (SELECT title FROM s)) <> (target IN (SELECT title FROM s)))
    SELECT title, count(DISTINCT link) AS links, sum(weight) AS weight FROM n GROUP BY title ORDER BY links DESC, weight DESC, title LIMIT 10""")
def graph_outer_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours outside the selection, by how many selected nodes they touch, then by weight: a report of ten."""
    chosen = F.broadcast(nodes(spark, d).orderBy(F.desc("frequency"), "title").limit(5).select("title"))
    e = K.network_relationships(edges(spark, d), chosen).filter("network = 'out'").join(chosen.select(F.col("title").alias("source"), F.lit(True).alias("_in")), "source", "left")
    n = e.select(F.when(F.col("_in"), F.col("target")).otherwise(F.col("source")).alias("title"), F.when(F.col("_in"), F.col("source")).otherwise(F.col("target")).alias("link"), "weight")
    return n.groupBy("title").agg(F.countDistinct("link").alias("links"), F.sum("weight").alias("weight")).orderBy(F.desc("links"), F.desc("weight"), "title").limit(10)


ENTITIES = """x AS (SELECT encounter AS unit, code AS title, min(category) AS type, min(description) AS description, CASE WHEN min(loaded_at) < TIMESTAMP '2023-01-01' THEN 0 ELSE 1 END AS part
    FROM observations WHERE encounter IS NOT NULL AND code IS NOT NULL GROUP BY ALL)"""


def extracted(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.min("loaded_at") < F.lit("2023-01-01").cast("timestamp_ntz"), 0).otherwise(1)
    return table(spark, d, "observations").filter("encounter is not null and code is not null").groupBy(F.col("encounter").alias("unit"), F.col("code").alias("title")).agg(
        F.min("category").alias("type"), F.min("description").alias("description"), part.alias("part")
    )


@query(f"WITH {ENTITIES} SELECT title, coalesce(type, '') AS type, count(*) AS frequency, string_agg(DISTINCT description, '|' ORDER BY description) AS descriptions FROM x GROUP BY ALL")
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    x = extracted(spark, d).withColumn("type", F.coalesce("type", F.lit("")))
    return x.groupBy("title", "type").agg(F.count(F.lit(1)).alias("frequency"), F.array_join(F.array_sort(F.collect_set("description")), "|").alias("descriptions"))


@query(f"""WITH {ENTITIES}, p AS (SELECT part, title, count(*) AS n, part || ':' || title AS id FROM x GROUP BY ALL)
    SELECT title, arg_min(id, part) AS id, sum(n) AS frequency FROM p GROUP BY title""")
def entity_incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = extracted(spark, d).groupBy("part", "title").agg(F.array_sort(F.collect_list("unit")).alias("text_unit_ids"), F.min("type").alias("type"), F.collect_set("description").alias("description"))
    rows = rows.withColumn("id", F.concat_ws(":", "part", "title"))
    side = lambda k: rows.filter(F.col("part") == k).select("id", "title", "type", "description", "text_unit_ids")
    return K.merge_entities(side(0), side(1)).select("title", "id", "frequency")


@query(f"""WITH {ENTITIES}, e AS (SELECT a.part, a.title AS source, b.title AS target, count(*) AS weight FROM x a JOIN x b ON a.unit = b.unit AND a.part = b.part AND a.title < b.title GROUP BY ALL),
    g AS (SELECT source, target, arg_min(part || source || target, part) AS id, avg(weight) AS weight FROM e GROUP BY ALL)
    SELECT id, source, target, weight, count(*) OVER (PARTITION BY source) + count(*) OVER (PARTITION BY target) AS combined_degree FROM g""")
def relationship_incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    x = extracted(spark, d)
    a, b = x.select("part", "unit", F.col("title").alias("source")), x.select("part", "unit", F.col("title").alias("target"))
    e = a.join(b, ["part", "unit"]).filter("source < target").groupBy("part", "source", "target").agg(F.count(F.lit(1)).alias("weight")).withColumn("id", F.concat("part", "source", "target"))
    side = lambda k: e.filter(F.col("part") == k).drop("part")
    return K.merge_relationships(side(0), side(1)).select("id", "source", "target", "weight", "combined_degree")


@query("""WITH o AS (SELECT DISTINCT provider_id AS title FROM documents WHERE loaded_at < TIMESTAMP '2024-07-01' AND provider_id IS NOT NULL), n AS (SELECT DISTINCT provider_id AS title FROM documents WHERE loaded_at >= TIMESTAMP '2024-07-01' AND provider_id IS NOT NULL)
    SELECT title, 'new' AS change FROM n WHERE title NOT IN (SELECT title FROM o) UNION ALL SELECT title, 'deleted' FROM o WHERE title NOT IN (SELECT title FROM n)""")
def document_delta(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("provider_id is not null").withColumnRenamed("provider_id", "title")
    border = F.lit("2024-07-01").cast("timestamp_ntz")
    return K.document_delta(docs.filter(F.col("loaded_at") < border), docs.filter(F.col("loaded_at") >= border), "title")


COMMUNITY = """old AS (SELECT n_nationkey AS community, CASE WHEN n_nationkey % 5 = 0 THEN -1 ELSE n_nationkey // 5 END AS parent FROM nation),
    delta AS (SELECT r_regionkey AS community, CASE WHEN r_regionkey = 0 THEN -1 ELSE 0 END AS parent FROM region)"""


@query(f"WITH {COMMUNITY} SELECT community, parent FROM old UNION ALL SELECT community + (SELECT max(community) + 1 FROM old), CASE WHEN parent = -1 THEN -1 ELSE parent + (SELECT max(community) + 1 FROM old) END FROM delta")
def community_shift(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "nation").selectExpr("n_nationkey as community", "if(n_nationkey % 5 = 0, -1, n_nationkey div 5) as parent")
    delta = table(spark, d, "region").selectExpr("r_regionkey as community", "if(r_regionkey = 0, -1, 0) as parent")
    return K.shifted_communities(old.selectExpr("cast(community as bigint) community", "cast(parent as bigint) parent"), delta.selectExpr("cast(community as bigint) community", "cast(parent as bigint) parent"))


@query(f"WITH {COMMUNITY} SELECT c.community, c.parent, coalesce(string_agg(CAST(k.community AS VARCHAR), ',' ORDER BY k.community), '') AS children FROM old c LEFT JOIN old k ON k.parent = c.community GROUP BY ALL")
def community_children(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "nation").selectExpr("n_nationkey as community", "if(n_nationkey % 5 = 0, -1, cast(n_nationkey div 5 as int)) as parent")
    kids = old.groupBy(F.col("parent").alias("community")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("community")), lambda x: x.cast("string")), ",").alias("children"))
    return old.join(kids, "community", "left").select("community", "parent", F.coalesce("children", F.lit("")).alias("children"))


@query(f"""WITH {EDGES}, mem AS (SELECT title, CASE WHEN title < '93' THEN 0 ELSE 1 END AS community FROM nodes)
    SELECT a.community, count(*) AS edges, sum(weight) AS weight FROM edges JOIN mem a ON a.title = source JOIN mem b ON b.title = target AND a.community = b.community GROUP BY a.community""")
def community_inner_edges(spark: SparkSession, d: str) -> DataFrame:
    member = nodes(spark, d).select("title", F.when(F.col("title") < "93", 0).otherwise(1).alias("community"))
    a, b = member.withColumnRenamed("title", "source"), member.withColumnRenamed("title", "target")
    return edges(spark, d).join(a, "source").join(b, ["target", "community"]).groupBy("community").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


@query(f"""WITH {MENTIONS}, doc AS (SELECT id AS unit, patient FROM (SELECT id, min(patient) AS patient FROM encounters WHERE id IS NOT NULL GROUP BY id))
    SELECT doc.unit, coalesce(string_agg(title, ',' ORDER BY title), '') AS titles, count(title) AS n FROM doc LEFT JOIN m USING (unit) GROUP BY doc.unit""")
def text_unit_entities(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "encounters").filter("id is not null").select(F.col("id").alias("unit")).distinct()
    m = mentions(spark, d).distinct().groupBy("unit").agg(F.array_sort(F.collect_list("title")).alias("t"))
    return units.join(m, "unit", "left").select("unit", F.coalesce(F.array_join("t", ","), F.lit("")).alias("titles"), F.coalesce(F.size("t"), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


@query(f"WITH {DEGREE} SELECT unit, sum(coalesce(degree, 0)) AS degree FROM m LEFT JOIN degree USING (title) GROUP BY unit")
def text_unit_degree(spark: SparkSession, d: str) -> DataFrame:
    deg = K.degrees(edges(spark, d))
    return mentions(spark, d).distinct().join(deg, "title", "left").groupBy("unit").agg(F.sum(F.coalesce("degree", F.lit(0))).alias("degree"))


@query(f"WITH {NODES}, w AS (SELECT title, frequency / max(frequency) OVER () AS weight FROM nodes) SELECT title, round(weight, 6) AS weight FROM w")
def community_weight(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return n.join(F.broadcast(n.agg(F.max("frequency").alias("_m")))).select("title", F.round(F.col("frequency") / F.col("_m"), 6).alias("weight"))


@query(f"""WITH {EDGES}, d AS (SELECT source, target, weight, row_number() OVER (ORDER BY weight DESC, source, target) - 1 AS human_readable_id FROM edges) SELECT * FROM d""")
def graph_row_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals of the finished edge table, by weight, then by its ends."""
    ranked = global_rank(written(edges(spark, d)), "weight", "k", ["source", "target"])
    return ranked.select("source", "target", "weight", (F.col("k") - 1).alias("human_readable_id"))
