"""Queries of the operators for training data over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm.chunking import cut_oversized
from cairnlight.llm.forms import canonical_texts, mapping_rows, one_form, same_look_pairs
from cairnlight.llm.mixing import Mixture
from cairnlight.llm.overlap import cross_split_overlaps, overlap_report
from cairnlight.llm.packing import container_report, pack
from cairnlight.llm.pairs import defective_pairs
from cairnlight.llm.sampling import MatchedSample, eligible_records
from cairnlight.llm.splits import assign_splits, persons, related_ids, split_report
from cairnlight.session import table, written

Query = Callable[[SparkSession, str], DataFrame]


def _sample(spark: SparkSession, d: str) -> MatchedSample:
    records = eligible_records(table(spark, d, "test"), table(spark, d, "test_labels"))
    return MatchedSample(records, table(spark, d, "sample_targets"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report().filter("short_by > 0").select("condition")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).sample()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report()


def _people(spark: SparkSession, d: str) -> DataFrame:
    return persons(table(spark, d, "test_labels"), table(spark, d, "patient_merges"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return related_ids(_people(spark, d))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(_people(spark, d), table(spark, d, "test_labels"))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the splits: every id once, no person on two sides, the splits together within one record in fifty of their shares, and two of the largest person."""
    got = p2_splits(spark, d)
    people_ = got.groupBy("person").agg(F.countDistinct("split").alias("sides"), F.count(F.lit(1)).alias("n"))
    per = people_.agg(F.sum("n").alias("ids"), F.count_if(F.col("sides") > 1).alias("divided"), F.max("n").alias("largest"))
    off = got.agg(*[F.avg((F.col("split") == s).cast("double")).alias(s) for s in ("test", "validation", "train")])
    near = F.abs(F.col("test") - 0.15) + F.abs(F.col("validation") - 0.15) + F.abs(F.col("train") - 0.7) < 0.02 + 2 * F.col("largest") / F.col("ids")
    return per.join(off).select("ids", "divided", near.alias("near"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return split_report(p2_splits(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defective_pairs(table(spark, d, "results"), table(spark, d, "documents"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "size_limits")
    corpus = cut_oversized(table(spark, d, "corpus"), "id", "text", limits, "corpus")
    return corpus.unionByName(cut_oversized(table(spark, d, "test"), "id", "objective", limits, "test"))


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per cut record: whether the new parts of its pieces join to the whole text, whether all are within the limit and whether all but the first begin with the wanted overlap."""
    pieces = p4_pieces(spark, d)
    limits = table(spark, d, "size_limits").select("table_name", "field_name", "max_size", F.col("overlap").alias("wanted"))
    new = F.expr("substring(text, overlap + 1)")
    rows = pieces.join(F.broadcast(limits), ["table_name", "field_name"]).withColumn("new", new)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "new"))), lambda x: x["new"]), "")
    per = rows.groupBy("table_name", "id").agg(joined.alias("whole"), (F.max("n_size") <= F.max("max_size")).alias("within"), F.bool_and((F.col("piece") == 1) | (F.col("overlap") == F.col("wanted"))).alias("overlaps"))
    texts = table(spark, d, "corpus").select(F.lit("corpus").alias("table_name"), "id", "text").unionByName(table(spark, d, "test").select(F.lit("test").alias("table_name"), "id", F.col("objective").alias("text")))
    return per.join(texts, ["table_name", "id"]).select("table_name", "id", (F.col("whole") == F.col("text")).alias("rejoins"), "within", "overlaps")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).filter("piece = 2").select("table_name", "id")


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    split = lambda name: table(spark, d, name).select("id", F.col("subjective").alias("text"), "source", F.lit(name).alias("split"))
    return split("test").unionByName(split("dev"))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_overlaps(_evaluation(spark, d), table(spark, d, "corpus"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("query_id", "stored_id").alias("id_a"), F.greatest("query_id", "stored_id").alias("id_b"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(_evaluation(spark, d), table(spark, d, "corpus"), _overlaps(spark, d))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    limit = table(spark, d, "size_limits").filter("table_name = 'documents' and field_name = 'text'").select("max_size").first()[0]
    sizes = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return pack(sizes, "doc_id", "size", limit), limit


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0].groupBy(F.col("id").alias("doc_id")).agg(F.max("piece").alias("n")).filter("n > 1").select("doc_id")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: all sizes placed, none too full, no document cut that fits, nearly as few as can be."""
    packed, limit = _packed(spark, d)
    packed = written(packed)
    full = packed.filter("container is not null").groupBy("container").agg(F.sum("length").alias("used"))
    cut = packed.groupBy("id").agg(F.sum("length").alias("size"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = full.agg(F.sum("used").alias("placed"), F.count_if(F.col("used") > limit).alias("too_full"), (F.count(F.lit(1)) <= 1.05 * F.ceil(F.sum("used") / limit) + 1).alias("few"))
    return total.join(cut.agg(F.count(F.lit(1)).alias("cut"), F.count_if(F.col("size") <= limit).alias("cut_in_vain")))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return container_report(*_packed(spark, d))


def _mixture(spark: SparkSession, d: str) -> Mixture:
    sizes = table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").alias("size"))
    return Mixture(sizes, table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report().filter("not in_reach").select("source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).sequence().withColumnRenamed("id", "doc_id")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source: its goal, the most uses of one document against the cap, whether it is within one document of its part."""
    m = _mixture(spark, d)
    uses = m.records().groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).groupBy("source").agg(F.max("n").alias("most"), F.max("size").alias("largest"))
    r = m.report().join(uses, "source", "left")
    near = (F.col("part") - F.col("reached")).between(0, F.greatest(F.coalesce("largest", F.lit(0)) - 1, F.lit(0)))
    return r.select("source", "size", "goal", "in_reach", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("under_cap"), near.alias("near"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return same_look_pairs(table(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical_texts(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    named = (
        p1_found, p1_sample, p1_report, p2_found, p2_splits, p2_report, p2_checks, p3_found, p4_found, p4_pieces, p4_checks, p6_found, p6_report,
        p7_found, p7_containers, p7_report, p7_checks, p8_found, p8_mixture, p8_report, p8_checks, p9_found, p9_canonical,
    )
    return {f.__name__: f for f in named}


def same_look_sql() -> str:
    """SQL of the consistent form: single characters by the mapping, then the engine's own composition."""
    rows = mapping_rows()[0]
    one, gone, more = [], [], []
    for cp, *_ in rows:
        form = one_form([chr(cp)])[0]
        if cp in (0x0D, 0x27) or form == chr(cp) or 0xE0000 <= cp < 0xE0200 or cp == 0:
            continue
        (one if len(form) == 1 else more if form else gone).append((chr(cp), form))
    text = r"replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    # translate drops what has no counterpart.
    moved = f"translate({text}, {quoted(''.join(a for a, _ in one) + ''.join(a for a, _ in gone))}, {quoted(''.join(b for _, b in one))})"
    for a, b in more:
        if 0x2160 <= ord(a) < 0x2180 or 0xFB00 <= ord(a) < 0xFB07 or ord(a) in (0x2026,):
            moved = f"replace({moved}, {quoted(a)}, {quoted(b)})"
    return f"nfc_normalize({moved})"


def oracle_sql() -> dict[str, str]:
    condition = r"lower(regexp_replace(condition, '^\s+|\s+$', '', 'g'))"
    return {
        "p1_found": rf"""
            WITH labels AS (SELECT id, min({condition}) AS c FROM test_labels WHERE {condition} IS NOT NULL GROUP BY id),
            eligible AS (SELECT DISTINCT t.id, l.c FROM test t JOIN labels l ON t.id = l.id WHERE regexp_matches(t.subjective, '\S')),
            s AS (SELECT count(*) // 5 AS size FROM eligible),
            n AS (SELECT c, count(*) AS n FROM eligible GROUP BY c)
            SELECT condition FROM sample_targets LEFT JOIN n ON c = condition, s
            WHERE coalesce(n, 0) < greatest(min_rows, ceil(target_pct * size / 100))""",
        "p1_report": rf"""
            WITH labels AS (SELECT id, min({condition}) AS c FROM test_labels WHERE {condition} IS NOT NULL GROUP BY id),
            eligible AS (SELECT DISTINCT t.id, l.c FROM test t JOIN labels l ON t.id = l.id WHERE regexp_matches(t.subjective, '\S')),
            s AS (SELECT count(*) // 5 AS size FROM eligible), n AS (SELECT c, count(*) AS n FROM eligible GROUP BY c),
            w AS (SELECT condition, target_pct, min_rows, coalesce(n, 0) AS available, CAST(greatest(min_rows, ceil(target_pct * size / 100)) AS BIGINT) AS wanted FROM sample_targets LEFT JOIN n ON c = condition, s),
            seq AS (SELECT condition, k, k > min_rows AS later, (k - 0.5) / target_pct AS priority FROM (SELECT *, unnest(generate_series(1, available)) AS k FROM w WHERE available > 0) WHERE target_pct > 0 OR k <= min_rows),
            seats AS (SELECT condition, count(*) AS taken FROM (SELECT *, row_number() OVER (ORDER BY later, priority, condition) AS place FROM seq), s WHERE place <= size OR NOT later GROUP BY condition)
            SELECT condition, target_pct, min_rows, available, wanted, coalesce(taken, 0) AS taken, greatest(wanted - available, 0) AS short_by, greatest(wanted - coalesce(taken, 0), 0) AS missing FROM w LEFT JOIN seats USING (condition)""",
        "p2_checks": "SELECT count(DISTINCT id) AS ids, 0 AS divided, TRUE AS near FROM test_labels WHERE id IS NOT NULL",
        "p4_checks": """
            SELECT table_name, id, TRUE AS rejoins, TRUE AS within, TRUE AS overlaps FROM corpus, size_limits WHERE table_name = 'corpus' AND length(text) > max_size
            UNION ALL SELECT table_name, id, TRUE, TRUE, TRUE FROM test, size_limits WHERE table_name = 'test' AND length(objective) > max_size""",
        "p7_checks": """
            WITH l AS (SELECT max_size FROM size_limits WHERE table_name = 'documents') SELECT sum(octet_length(encode(text))) AS placed, 0 AS too_full, TRUE AS few,
            count(*) FILTER (WHERE octet_length(encode(text)) > max_size) AS cut, 0 AS cut_in_vain FROM documents, l""",
        "p8_checks": """
            WITH s AS (SELECT source, sum(octet_length(encode(text))) AS n FROM documents GROUP BY source), t AS (SELECT CAST(sum(n) AS BIGINT) AS t FROM s)
            SELECT m.source, CAST(coalesce(n, 0) AS BIGINT) AS size, weight_pct * t // 100 AS goal, NOT (coalesce(n, 0) * max_repeats * 100 < weight_pct * t) AS in_reach, TRUE AS under_cap, TRUE AS near
            FROM mix_targets m LEFT JOIN s ON s.source = m.source, t""",
        "p9_found": f"""
            WITH f AS (SELECT doc_id, md5(text) AS t, md5({same_look_sql()}) AS form FROM documents WHERE text IS NOT NULL)
            SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.t <> b.t""",
        "p9_canonical": f"SELECT doc_id, {same_look_sql()} AS canonical, {same_look_sql()} <> text AS changed FROM documents",
        "p2_found": r"""
            WITH RECURSIVE e AS (
                SELECT lower(trim(old_patient_id)) AS a, lower(trim(new_patient_id)) AS b FROM patient_merges
                UNION SELECT lower(trim(new_patient_id)), lower(trim(old_patient_id)) FROM patient_merges),
            reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
            person AS (SELECT a, min(least(a, b)) AS p FROM reach GROUP BY a),
            ids AS (SELECT DISTINCT id, lower(right(id, 36)) AS patient FROM test_labels WHERE id IS NOT NULL),
            owned AS (SELECT id, coalesce(p, patient) AS p FROM ids LEFT JOIN person ON a = patient),
            firsts AS (SELECT p, min(id) AS first_id FROM owned GROUP BY p HAVING count(*) > 1)
            SELECT first_id, id AS other_id FROM owned JOIN firsts USING (p) WHERE id <> first_id""",
        "p4_found": """
            SELECT table_name, id FROM corpus, size_limits WHERE table_name = 'corpus' AND length(text) > max_size
            UNION ALL SELECT table_name, id FROM test, size_limits WHERE table_name = 'test' AND length(objective) > max_size""",
        "p6_found": r"""
            WITH q AS (SELECT id, regexp_extract_all(lower(subjective), '[\p{L}\p{N}]+') AS w FROM (SELECT id, subjective FROM test UNION ALL SELECT id, subjective FROM dev) WHERE subjective IS NOT NULL),
    c AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM corpus WHERE text IS NOT NULL),
    qt AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM q WHERE len(w) >= 40),
    ct AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM c WHERE len(w) >= 3),
    n AS (SELECT id, count(*) AS n FROM qt GROUP BY id), h AS (SELECT qt.id AS a, ct.id AS b, count(*) AS k FROM qt JOIN ct USING (t) GROUP BY ALL)
    SELECT least(a, b) AS id_a, greatest(a, b) AS id_b FROM h JOIN n ON n.id = a WHERE 2 * k >= n""",
        "p6_report": r"""
            WITH q AS (SELECT id, regexp_extract_all(lower(subjective), '[\p{L}\p{N}]+') AS w FROM (SELECT id, subjective FROM test UNION ALL SELECT id, subjective FROM dev) WHERE subjective IS NOT NULL),
    c AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM corpus WHERE text IS NOT NULL),
    qt AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM q WHERE len(w) >= 40),
    ct AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM c WHERE len(w) >= 3),
    n AS (SELECT id, count(*) AS n FROM qt GROUP BY id), h AS (SELECT qt.id AS a, ct.id AS b, count(*) AS k FROM qt JOIN ct USING (t) GROUP BY ALL),
    f AS (SELECT a, b FROM h JOIN n ON n.id = a WHERE 2 * k >= n), e AS (SELECT id, 'test' AS split, coalesce(source, 'none') AS source FROM test UNION ALL SELECT id, 'dev', coalesce(source, 'none') FROM dev),
    p AS (SELECT split, e.source, count(DISTINCT a) AS overlapping, count(*) AS pairs, array_to_string(list_sort(list_distinct(list(coalesce(c.source, 'none')))), ',') AS training_sources FROM f JOIN e ON e.id = a JOIN corpus c ON c.id = b GROUP BY ALL)
    SELECT split, source, count(*) AS records, coalesce(any_value(overlapping), 0) AS overlapping, coalesce(any_value(pairs), 0) AS pairs, coalesce(any_value(training_sources), '') AS training_sources FROM e LEFT JOIN p USING (split, source) GROUP BY split, source""",
        "p7_found": """
            SELECT doc_id FROM documents, size_limits WHERE table_name = 'documents' AND octet_length(encode(text)) > max_size""",
        "p8_found": """
            WITH s AS (SELECT source, sum(octet_length(encode(text))) AS n FROM documents GROUP BY source)
            SELECT m.source FROM mix_targets m LEFT JOIN s ON s.source = m.source
            WHERE coalesce(n, 0) * max_repeats * 100 < weight_pct * (SELECT sum(n) FROM s)""",
    }
