"""Cohort queries over encounters and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlight.functions.dates import age_on, local_date, loose_date, relative_time, shifted_birthday, year_age
from cairnlight.functions.stats import normal_p, proportion_difference_ci
from cairnlight.functions.text import person_uuid, plain_number, times_text, without_tag
from cairnlight.operators import cohort as C
from cairnlight.plans.registry import query
from cairnlight.session import table, written

#: The reason code whose first encounter is the diagnosis in these queries.
TARGET = "710168"


def day_sql(c: str) -> str:
    return rf"""(CASE WHEN regexp_full_match({c}, '\d{{4}}-\d{{2}}-\d{{2}}') OR regexp_full_match({c}, '\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}Z?')
        THEN try_cast(substr({c}, 1, 10) AS DATE) END)"""


CUTOFFS = f"cutoffs AS (SELECT patient, min({day_sql('start')}) AS cutoff FROM encounters WHERE reasoncode = '{TARGET}' AND patient IS NOT NULL GROUP BY patient HAVING min({day_sql('start')}) IS NOT NULL)"


def encounters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "encounters")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "observations")


def cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return C.first_dates(encounters(spark, d), "patient", local_date("start"), F.col("reasoncode") == TARGET)


@query(f"WITH {CUTOFFS} SELECT patient, cutoff FROM cutoffs")
def cohort_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return cutoffs(spark, d)


@query(f"""WITH {CUTOFFS}, o AS (SELECT patient, min({day_sql('date')}) AS o FROM observations WHERE code = '9317-9' GROUP BY patient)
    SELECT c.patient, least(c.cutoff, o) AS cutoff FROM cutoffs c LEFT JOIN o ON o.patient = c.patient""")
def cohort_cutoffs_pulled(spark: SparkSession, d: str) -> DataFrame:
    more = C.first_dates(observations(spark, d), "patient", local_date("date"), F.col("code") == "9317-9")
    return C.pulled_cutoffs(cutoffs(spark, d), [more], "patient")


@query(f"""WITH f AS (SELECT patient, {day_sql('start')} AS d, reasoncode, reasondescription FROM encounters WHERE reasoncode IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY d, reasoncode, reasondescription) AS k FROM f WHERE d IS NOT NULL)
    SELECT patient, d AS cutoff, reasoncode, reasondescription FROM r WHERE k = 1 AND patient IS NOT NULL""")
def cohort_first_label(spark: SparkSession, d: str) -> DataFrame:
    rows = encounters(spark, d).filter("reasoncode is not null and patient is not null").withColumn("d", local_date("start"))
    first = C.first_target_row(rows, "patient", "d", ["reasoncode", "reasondescription"], [])
    return first


@query(f"""WITH {CUTOFFS} SELECT o.patient, o.code, count(*) AS n FROM observations o LEFT JOIN cutoffs c ON c.patient = o.patient
    WHERE cutoff IS NULL OR {day_sql('date')} IS NULL OR {day_sql('date')} < cutoff GROUP BY ALL""")
def cohort_history_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = C.before_cutoff(observations(spark, d), cutoffs(spark, d), "patient", local_date("date"))
    return kept.groupBy("patient", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CUTOFFS}, gone AS (SELECT DISTINCT e.id FROM encounters e JOIN cutoffs c ON c.patient = e.patient WHERE {day_sql('start')} >= cutoff)
    SELECT category, count(*) AS n FROM observations o WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.id = o.encounter) GROUP BY category""")
def cohort_dropped_encounters(spark: SparkSession, d: str) -> DataFrame:
    gone = encounters(spark, d).withColumn("d", local_date("start")).join(cutoffs(spark, d), "patient").filter("d >= cutoff")
    return C.without_linked(observations(spark, d), gone, "encounter").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CUTOFFS} SELECT e.id, e.start, CASE WHEN cutoff IS NOT NULL AND {day_sql('stop')} >= cutoff THEN '' ELSE e.stop END AS stop
    FROM encounters e LEFT JOIN cutoffs c ON c.patient = e.patient""")
def cohort_blanked_stops(spark: SparkSession, d: str) -> DataFrame:
    rows = encounters(spark, d).join(cutoffs(spark, d), "patient", "left")
    return rows.select("id", "start", C.blanked_after(F.col("stop"), local_date("stop"), F.col("cutoff")).alias("stop"))


@query(f"""SELECT patient, min(date) AS problem FROM observations WHERE date IS NOT NULL AND trim(date) <> '' AND {day_sql('date')} IS NULL AND patient IS NOT NULL GROUP BY patient""")
def cohort_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return C.quarantine(observations(spark, d), "patient", "date", local_date("date"))


STRATA = f"""firsts AS (SELECT patient, year(min({day_sql('start')})) AS y FROM encounters WHERE patient IS NOT NULL GROUP BY patient HAVING min({day_sql('start')}) IS NOT NULL)"""
MATCHED = f"""{CUTOFFS}, {STRATA},
    p AS (SELECT patient, y, row_number() OVER (PARTITION BY y ORDER BY patient) AS k FROM firsts WHERE patient IN (SELECT patient FROM cutoffs)),
    n AS (SELECT patient, y, row_number() OVER (PARTITION BY y ORDER BY patient) AS k FROM firsts WHERE patient NOT IN (SELECT patient FROM cutoffs)),
    matched AS (SELECT n.patient AS control, p.patient AS positive, n.y FROM n JOIN p ON p.y = n.y AND p.k = (n.k - 1) // 3 + 1)"""


def strata(spark: SparkSession, d: str) -> DataFrame:
    days = encounters(spark, d).filter("patient is not null").groupBy("patient").agg(F.min(local_date("start")).alias("d"))
    return days.filter("d is not null").select("patient", F.year("d").alias("y"))


def matched(spark: SparkSession, d: str) -> DataFrame:
    all_, cut = strata(spark, d), cutoffs(spark, d)
    return C.matched_controls(all_.join(cut, "patient", "left_semi"), all_.join(cut, "patient", "left_anti"), "patient", ["y"])


@query(f"WITH {MATCHED} SELECT control, positive, y FROM matched")
def cohort_matched_controls(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d)


def cases(spark: SparkSession, d: str) -> DataFrame:
    """(patient, cutoff, positive) of positives and their controls; a control has its positive's cutoff."""
    cut = cutoffs(spark, d)
    controls = matched(spark, d).join(cut.withColumnRenamed("patient", "positive"), "positive").select(F.col("control").alias("patient"), "cutoff", F.lit(False).alias("positive"))
    return cut.withColumn("positive", F.lit(True)).unionByName(controls)


CASES = f"""{MATCHED}, cases AS (SELECT patient, cutoff, 1 AS pos FROM cutoffs UNION ALL SELECT control, c.cutoff, 0 FROM matched m JOIN cutoffs c ON c.patient = m.positive),
    feats AS (SELECT DISTINCT o.patient, 'obs:' || code AS feature FROM observations o JOIN cases c ON c.patient = o.patient WHERE {day_sql('date')} < cutoff
        UNION SELECT DISTINCT e.patient, 'enc:' || code FROM encounters e JOIN cases c ON c.patient = e.patient WHERE {day_sql('start')} < cutoff
        UNION SELECT DISTINCT e.patient, 'reason:' || reasoncode FROM encounters e JOIN cases c ON c.patient = e.patient WHERE {day_sql('start')} < cutoff),
    f AS (SELECT patient, feature FROM feats WHERE feature IS NOT NULL),
    cont AS (SELECT feature, sum(pos) AS a, sum(1 - pos) AS b, (SELECT sum(pos) FROM cases) AS np, (SELECT sum(1 - pos) FROM cases) AS nn FROM f JOIN cases USING (patient) GROUP BY feature)"""


def features(spark: SparkSession, d: str, who: DataFrame) -> DataFrame:
    """Distinct (patient, feature) strictly before the patient's cutoff, for cases and controls."""
    obs = observations(spark, d).select("patient", local_date("date").alias("d"), F.concat(F.lit("obs:"), "code").alias("feature"))
    enc = encounters(spark, d).select(
        "patient", local_date("start").alias("d"), F.explode(F.array(F.concat(F.lit("enc:"), "code"), F.concat(F.lit("reason:"), "reasoncode"))).alias("feature")
    )
    return obs.unionByName(enc).join(who, "patient").filter("d < cutoff and feature is not null").select("patient", "feature").distinct()


def contingency(spark: SparkSession, d: str) -> DataFrame:
    who = written(cases(spark, d))
    return C.contingency(features(spark, d, who), who.select("patient", "positive"), "patient", "feature", "positive")


@query(f"""WITH {CASES} SELECT feature, a AS n_pos_with, b AS n_neg_with, round(a / np, 6) AS p_pos, round(b / nn, 6) AS p_neg,
    round(CASE WHEN (a + b) > 0 AND (a + b) < np + nn THEN (a / np - b / nn) / sqrt((a + b) / (np + nn) * (1 - (a + b) / (np + nn)) * (1 / np + 1 / nn)) END, 6) AS z FROM cont""")
def flagship_screen(spark: SparkSession, d: str) -> DataFrame:
    s = C.screen(contingency(spark, d), "feature")
    return s.select("feature", "n_pos_with", "n_neg_with", *[F.round(c, 6).alias(c) for c in ("p_pos", "p_neg", "z")])


@query(f"""WITH {CASES}, zs AS (SELECT feature, CASE WHEN (a + b) > 0 AND (a + b) < np + nn THEN (a / np - b / nn) / sqrt((a + b) / (np + nn) * (1 - (a + b) / (np + nn)) * (1 / np + 1 / nn)) END AS z FROM cont),
    ps AS (SELECT feature, z, greatest(0.0, 1 - 2 * abs(z) / 3000 / sqrt(2 * pi()) * list_sum(list_transform(generate_series(0, 1000), lambda i: (CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * i / 1000, 2) / 2)))) AS p FROM zs)
    SELECT feature, round(z, 2) AS z, round(p, 4) AS p, round(least(1.0, p * (SELECT count(*) FROM ps)), 4) AS p_bonferroni FROM ps""")
def screen_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided p of each feature and its Bonferroni correction; the SQL integrates the normal density by Simpson's rule."""
    s = C.screen(contingency(spark, d), "feature")
    n = s.count()
    p = s.withColumn("p", normal_p("z"))
    return p.select("feature", F.round("z", 2).alias("z"), F.round("p", 4).alias("p"), F.round(F.least(F.lit(1.0), F.col("p") * n), 4).alias("p_bonferroni"))


@query(f"""WITH {CASES} SELECT feature, round(a / np - b / nn - 1.96 * sqrt(a / np * (1 - a / np) / np + b / nn * (1 - b / nn) / nn), 6) AS low,
    round(a / np - b / nn + 1.96 * sqrt(a / np * (1 - a / np) / np + b / nn * (1 - b / nn) / nn), 6) AS high FROM cont""")
def screen_intervals(spark: SparkSession, d: str) -> DataFrame:
    low, high = proportion_difference_ci(F.col("n_pos_with"), F.col("n_pos"), F.col("n_neg_with"), F.col("n_neg"))
    return contingency(spark, d).select("feature", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def cohort_nearest_controls(spark: SparkSession, d: str) -> DataFrame:
    """Greedy matching on the first year within ten years, per class of the first encounter: order-dependent, tested on a fixture."""
    who = encounters(spark, d).filter("patient is not null").groupBy("patient").agg(F.min(F.struct(local_date("start").alias("d"), "encounterclass")).alias("f"))
    who = who.filter("f.d is not null").select("patient", F.coalesce("f.encounterclass", F.lit("")).alias("g"), F.year("f.d").alias("y"))
    cut = cutoffs(spark, d)
    return C.nearest_controls(who.join(cut, "patient", "left_semi"), who.join(cut, "patient", "left_anti"), "patient", "g", "y")


@query(f"""WITH {CUTOFFS}, e AS (SELECT DISTINCT patient, {day_sql('start')} AS b FROM encounters WHERE code = '30100002')
    SELECT patient, cutoff, max(b) AS episode, cutoff - max(b) AS distance, cutoff - max(b) <= 365 * 7 AS in_window
    FROM cutoffs JOIN e USING (patient) WHERE b <= cutoff GROUP BY patient, cutoff""")
def cohort_pick_episode(spark: SparkSession, d: str) -> DataFrame:
    episodes = encounters(spark, d).filter("code = '30100002'").select("patient", local_date("start").alias("b"))
    return C.picked_episode(cutoffs(spark, d), episodes, "patient", "cutoff", "b", 365 * 7)


@query(f"""WITH {CUTOFFS} SELECT o.patient, o.code, max(value) AS value FROM observations o JOIN cutoffs c ON c.patient = o.patient AND {day_sql('date')} = cutoff
    WHERE category = 'vital-signs' GROUP BY ALL""")
def cohort_same_day_vitals(spark: SparkSession, d: str) -> DataFrame:
    vitals = observations(spark, d).filter("category = 'vital-signs'").withColumn("cutoff", local_date("date"))
    return vitals.join(cutoffs(spark, d), ["patient", "cutoff"]).groupBy("patient", "code").agg(F.max("value").alias("value"))


@query(f"""WITH {CUTOFFS} SELECT c.patient, count(e.id) AS n_prior FROM cutoffs c LEFT JOIN (SELECT DISTINCT id, patient, start FROM encounters) e
    ON e.patient = c.patient AND {day_sql('e.start')} < cutoff GROUP BY c.patient""")
def cohort_prior_encounters(spark: SparkSession, d: str) -> DataFrame:
    e = encounters(spark, d).select("id", "patient", local_date("start").alias("d"), "start").distinct()
    prior = e.join(cutoffs(spark, d), "patient").filter("d < cutoff").groupBy("patient").agg(F.count("id").alias("n"))
    return cutoffs(spark, d).join(prior, "patient", "left").select("patient", F.coalesce("n", F.lit(0)).alias("n_prior"))


@query(f"""WITH x AS (SELECT patient, {day_sql('start')} AS d, reasoncode FROM encounters WHERE reasoncode IS NOT NULL),
    f AS (SELECT patient, reasoncode, min(d) AS d FROM x WHERE d IS NOT NULL AND patient IS NOT NULL GROUP BY ALL)
    SELECT patient, count(*) AS diagnoses, count(DISTINCT d) AS days FROM f GROUP BY patient HAVING count(*) <> count(DISTINCT d)""")
def cohort_same_day_diagnoses(spark: SparkSession, d: str) -> DataFrame:
    rows = encounters(spark, d).filter("reasoncode is not null and patient is not null").select("patient", "reasoncode", local_date("start").alias("d"))
    first = rows.filter("d is not null").groupBy("patient", "reasoncode").agg(F.min("d").alias("d"))
    return first.groupBy("patient").agg(F.count(F.lit(1)).alias("diagnoses"), F.countDistinct("d").alias("days")).filter("diagnoses <> days")


@query("""SELECT reasondescription, count(DISTINCT patient) AS patients FROM encounters WHERE reasondescription IS NOT NULL
    GROUP BY reasondescription ORDER BY patients DESC, reasondescription LIMIT 5""")
def cohort_top_conditions(spark: SparkSession, d: str) -> DataFrame:
    n = encounters(spark, d).filter("reasondescription is not null").groupBy("reasondescription").agg(F.countDistinct("patient").alias("patients"))
    return n.orderBy(F.desc("patients"), "reasondescription").limit(5)


@query(f"""SELECT code, min({day_sql('start')}) AS first, max({day_sql('start')}) AS last, count(*) AS n, bool_or(stop IS NULL OR stop = '') AS any_open FROM encounters GROUP BY code""")
def serial_collapse(spark: SparkSession, d: str) -> DataFrame:
    day = local_date("start")
    return encounters(spark, d).groupBy("code").agg(
        F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("stop").isNull() | (F.col("stop") == "")).alias("any_open")
    )


@query(f"""WITH o AS (SELECT DISTINCT patient, code, {day_sql('date')} AS d, value FROM observations WHERE patient IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY patient, code ORDER BY d DESC, value DESC NULLS LAST) AS k FROM o WHERE d IS NOT NULL)
    SELECT patient, code, string_agg(value, ', ' ORDER BY k) AS latest FROM r WHERE k <= 3 AND value IS NOT NULL GROUP BY patient, code""")
def serial_latest_values(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).filter("patient is not null").select("patient", "code", local_date("date").alias("d"), "value").distinct().filter("d is not null")
    w = Window.partitionBy("patient", "code").orderBy(F.desc("d"), F.desc_nulls_last("value"))
    top = rows.withColumn("k", F.row_number().over(w)).filter("k <= 3 and value is not null")
    ordered = F.array_sort(F.collect_list(F.struct("k", "value")))
    return top.groupBy("patient", "code").agg(F.array_join(F.transform(ordered, lambda s: s["value"]), ", ").alias("latest"))


@query(f"""WITH g AS (SELECT patient, encounterclass, description, max({day_sql('start')}) AS last, count(*) AS n FROM encounters WHERE patient IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY last DESC NULLS LAST, encounterclass, description) AS k FROM g)
    SELECT patient, encounterclass, description, last, n FROM r WHERE k <= 4""")
def serial_encounter_groups(spark: SparkSession, d: str) -> DataFrame:
    g = encounters(spark, d).filter("patient is not null").groupBy("patient", "encounterclass", "description").agg(F.max(local_date("start")).alias("last"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("patient").orderBy(F.desc_nulls_last("last"), "encounterclass", "description")
    return g.withColumn("k", F.row_number().over(w)).filter("k <= 4").drop("k")


@query(f"""WITH e AS (SELECT DISTINCT patient, {day_sql('start')} AS d, code FROM encounters WHERE patient IS NOT NULL), l AS (SELECT patient, max(d) AS m FROM e GROUP BY patient)
    SELECT patient, count(*) AS n FROM e JOIN l USING (patient) WHERE d >= make_date(year(m) - 3, month(m), least(day(m), 28)) GROUP BY patient""")
def cohort_rolling_history(spark: SparkSession, d: str) -> DataFrame:
    e = encounters(spark, d).filter("patient is not null").select("patient", local_date("start").alias("d"), "code").distinct()
    return C.rolling_history(e, "patient", "d", 3).groupBy("patient").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT id, {day_sql('start')} AS day, try_cast(substr(start, 1, 10) AS DATE) AS loose,
    year(DATE '2026-01-01') - year({day_sql('start')}) AS years, 2026 - year({day_sql('start')}) - CASE WHEN month({day_sql('start')}) * 100 + day({day_sql('start')}) > 630 THEN 1 ELSE 0 END AS age,
    least(make_date(year({day_sql('start')}) + 5, month({day_sql('start')}), CASE WHEN month({day_sql('start')}) = 2 AND day({day_sql('start')}) = 29 THEN 28 ELSE day({day_sql('start')}) END), DATE '2026-06-30') AS shifted,
    CASE WHEN (DATE '2026-06-30' - {day_sql('start')}) < 31 THEN (DATE '2026-06-30' - {day_sql('start')}) || CASE WHEN (DATE '2026-06-30' - {day_sql('start')}) = 1 THEN ' day ago' ELSE ' days ago' END
      WHEN (DATE '2026-06-30' - {day_sql('start')}) < 365 THEN (DATE '2026-06-30' - {day_sql('start')}) // 30 || CASE WHEN (DATE '2026-06-30' - {day_sql('start')}) // 30 = 1 THEN ' month ago' ELSE ' months ago' END
      ELSE (DATE '2026-06-30' - {day_sql('start')}) // 365 || CASE WHEN (DATE '2026-06-30' - {day_sql('start')}) // 365 = 1 THEN ' year ago' ELSE ' years ago' END END AS ago
    FROM encounters WHERE {day_sql('start')} IS NOT NULL""")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = encounters(spark, d).withColumn("day", local_date("start")).filter("day is not null")
    ref = F.lit("2026-06-30").cast("date")
    return rows.select(
        "id", "day", loose_date("start").alias("loose"), year_age("day", F.lit("2026-01-01").cast("date")).alias("years"), age_on("day", ref).alias("age"),
        shifted_birthday("day", F.lit(5), ref).alias("shifted"), relative_time("day", ref).alias("ago"),
    )


@query(f"""SELECT 'encounters' AS source, count(*) AS n FROM encounters WHERE {day_sql('start')} > {day_sql('stop')}
    UNION ALL SELECT 'observations', count(*) FROM observations o JOIN (SELECT id, min({day_sql('start')}) AS s FROM encounters GROUP BY id) e ON e.id = o.encounter WHERE {day_sql('o.date')} < s""")
def quality_date_violations(spark: SparkSession, d: str) -> DataFrame:
    e = encounters(spark, d)
    a = e.filter(local_date("start") > local_date("stop")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("encounters").alias("source"), "n")
    starts = e.groupBy(F.col("id").alias("encounter")).agg(F.min(local_date("start")).alias("s"))
    b = observations(spark, d).join(starts, "encounter").filter(local_date("date") < F.col("s")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b.select(F.lit("observations").alias("source"), "n"))


@query(f"""WITH x AS (SELECT patient, {day_sql('date')} AS d, try_cast(value AS DOUBLE) AS v FROM observations WHERE code = '9278-6' AND patient IS NOT NULL)
    SELECT patient, round(regr_slope(v, d - DATE '2000-01-01') * 365.25, 6) AS slope, CASE WHEN regr_slope(v, d - DATE '2000-01-01') * 365.25 > 1 THEN 'rising'
        WHEN regr_slope(v, d - DATE '2000-01-01') * 365.25 < -1 THEN 'falling' ELSE 'stable' END AS trend
    FROM x WHERE v IS NOT NULL AND d IS NOT NULL GROUP BY patient HAVING count(DISTINCT d) > 1""")
def review_slopes(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).filter("code = '9278-6' and patient is not null").select("patient", local_date("date").alias("d"), F.col("value").try_cast("double").alias("v"))
    rows = rows.filter("d is not null and v is not null").withColumn("x", F.datediff("d", F.lit("2000-01-01")).cast("double"))
    s = rows.groupBy("patient").agg((F.regr_slope("v", "x") * 365.25).alias("s"), F.countDistinct("d").alias("n")).filter("n > 1")
    return s.select("patient", F.round("s", 6).alias("slope"), F.when(F.col("s") > 1, "rising").when(F.col("s") < -1, "falling").otherwise("stable").alias("trend"))


@query(f"""WITH {CUTOFFS} , r AS (SELECT o.patient, code, {day_sql('date')} AS d, value FROM observations o JOIN cutoffs c ON c.patient = o.patient WHERE {day_sql('date')} < cutoff)
    SELECT patient, code, max(d) AS d, arg_max(value, (d, value)) AS value FROM r WHERE value IS NOT NULL GROUP BY patient, code""")
def review_latest_reading(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).withColumn("d", local_date("date")).join(cutoffs(spark, d), "patient").filter("d < cutoff and value is not null")
    best = rows.groupBy("patient", "code").agg(F.max(F.struct("d", "value")).alias("m"))
    return best.select("patient", "code", "m.d", "m.value")


@query(f"""WITH e AS (SELECT DISTINCT patient, id, {day_sql('start')} AS d FROM encounters WHERE patient IS NOT NULL)
    SELECT patient, count(*) AS n, min(d) AS first, round((max(d) - min(d)) / 365.25, 4) AS years FROM e GROUP BY patient""")
def review_history_span(spark: SparkSession, d: str) -> DataFrame:
    e = encounters(spark, d).filter("patient is not null").select("patient", "id", local_date("start").alias("d")).distinct()
    return e.groupBy("patient").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.round(F.datediff(F.max("d"), F.min("d")) / 365.25, 4).alias("years")
    )


@query(f"""WITH e AS (SELECT id, any_value(patient) AS patient, min({day_sql('start')}) AS d FROM encounters WHERE id IS NOT NULL GROUP BY id),
    o AS (SELECT encounter, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM observations WHERE encounter IS NOT NULL GROUP BY encounter)
    SELECT e.id, d, coalesce(codes, '') AS codes FROM e LEFT JOIN o ON o.encounter = e.id""")
def review_timeline(spark: SparkSession, d: str) -> DataFrame:
    e = encounters(spark, d).filter("id is not null").groupBy("id").agg(F.min(local_date("start")).alias("d"))
    o = observations(spark, d).filter("encounter is not null").groupBy(F.col("encounter").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return e.join(o, "id", "left").select("id", "d", F.coalesce("codes", F.lit("")).alias("codes"))


@query(f"""WITH {CUTOFFS}, n AS (SELECT e.patient, cutoff, min({day_sql('start')}) AS nx FROM encounters e JOIN cutoffs c ON c.patient = e.patient WHERE {day_sql('start')} >= cutoff GROUP BY ALL)
    SELECT patient, cutoff, nx + INTERVAL 1 DAY AS shifted FROM n""")
def quality_shifted_cutoff(spark: SparkSession, d: str) -> DataFrame:
    rows = encounters(spark, d).withColumn("d", local_date("start")).join(cutoffs(spark, d), "patient").filter("d >= cutoff")
    return rows.groupBy("patient", "cutoff").agg(F.date_add(F.min("d"), 1).cast("timestamp_ntz").alias("shifted"))


@query(f"""WITH e AS (SELECT id, min({day_sql('start')}) AS d FROM encounters GROUP BY id), o AS (SELECT DISTINCT encounter, {day_sql('date')} AS d FROM observations WHERE encounter IS NOT NULL)
    SELECT count(*) AS n, sum(CASE WHEN o.d = e.d THEN 1 ELSE 0 END) AS same_day, round(sum(CASE WHEN o.d = e.d THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM o JOIN e ON e.id = o.encounter WHERE o.d IS NOT NULL AND e.d IS NOT NULL""")
def quality_zone_agreement(spark: SparkSession, d: str) -> DataFrame:
    e = encounters(spark, d).groupBy(F.col("id").alias("encounter")).agg(F.min(local_date("start")).alias("ed"))
    o = observations(spark, d).filter("encounter is not null").select("encounter", local_date("date").alias("od")).distinct()
    same = F.sum((F.col("od") == F.col("ed")).cast("int"))
    return o.join(e, "encounter").filter("od is not null and ed is not null").agg(F.count(F.lit(1)).alias("n"), same.alias("same_day"), F.round(same / F.count(F.lit(1)), 6).alias("rate"))


@query("""SELECT code, lower(trim(regexp_replace(description, '\\s*\\([^()]*\\)\\s*$', ''))) AS name, count(*) AS n, CASE WHEN count(*) = 1 THEN 'once' ELSE count(*) || ' times' END AS said
    FROM (SELECT reasoncode AS code, reasondescription AS description FROM encounters WHERE reasoncode IS NOT NULL) GROUP BY ALL""")
def serial_conditions(spark: SparkSession, d: str) -> DataFrame:
    rows = encounters(spark, d).filter("reasoncode is not null").groupBy(F.col("reasoncode").alias("code"), without_tag("reasondescription").alias("name"))
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("said", times_text("n"))


@query(r"""SELECT code, regexp_replace(value, '^(-?\d+)\.0+$', '\1') AS value, count(*) AS n FROM observations WHERE value IS NOT NULL GROUP BY ALL""")
def serial_values(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).filter("value is not null").groupBy("code", plain_number("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))




@query("""WITH n AS (SELECT condition, id, bin FROM (SELECT id, min(lower(trim(condition, chr(9) || ' '))) AS condition, min(bin) AS bin FROM test_labels WHERE id IS NOT NULL GROUP BY id) WHERE condition IS NOT NULL)
    SELECT condition, bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY condition), 4) AS pct FROM n GROUP BY condition, bin""")
def labels_class_balance(spark: SparkSession, d: str) -> DataFrame:
    named = F.lower(F.regexp_replace("condition", r"^\s+|\s+$", ""))
    one = table(spark, d, "test_labels").filter("id is not null").groupBy("id").agg(F.min(named).alias("condition"), F.min("bin").alias("bin")).filter("condition is not null")
    n = one.groupBy("condition", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("condition"))
    return n.select("condition", "bin", "n", F.round(100.0 * F.col("n") / total, 4).alias("pct"))


@query("""WITH u AS (SELECT id, min(lower(trim(condition, chr(9) || ' '))) AS condition, bool_or(coalesce(len(plan), 0) = 0) AS absent FROM test_labels WHERE id IS NOT NULL GROUP BY id)
    SELECT condition, count(*) AS n, round(avg(CASE WHEN absent THEN 1.0 ELSE 0.0 END), 6) AS absence_rate FROM u GROUP BY condition""")
def labels_absence_rate(spark: SparkSession, d: str) -> DataFrame:
    named = F.lower(F.regexp_replace("condition", r"^\s+|\s+$", ""))
    absent = F.bool_or(F.coalesce(F.size("plan"), F.lit(0)) <= 0)
    one = table(spark, d, "test_labels").filter("id is not null").groupBy("id").agg(F.min(named).alias("condition"), absent.alias("absent"))
    return one.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("absent").cast("double")), 6).alias("absence_rate"))


@query(r"""WITH l AS (SELECT DISTINCT lower(regexp_replace(coalesce(condition, ''), '^\s+|\s+$', '', 'g')) AS condition, lower(coalesce(nullif(regexp_extract(lower(trim(id)), '([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$', 1), ''), trim(id))) AS patient FROM test_labels WHERE id IS NOT NULL),
    c AS (SELECT condition, count(*) AS n FROM l GROUP BY condition), s AS (SELECT patient, min(struct_pack(n := n, condition := condition)).condition AS stratum FROM l JOIN c USING (condition) GROUP BY patient),
    r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(patient), patient) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM s)
    SELECT patient, stratum, CASE WHEN (k - 1) * 100.0 / n < 50 THEN 'train' WHEN (k - 1) * 100.0 / n < 70 THEN 'validation' ELSE 'test' END AS split FROM r""")
def labels_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """50/20/30 split of the labelled patients, each in the stratum of its rarest condition, in the order of the hash of the patient: all ids of a patient are on one side."""
    named = F.lower(F.regexp_replace(F.coalesce("condition", F.lit("")), r"^\s+|\s+$", ""))
    own = table(spark, d, "test_labels").filter("id is not null").select(named.alias("condition"), F.lower(person_uuid(F.trim("id"))).alias("patient")).distinct()
    rare = own.join(own.groupBy("condition").agg(F.count(F.lit(1)).alias("n")), "condition")
    stratum = rare.groupBy("patient").agg(F.min(F.struct("n", "condition"))["condition"].alias("stratum")).withColumn("key", F.concat(F.md5(F.col("patient").cast("binary")), "patient"))
    return C.stratified_split(stratum, "key", "stratum", [("train", 50), ("validation", 20), ("test", 30)], seed=None).select(F.expr("substring(key, 33)").alias("patient"), "stratum", "split")


@query("""WITH p AS (SELECT lower(trim(condition, chr(9) || ' ')) AS condition, unnest(plan) AS item FROM test_labels WHERE condition IS NOT NULL),
    n AS (SELECT condition, item, count(*) AS n FROM p WHERE item IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY n DESC, item) AS k FROM n)
    SELECT condition, item, n FROM r WHERE k <= 3""")
def labels_top_plan_items(spark: SparkSession, d: str) -> DataFrame:
    named = F.lower(F.regexp_replace("condition", r"^\s+|\s+$", ""))
    items = table(spark, d, "test_labels").filter("condition is not null").select(named.alias("condition"), F.explode("plan").alias("item")).filter("item is not null")
    n = items.groupBy("condition", "item").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("condition").orderBy(F.desc("n"), "item")
    return n.withColumn("k", F.row_number().over(w)).filter("k <= 3").drop("k")


@query("""WITH l AS (SELECT id, count(*) AS n FROM test_labels GROUP BY id), t AS (SELECT id, count(*) AS n FROM test GROUP BY id)
    SELECT CASE WHEN l.id IS NULL THEN 'missing_label' WHEN t.id IS NULL THEN 'extra_label' WHEN l.n > 1 THEN 'duplicate_label' ELSE 'ok' END AS state, count(*) AS n
    FROM l FULL JOIN t ON l.id = t.id GROUP BY state""")
def quality_id_sets(spark: SparkSession, d: str) -> DataFrame:
    label = table(spark, d, "test_labels").groupBy("id").agg(F.count(F.lit(1)).alias("nl"))
    test = table(spark, d, "test").groupBy("id").agg(F.count(F.lit(1)).alias("nt"))
    state = F.when(F.col("nl").isNull(), "missing_label").when(F.col("nt").isNull(), "extra_label").when(F.col("nl") > 1, "duplicate_label").otherwise("ok")
    return label.join(test, "id", "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
