"""Sources, sinks, stores and streams over the tables: each query writes what it reads into the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.functions.text import joined_id
from cairnlight.plans.registry import query
from cairnlight.session import shared_dir, table
from cairnlight.sources import io
from cairnlight.streaming import incremental as S

ENCOUNTER_TEXT = ("id", "start", "stop", "patient", "encounterclass", "code", "description", "reasoncode", "reasondescription")
FILLED = ", ".join(f"coalesce({c}, '') AS {c}" for c in ENCOUNTER_TEXT)


def place(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def encounter_csv(spark: SparkSession, d: str) -> str:
    path = place(spark, "csv")
    io.write_csv_text(table(spark, d, "encounters").select(*ENCOUNTER_TEXT), path)
    return path


@query(f"SELECT {FILLED} FROM encounters")
def csv_scan_named(spark: SparkSession, d: str) -> DataFrame:
    """All columns as text by their names in the header."""
    return io.read_csv_text(spark, encounter_csv(spark, d))


@query("SELECT coalesce(id, '') AS a, coalesce(patient, '') AS b, coalesce(code, '') AS c FROM encounters")
def csv_scan_positional(spark: SparkSession, d: str) -> DataFrame:
    """Columns by place: first, fourth and sixth."""
    rows = io.read_csv_text(spark, encounter_csv(spark, d), [f"c{i}" for i in range(len(ENCOUNTER_TEXT))])
    return rows.select(F.col("c0").alias("a"), F.col("c3").alias("b"), F.col("c5").alias("c"))


@query(f"SELECT patient, count(*) AS n FROM (SELECT {FILLED} FROM encounters) GROUP BY patient ORDER BY patient LIMIT 20")
def csv_canonical_sink(spark: SparkSession, d: str) -> DataFrame:
    """Rows written in the order of all columns: the files are ranges in order, so the first patients are those of the first files (a report of twenty)."""
    path = place(spark, "sorted")
    rows = io.read_csv_text(spark, encounter_csv(spark, d)).select("patient", "encounterclass", "id", "code")
    io.write_csv_text(io.canonical(rows), path)
    return io.read_csv_text(spark, path).groupBy("patient").agg(F.count(F.lit(1)).alias("n")).orderBy("patient").limit(20)


def label_lines(spark: SparkSession, d: str) -> str:
    path = place(spark, "jsonl")
    table(spark, d, "test_labels").select("id", "condition", "bin", "plan").write.json(path)
    return path


LABEL_JSON = "id string, condition string, bin string, plan array<string>"


@query("SELECT id, condition, bin, len(plan) AS n FROM test_labels")
def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines with a declared schema."""
    rows = io.read_jsonl(spark, label_lines(spark, d), LABEL_JSON)
    return rows.select("id", "condition", "bin", F.when(F.col("plan").isNotNull(), F.size("plan")).alias("n"))


@query(r"""SELECT id, 'blank id' AS problem FROM test_labels WHERE id IS NULL OR trim(id) = '' UNION ALL SELECT id, 'repeated id' FROM test_labels WHERE id IS NOT NULL AND trim(id) <> '' GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT id, 'blank condition' FROM test_labels WHERE condition IS NULL OR trim(condition) = ''""")
def jsonl_validation(spark: SparkSession, d: str) -> DataFrame:
    """What breaks the rules of a label file: unique ids that aren't blank, conditions that aren't blank."""
    return io.validated(io.read_jsonl(spark, label_lines(spark, d), LABEL_JSON), "id", ["condition"])


@query("SELECT DISTINCT patient, id AS key, code, start FROM (SELECT patient, id, max(code) AS code, max(start) AS start FROM encounters WHERE patient IS NOT NULL AND id IS NOT NULL GROUP BY ALL)")
def json_map_scan(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object per patient, from encounter id to its code and start, and back to rows."""
    one = table(spark, d, "encounters").filter("patient is not null and id is not null").groupBy("patient", "id").agg(F.max("code").alias("code"), F.max("start").alias("start"))
    maps = one.groupBy("patient").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.struct("code", "start"))))).alias("j"))
    fields = F.from_json("j", "map<string, struct<code: string, start: string>>")
    return maps.select("patient", F.explode(fields).alias("key", "v")).select("patient", "key", "v.code", "v.start")


@query("""SELECT 'kept' AS step, count(*) AS n FROM encounters UNION ALL SELECT 'backup', count(*) FROM encounters UNION ALL SELECT 'replaced', count(DISTINCT patient) FROM encounters WHERE patient IS NOT NULL
    UNION ALL SELECT 'exists', 1 UNION ALL SELECT 'deleted', 0""")
def store_tables(spark: SparkSession, d: str) -> DataFrame:
    """A store of named tables on the shared file system: set, child, back up, replace, delete."""
    store = io.Store(spark, place(spark, "store"))
    encounters = table(spark, d, "encounters")
    store.set("encounters", encounters)
    kept = store.get("encounters").agg(F.lit("kept").alias("step"), F.count(F.lit(1)).alias("n"))
    backup = store.backup(["encounters"]).get("encounters").agg(F.lit("backup").alias("step"), F.count(F.lit(1)).alias("n"))
    other = store.child("other")
    other.set("encounters", encounters.select("patient").filter("patient is not null").distinct())
    replaced = other.get("encounters").agg(F.lit("replaced").alias("step"), F.count(F.lit(1)).alias("n"))
    other.set("gone", spark.range(3))
    other.delete("gone")
    flags = spark.createDataFrame([("exists", int(store.has("encounters"))), ("deleted", int(other.has("gone")))], "step string, n bigint")
    return kept.unionByName(backup).unionByName(replaced).unionByName(flags)


@query("""SELECT patient, CAST(coalesce(substr(start, 1, 10), '') AS VARCHAR) AS day, count(*) AS n FROM encounters WHERE patient IS NOT NULL AND regexp_full_match(substr(start, 1, 10), '\\d{4}-\\d{2}-\\d{2}')
    AND try_cast(substr(start, 1, 10) AS DATE) IS NOT NULL GROUP BY ALL""".replace("\\\\", "\\"))
def note_file_scan(spark: SparkSession, d: str) -> DataFrame:
    """Notes of a patient, an entry for each encounter behind a line with its day, split again at these lines."""
    day = F.substring("start", 1, 10)
    e = table(spark, d, "encounters").filter("patient is not null").filter(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & day.try_cast("date").isNotNull())
    entry = F.concat(day, F.lit("\n"), F.coalesce("description", F.lit("")), F.lit("\nseen on "), day, F.lit("\n\n"))
    notes = e.groupBy("patient").agg(F.concat(F.lit("Name: one\n\n"), F.array_join(F.array_sort(F.collect_list(entry)), "")).alias("text"))
    entries = io.note_entries(notes, "patient", "text").filter("day is not null")
    return entries.groupBy("patient", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


DOCUMENTS = "SELECT '{0}' AS kind, count(*) AS n, count(DISTINCT {1}) AS titles, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL AND text <> ''"


@query("WITH x AS (SELECT 1) " + " UNION ALL ".join(DOCUMENTS.format(k, "doc_id") for k in ("csv", "json", "parquet")) + " UNION ALL SELECT 'text', count(*), 25, CAST(sum(length(n_name)) AS BIGINT) FROM nation")
def document_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents written in each format and loaded by the factory: how many, how many titles, how long; texts as one file each."""
    docs = table(spark, d, "documents").filter("text is not null and text <> ''").select(F.col("doc_id").cast("string").alias("name"), F.regexp_replace("text", "\r\n?", "\n").alias("body"), F.char_length("text").alias("chars"))
    out, lengths = None, docs.select("name", "chars")
    for kind in ("csv", "json", "parquet"):
        path = place(spark, kind)
        rows = docs.select("name", "body")
        if kind == "csv":
            io.write_csv_text(rows, path)
        elif kind == "json":
            rows.write.json(path)
        else:
            rows.write.parquet(path)
        loaded = io.read_documents(spark, path, "csv" if kind == "csv" else kind, text="body", title="name", lines=kind == "json")
        one = loaded.join(lengths, loaded["title"] == lengths["name"]).agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("titles"), F.sum("chars").alias("chars")
        )
        out = one if out is None else out.unionByName(one)
    path = place(spark, "text")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).repartition(25, "k").write.partitionBy("k").option("lineSep", "\n").text(path)
    texts = io.read_documents(spark, path, "text", pattern="*.txt")
    return out.unionByName(texts.agg(F.lit("text").alias("kind"), F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("titles"), F.sum(F.char_length(F.regexp_replace("text", "\n$", "")).cast("bigint")).alias("chars")))


@query("SELECT id, upper(min(condition)) AS reply, 1 AS revision FROM test_labels WHERE id IS NOT NULL AND condition IS NOT NULL GROUP BY id")
def reply_cache(spark: SparkSession, d: str) -> DataFrame:
    """Replies computed once: the first call makes half of the keys, the second one what is missing, and reads the rest from the log."""
    keys = table(spark, d, "test_labels").filter("id is not null and condition is not null").groupBy("id").agg(F.min("condition").alias("condition"))
    log = io.KeyedLog(spark, place(spark, "log"), ["id"])
    make = lambda df: df.select("id", F.upper("condition").alias("reply"), F.lit(1).alias("revision"))
    log.compute(keys.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == 0), make)
    return log.compute(keys, make).select("id", "reply", "revision")


@query("SELECT result_id % 97 AS job, max(revision) AS revision, count(*) FILTER (WHERE status = 'completed') AS done FROM results GROUP BY 1")
def job_log_states(spark: SparkSession, d: str) -> DataFrame:
    """A job store: rows appended in any order, the state of a job is its highest revision; beside it what was done in all."""
    rows = table(spark, d, "results").select((F.col("result_id") % 97).alias("job"), "revision", "status")
    log = io.KeyedLog(spark, place(spark, "jobs"), ["job"])
    log.save(rows.groupBy("job", "revision").agg(F.count_if(F.col("status") == "completed").alias("n")))
    done = rows.groupBy("job").agg(F.count_if(F.col("status") == "completed").alias("done"))
    return log.latest().select("job", "revision").join(done, "job")


@query("SELECT DISTINCT code, sha256(code) AS digest, substr(sha1(coalesce(description, '')), 1, 6) AS short FROM observations WHERE code IS NOT NULL")
def hashed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes: SHA-256 of a code, the short SHA-1 of a description."""
    o = table(spark, d, "observations").filter("code is not null").select("code", F.coalesce("description", F.lit("")).alias("t")).distinct()
    return o.select("code", F.sha2("code", 256).alias("digest"), F.substring(F.sha1("t"), 1, 6).alias("short")).distinct()


@query("SELECT count(*) AS n, count(DISTINCT coalesce(text, '') || coalesce(CAST(doc_id AS VARCHAR), '')) AS ids, 128 AS length FROM documents")
def long_ids(spark: SparkSession, d: str) -> DataFrame:
    """SHA-512 ids over several columns: as many as there are different rows, 128 hexadecimal digits each."""
    ids = table(spark, d, "documents").select(joined_id("text", "doc_id").alias("id"))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.max(F.char_length("id")).alias("length"))


@query("""WITH x AS (SELECT encounter AS unit, list_sort(list_distinct(list(code))) AS codes FROM observations WHERE encounter IS NOT NULL AND code IS NOT NULL GROUP BY 1)
    SELECT unit, len(codes) AS n, codes[1] AS first, codes[len(codes)] AS last FROM x""")
def array_sets(spark: SparkSession, d: str) -> DataFrame:
    """Lists made, exploded, made distinct and sorted again."""
    o = table(spark, d, "observations").filter("encounter is not null and code is not null").groupBy(F.col("encounter").alias("unit")).agg(F.collect_list("code").alias("codes"))
    again = o.select("unit", F.explode("codes").alias("code")).groupBy("unit").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return again.select("unit", F.size("codes").alias("n"), F.col("codes")[0].alias("first"), F.element_at("codes", -1).alias("last"))


@query("""WITH x AS (SELECT patient, code, count(*) AS n, max(value) AS top FROM observations WHERE patient IS NOT NULL AND code IS NOT NULL GROUP BY ALL)
    SELECT patient, count(*) AS details, CAST(sum(n) AS BIGINT) AS mentions, max(code) AS last_code FROM x GROUP BY patient""")
def struct_packing(spark: SparkSession, d: str) -> DataFrame:
    """Details packed as structs into one list per entity, and read from it again."""
    x = table(spark, d, "observations").filter("patient is not null and code is not null").groupBy("patient", "code").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    packed = x.groupBy("patient").agg(F.array_sort(F.collect_list(F.struct("code", "n", "top"))).alias("details"))
    return packed.select(
        "patient", F.size("details").alias("details"), F.aggregate("details", F.lit(0).cast("bigint"), lambda a, s: a + s["n"]).alias("mentions"), F.element_at("details", -1)["code"].alias("last_code")
    )


@query("""SELECT DISTINCT source AS document, 'reports' AS list, id AS record FROM corpus WHERE source IS NOT NULL UNION ALL SELECT DISTINCT source, 'sources', id FROM test WHERE source IS NOT NULL""")
def context_lists(spark: SparkSession, d: str) -> DataFrame:
    """A context by name (reports, entities, relationships, claims, sources) as five lists of records; names without a table are empty lists."""
    side = lambda name: table(spark, d, name).filter("source is not null").select(F.col("source").alias("document"), "id").distinct()
    none = spark.createDataFrame([], "document string, id string")
    given = {"reports": side("corpus"), "sources": side("test")}
    out = None
    for name in ("reports", "entities", "relationships", "claims", "sources"):
        part = given.get(name, none).select("document", F.lit(name).alias("list"), F.col("id").alias("record"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of the event stream, run to the end of the source; the sink is a table in the shared folder."""
    path = place(spark, "events")
    table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(path)
    store = io.Store(spark, place(spark, "windows"))

    def step(batch: DataFrame, number: int) -> None:
        """Windows of one batch, merged with those of the batches before it."""
        now = S.windowed_counts(batch, "ts", ["event_type"], "value")
        if number and store.has(f"w-{number - 1}"):
            now = now.unionByName(store.get(f"w-{number - 1}")).groupBy("start", "end", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        store.set(f"w-{number}", now)

    run = S.per_batch(stream, step, place(spark, "check"))
    run.awaitTermination()
    last = run.lastProgress["batchId"] if run.lastProgress else 0
    got = store.get(f"w-{last}")
    return got.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, min(ts) AS cutoff FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def stream_first_purchase(spark: SparkSession, d: str) -> DataFrame:
    """Cutoffs kept up by micro-batches, one file each: the first purchase of every user."""
    path = place(spark, "events")
    table(spark, d, "events").select("user_id", "ts", "event_type").repartition(4).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    inc = S.IncrementalMin(io.Store(spark, place(spark, "state")), "user_id", "ts", F.col("event_type") == "purchase")
    run = inc.start(stream, place(spark, "check"))
    run.awaitTermination()
    return inc.state(run.lastProgress["batchId"]).select("user_id", "cutoff")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, ts, event_id FROM r WHERE k = 1""")
def stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of every user, merged batch by batch."""
    path = place(spark, "events")
    table(spark, d, "events").select("user_id", "ts", "event_id").repartition(3).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    inc = S.IncrementalLatest(io.Store(spark, place(spark, "state")), ["user_id"], ["ts", "event_id"], [])
    run = inc.start(stream, place(spark, "check"))
    run.awaitTermination()
    return inc.state(run.lastProgress["batchId"]).select("user_id", "ts", "event_id")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events less than six hours apart."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.sessions(e, "ts", "user_id", gap="6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
