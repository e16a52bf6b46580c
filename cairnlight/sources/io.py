"""Sources and sinks: CSV, JSON lines, JSON maps, Parquet tables, texts, notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlight.functions.text import joined_id


def read_csv_text(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, every value a string as it stands; a byte order mark is dropped; an empty value stays an empty text."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    rows = reader.csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])


def write_csv_text(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, \\n line ends and quotes only where needed; one_file for results known to be small."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").option("header", True).option("lineSep", "\n").option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def canonical(df: DataFrame) -> DataFrame:
    """Rows in the order of all columns from left to right: a range sort over the cluster."""
    return df.orderBy(*df.columns)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a declared schema; blank lines give no row, broken lines a row in _corrupt if the schema has it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def validated(df: DataFrame, id_column: str, required: list[str]) -> DataFrame:
    """(id, problem) of rows that break the rules: blank id, repeated id, blank required field. No rows: all is well."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    each = [df.filter(blank(id_column)).select(F.col(id_column).cast("string").alias("id"), F.lit("blank id").alias("problem"))]
    again = df.filter(~blank(id_column)).groupBy(F.col(id_column).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    each.append(again.select("id", F.lit("repeated id").alias("problem")))
    each += [df.filter(blank(c)).select(F.col(id_column).cast("string").alias("id"), F.lit(f"blank {c}").alias("problem")) for c in required]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def json_map_rows(df: DataFrame, column: str, value_schema: str, key: str = "key") -> DataFrame:
    """A JSON object of objects as rows: key and the fields of the value."""
    parsed = F.from_json(column, f"map<string, {value_schema}>")
    return df.select(F.explode(parsed).alias(key, "_v")).select(key, "_v.*")


def read_documents(spark: SparkSession, path: str, kind: str, text: str = "text", title: str | None = None, pattern: str | None = None, lines: bool = False) -> DataFrame:
    """Documents (id, title, text) from text, csv, json or parquet files below path; unreadable files are skipped, pattern is a glob of names, lines says that JSON is one object a line."""
    reader = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    if kind == "text":
        rows = reader.text(path, wholetext=True).select(F.col("value").alias("text"), name.alias("title"))
    elif kind == "csv":
        rows = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(F.col(text).alias("text"), (F.col(title) if title else name).alias("title"))
    elif kind == "json":
        rows = reader.option("multiLine", not lines).json(path).select(F.col(text).alias("text"), (F.col(title) if title else name).alias("title"))
    elif kind == "parquet":
        rows = reader.parquet(path).select(F.col(text).alias("text"), (F.col(title) if title else name).alias("title"))
    else:
        raise ValueError(f"unknown kind of documents: {kind}")
    return rows.select(joined_id("text", "title").alias("id"), "title", "text")


def note_entries(notes: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, place, day, entry) of notes: an entry starts with a line that is only a day, at the start or after a blank line. Place 0 without a day is the preamble."""
    parts = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"(?<=\n\n)(?=\d{4}-\d{2}-\d{2}[ \t]*(\n|$))|^(?=\d{4}-\d{2}-\d{2}[ \t]*(\n|$))")
    rows = notes.select(id_column, F.posexplode(parts).alias("place", "entry")).filter("entry <> ''")
    return rows.select(id_column, "place", F.regexp_extract("entry", r"^(\d{4}-\d{2}-\d{2})[ \t]*(\n|$)", 1).try_cast("date").alias("day"), "entry")


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def delete_table(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Store:
    """Named Parquet tables under one path of any Hadoop file system (local, hdfs://, s3a://, abfss://)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def child(self, name: str) -> Store:
        return Store(self.spark, f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        return table_exists(self.spark, f"{self.path}/{name}.parquet")

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def set(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}.parquet")

    def delete(self, name: str) -> None:
        delete_table(self.spark, f"{self.path}/{name}.parquet")

    def backup(self, names: list[str], to: str = "previous") -> Store:
        """Copies of the tables in a child store, made before an update."""
        other = self.child(to)
        for n in names:
            other.set(n, self.get(n))
        return other


class VectorStore(Store):
    """Vectors (id, text, vector, attributes) in one Parquet table; overwrite or append, exact search."""

    def load(self, df: DataFrame, overwrite: bool = True) -> None:
        df.select("id", "text", "vector", "attributes").write.mode("overwrite" if overwrite else "append").parquet(f"{self.path}/vectors.parquet")

    def search(self, query: list[float], k: int, ids: list[str] | None = None) -> DataFrame:
        """(id, text, score): the k largest 1 - |cosine distance|, among ids where given."""
        from cairnlight.functions.vectors import cosine

        rows = self.get("vectors")
        if ids is not None:
            rows = rows.filter(F.col("id").isin(ids))
        q = F.array(*[F.lit(float(x)) for x in query])
        scored = rows.select("id", "text", (1 - F.abs(1 - cosine(F.col("vector"), q))).alias("score"))
        return scored.filter("score is not null").orderBy(F.desc("score"), "id").limit(k)


class KeyedLog:
    """An append-only Parquet log with a revision; the latest row of a key is its state (job store, reply cache)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def save(self, rows: DataFrame) -> None:
        """Appends rows; only those with a revision above the stored one of their key count."""
        rows.write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        rest = [c for c in rows.columns if c not in (*self.keys, "revision")]
        m = rows.groupBy(*self.keys).agg(F.max(F.struct("revision", *rest)).alias("_m"))
        return m.select(*self.keys, "_m.*")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Rows of wanted whose key isn't in the log: what still has to be computed."""
        return wanted.join(self.latest().select(*self.keys), self.keys, "left_anti")

    def compute(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The latest rows of all wanted keys, made and saved where they are missing."""
        if table_exists(self.spark, self.path):
            todo = self.missing(wanted)
        else:
            todo = wanted
        self.save(make(todo))
        return self.latest().join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")
