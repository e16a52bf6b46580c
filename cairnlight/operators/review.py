"""Reviews of cohorts, answers and contexts: grids of statistics, verdicts, repairs, embeddings by field, manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def described(df: DataFrame, groups: list[str], value: str, grid: DataFrame) -> DataFrame:
    """Statistics of value per group over a full grid of groups: n, missing, mean, std, min, p25, p50, p75, max; groups without rows have n = 0 and nulls."""
    at = lambda q: F.percentile(value, F.lit(q))
    stats = df.groupBy(*groups).agg(
        F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), F.max(value).alias("max"),
    )
    return grid.join(stats, groups, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n", "missing")})


def name_words(c: Column) -> Column:
    """Words of at least four letters of a name, in lower case, without a tag in brackets at its end."""
    base = F.regexp_replace(F.regexp_replace(F.lower(c), r"\s*\([^()]*\)\s*$", ""), "-", " ")
    return F.array_distinct(F.filter(F.transform(F.split(base, r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", "")), lambda w: F.char_length(w) >= 4))


def overlap_verdicts(signs: DataFrame, target: Column, target_names: DataFrame, key: str, sign: str, condition: str) -> DataFrame:
    """(sign, patients, words, others, verdict): signs of the target's patients whose names share a word with a name of the target.

    signs: one row per patient, sign and condition; target: which rows belong to the target; target_names: (name). others is the number of other conditions with the sign: shared from three,
    giveaway with none, else ambiguous. The words of the target are few and exploded, so names meet by word and not pair by pair.
    """
    words = target_names.select(F.explode(name_words(F.col("name"))).alias("word")).distinct()
    ours = signs.filter(target).groupBy(sign).agg(F.countDistinct(key).alias("patients"))
    shared = ours.select(sign, F.explode(name_words(F.col(sign))).alias("word")).join(F.broadcast(words), "word").groupBy(sign).agg(F.array_sort(F.collect_set("word")).alias("words"))
    others = signs.filter(~target & F.col(condition).isNotNull()).groupBy(sign).agg(F.countDistinct(condition).alias("others"))
    n = F.coalesce("others", F.lit(0))
    verdict = F.when(n >= 3, "shared").when(n == 0, "giveaway").otherwise("ambiguous")
    return ours.join(shared, sign).join(others, sign, "left").select(sign, "patients", "words", n.alias("others"), verdict.alias("verdict"))


def feature_class(c: Column, leaks: list[str], clinical: list[str]) -> Column:
    """leak, clinical or other, by the first kind of signal that stands in the name of a feature."""
    low = F.lower(c)
    has = lambda words: F.greatest(*[F.contains(low, F.lit(w)) for w in (*words, words[0])])
    return F.when(has(leaks), "leak").when(has(clinical), "clinical").otherwise("other")


def best_per_code(rows: DataFrame, code: str, rank: Column, gates: Column, place: str) -> DataFrame:
    """One row per code: the highest class, then the most gates, then the first seen. A partial minimum, so no code is sorted."""
    rest = [c for c in rows.columns if c != code]
    order = F.struct((-rank).alias("_a"), (-gates).alias("_b"), F.col(place).alias("_c"), F.struct(*rest).alias("_r"))
    return rows.groupBy(code).agg(F.min(order).alias("_m")).select(code, "_m._r.*")


def repaired(outputs: DataFrame, inputs: DataFrame, line: str, place: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of output lines: JSON objects with exactly the given text fields and an id of inputs, the first one of an id; kept in the order of the inputs.

    inputs: id and ordinal. kept has ordinal, id and line; dropped has place and line, and stands for what must be done again.
    """
    fields = F.from_json(line, "map<string, string>")
    rows = outputs.withColumn("_f", fields).withColumn("id", F.try_element_at("_f", F.lit("id")))
    good = F.col("_f").isNotNull() & (F.array_sort(F.map_keys("_f")) == F.array(*[F.lit(k) for k in sorted(keys)]))
    known = rows.filter(F.coalesce(good, F.lit(False))).join(inputs.select("id", "ordinal"), "id")
    kept = known.groupBy("id", "ordinal").agg(F.min(F.struct(place, line)).alias("_m")).select("ordinal", "id", F.col("_m")[line].alias(line), F.col("_m")[place].alias(place))
    return kept.drop(place).orderBy("ordinal"), outputs.join(kept.select(place), place, "left_anti").select(place, line)


def bounded_terms(scored: DataFrame, group: str, term: str, score: str, threshold: float, least: int = 10, most: int = 30) -> DataFrame:
    """(group, term, score, rank) of the terms at or above the threshold; the best `least` where there are fewer, at most `most`: a top-k per group."""
    w = Window.partitionBy(group).orderBy(F.desc(score), term)
    ranked = scored.select(group, term, score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return ranked.filter((F.col(score) >= threshold) | (F.col("rank") <= least)) if least else ranked.filter(F.col(score) >= threshold)


def embedded(df: DataFrame, encode: Callable[[list[str]], list[list[float]]], most_texts: int = 16, most_tokens: int = 8191, tokens: Callable[[str], int] = lambda t: len(t) // 4 + 1) -> DataFrame:
    """(field, id, vector, batch) of rows (field, id, text): the encoder gets batches of at most most_texts texts and most_tokens tokens; a larger text is a batch of its own.

    The encoder is given from outside and runs in the workers, one batch at a time. Null texts have a null vector and are in no batch (null).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, used, number, vectors, numbers = [], 0, 0, {}, {}

            def flush() -> None:
                for (i, _), v in zip(held, encode([t for _, t in held])):
                    vectors[i], numbers[i] = [float(x) for x in v], number

            for i, text in zip(pdf.index, pdf["text"]):
                if not isinstance(text, str):
                    continue
                n = tokens(text)
                if held and (len(held) == most_texts or used + n > most_tokens):
                    flush()
                    held, used, number = [], 0, number + 1
                held.append((i, text))
                used += n
            if held:
                flush()
            yield pd.DataFrame({"field": pdf["field"], "id": pdf["id"], "vector": [vectors.get(i) for i in pdf.index], "batch": pd.array([numbers.get(i) for i in pdf.index], dtype="Int32")})

    return df.select("field", F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "field string, id string, vector array<double>, batch int")


def field_texts(fields: dict[str, tuple[DataFrame, Column, Column]], wanted: list[str]) -> DataFrame:
    """(field, id, text) of the wanted fields: each names its table, id and text; an unknown field is an error."""
    out = None
    for name in wanted:
        df, key, text = fields[name]
        one = df.select(F.lit(name).alias("field"), key.cast("string").alias("id"), text.cast("string").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table whatever its order: row count and the exclusive or of 60-bit row hashes."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in sorted(df.columns)])
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return df.select(part.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("digest"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, digest) of the tables of a release."""
    out = None
    for name, df in sorted(tables.items()):
        one = content_hash(df).select(F.lit(name).alias("name"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, line): a GraphML file as lines in the order of part and key: head, nodes (title), edges (source, target, weight), tail. Written with write.text after a sort."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    frame = spark.createDataFrame(
        [
            (0, "0", '<?xml version="1.0" encoding="UTF-8"?>'), (0, "1", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'),
            (0, "2", '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>'), (0, "3", '<graph edgedefault="undirected">'), (3, "0", "</graph>"), (3, "1", "</graphml>"),
        ],
        "part int, key string, line string",
    )
    n = nodes.select(F.lit(1).alias("part"), F.col("title").alias("key"), F.concat(F.lit('<node id="'), safe(F.col("title")), F.lit('"/>')).alias("line"))
    e = edges.select(
        F.lit(2).alias("part"), F.concat("source", F.lit(" "), "target").alias("key"),
        F.concat(F.lit('<edge source="'), safe(F.col("source")), F.lit('" target="'), safe(F.col("target")), F.lit('"><data key="weight">'), F.col("weight").cast("double").cast("string"), F.lit("</data></edge>")).alias("line"),
    )
    return frame.unionByName(n).unionByName(e)


def mapped_back(context: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows of a merged context with the name of the index they came from and their number there: offsets has index, low and shift; -1 stays."""
    return context.join(F.broadcast(offsets), (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))).select(
        "index", (F.col("number") - F.col("low")).alias("own"), *[c for c in context.columns if c not in ("index", "own")]
    )
