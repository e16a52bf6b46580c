"""Deeply nested JSON into an adjacency table, and from there into related flat tables (problem 5)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.session import spread, written

NODE_SCHEMA = (
    "record bigint, root string, node int, parent int, depth int, label string, ordinal int, kind string, scalar string"
)
ARROW = pa.schema(
    [(c, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]) for c, kind in (x.split() for x in NODE_SCHEMA.split(", "))]
)


def _batch(columns: list[list]) -> pa.RecordBatch:
    """Node columns as one batch. Half a surrogate pair can be written in JSON but isn't a character: it becomes a question mark."""
    try:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)
    except UnicodeEncodeError:
        whole = [[x.encode("utf-8", "replace").decode() if isinstance(x, str) else x for x in c] for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(whole, ARROW)], schema=ARROW)


def _kind(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {dict: "object", list: "array"}.get(type(value), "string")


def _decoded(value: object) -> object:
    """A container that was written as JSON text, as the container; anything else as it is."""
    while isinstance(value, str) and value.lstrip()[:1] in ('{', '[', '"'):
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        value = inner
    return value


def shred_value(value: object, skip: frozenset[str | tuple[int, str]], decode: frozenset[str]) -> list[tuple]:
    """(node, parent, depth, label, ordinal, kind, scalar) of one document in pre-order; node 0 is the root. skip: keys, or (depth, key) for keys of one depth."""
    out: list[tuple] = []
    stack = [(_decoded(value), -1, 0, None, 0)]
    while stack:
        item, parent, depth, label, ordinal = stack.pop()
        kind = _kind(item)
        scalar = None
        if kind == "string":
            scalar = item
        elif kind in ("number", "boolean"):
            scalar = str(item) if type(item) is int else json.dumps(item)
        node = len(out)
        out.append((node, parent, depth, label, ordinal, kind, scalar))
        if kind == "object":
            children = [(k, v) for k, v in item.items() if k not in skip and (depth + 1, k) not in skip]
            for i in range(len(children) - 1, -1, -1):
                k, v = children[i]
                stack.append((_decoded(v) if k in decode else v, node, depth + 1, k, i))
        elif kind == "array":
            for i in range(len(item) - 1, -1, -1):
                stack.append((item[i], node, depth + 1, None, i))
    return out


def shred(
    df: DataFrame, record: str, fields: list[str], skip: tuple[str | tuple[str, int, str], ...] = (), decode: tuple[str, ...] = ()
) -> DataFrame:
    """Adjacency table of the JSON text columns fields of df: one row for each JSON value.

    record names a unique bigint column; root is the field; node numbers are unique per record
    and field, the root has node 0 and parent -1; label is the key in an object, ordinal the
    0-based place among the siblings; scalar holds strings, numbers and booleans as text.
    skip: object keys whose subtrees aren't wanted (pruned while parsing), or (root, depth, key) for
    keys of one depth of one field: where keys are names, any key may be a name. decode: keys whose
    value may be JSON written as text; the root may always be. Null, empty and unparseable
    texts give no rows; duplicate keys keep the last value; a null record is kept as null.
    """
    anywhere, decoded = {x for x in skip if isinstance(x, str)}, frozenset(decode)
    skipped = {f: frozenset(anywhere | {x[1:] for x in skip if not isinstance(x, str) and x[0] == f}) for f in fields}

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in ARROW]
            for key, root, text in zip(*(batch.column(c).to_pylist() for c in ("record", "root", "text"))):
                try:
                    value = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                nodes = shred_value(value, skipped[root], decoded)
                for column, values in zip(columns, ([key] * len(nodes), [root] * len(nodes), *zip(*nodes))):
                    column.extend(values)
                if len(columns[0]) > 50_000:
                    yield _batch(columns)
                    columns = [[] for _ in ARROW]
            yield _batch(columns)

    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("root"), F.col(f).alias("text")) for f in fields]))
    texts = (
        df.select(F.col(record).cast("bigint").alias("record"), pairs.alias("x"))
        .select("record", "x.root", "x.text")
        .filter(F.col("text").isNotNull() & (F.trim("text") != ""))
    )
    return spread(texts).mapInArrow(parts, NODE_SCHEMA)


def children(parents: DataFrame, nodes: DataFrame, prefix: str) -> DataFrame:
    """Rows of parents (record, root, node, ...) joined with the child nodes; the child becomes node, the parent's own number {prefix}."""
    child = nodes.select("record", "root", F.col("parent").alias("node"), F.struct("node", "label", "ordinal", "kind", "scalar").alias("_c"))
    return (
        parents.join(child, ["record", "root", "node"])
        .withColumnRenamed("node", prefix)
        .withColumn("node", F.col("_c.node"))
    )


def entity(objects: DataFrame, nodes: DataFrame, scalars: dict[str, str]) -> DataFrame:
    """Object nodes with their scalar children pivoted into columns {key in the JSON: column name}; a missing key gives null."""
    inner = (
        nodes.filter(F.col("label").isin(list(scalars)))
        .groupBy("record", "root", F.col("parent").alias("node"))
        .agg(*[F.max(F.when(F.col("label") == k, F.col("scalar"))).alias(v) for k, v in scalars.items()])
    )
    return objects.join(inner, ["record", "root", "node"], "left")


def _rank(explicit: Column | None = None) -> Column:
    """Rank of a prediction: the key of an object of predictions, else the place in the list."""
    by_key = F.expr("try_cast(_c.label as int)")
    return F.coalesce(*([explicit] if explicit is not None else []), by_key, F.col("_c.ordinal") + 1)


class ResultTables:
    """Flat, linked tables of a results table with the columns result_id, predictions, evaluation and variants, and those of OWN that it has.

    variants: one row per variant; outputs: per model slot (for rows without variants one slot with
    empty variant and model); predictions: per ranked prediction; plan_items; scores; judge_scores: the single judges' scores of a metric;
    prompts; answers: the raw answer of a slot; responses: per model call with its usage; components: what a variant or a row was set up with; keywords of a component. Every row carries
    record, root and the node numbers of itself and its parent. The slot of a row without variants is an
    object of the row's own columns with
    the root "row", so that all it holds links to it. A row with variants that has predictions or an
    evaluation besides has such a slot too. A row's own components have the root "components", since rows with variants have them too.
    nodes is the adjacency table of all of it, extra keys included. scores=False leaves the evaluations of slots out while parsing, for callers that want no scores.
    """

    OWN = ("status", "error", "assessment_plan_prompts", "assessment_plan_raw", "model_responses")
    DECODE = ("variants", "predictions", "evaluation", "plan", "assessment_plans", "assessment_plan_prompts", "model_responses", "components")

    def __init__(self, results: DataFrame, scores: bool = True, id_column: str = "result_id"):
        self.results, self.id, self.with_scores = results, id_column, scores
        own = ["predictions"] + (["evaluation"] if scores else [])
        given = F.lit(False)
        for c in ("predictions", "evaluation"):
            given = given | (F.trim(F.coalesce(c, F.lit(""))) != "")
        none = F.trim(F.coalesce("variants", F.lit(""))) == ""
        row = F.to_json(F.struct(*[c for c in self.OWN if c in results.columns], *own))
        fields = ["variants", "row"] + (["components"] if "components" in results.columns else [])
        rows = results.select(id_column, F.when(none | given, row).alias("row"), *[f for f in fields if f != "row"])
        # Pruned at its depth only: a variant, a model or a metric may have any name.
        skip = () if scores else (("variants", 4, "evaluation"),)
        self.nodes = written(shred(rows, id_column, fields, skip, self.DECODE))  # read by several joins; parsing it once is far cheaper

    def variants(self) -> DataFrame:
        """record, root, node, variant, ordinal of each variant object."""
        return self.nodes.filter((F.col("root") == "variants") & (F.col("depth") == 1)).select(
            "record", "root", "node", F.col("label").alias("variant"), "ordinal"
        )

    def _slots(self) -> DataFrame:
        """Model slots: record, root, node, variant_node, variant, model."""
        n = self.nodes
        plans = n.filter((F.col("depth") == 2) & (F.col("label") == "assessment_plans"))
        slots = n.filter(F.col("depth") == 3)
        held = children(self.variants().drop("ordinal"), plans, "variant_node").drop("_c")
        nested = children(held, slots, "_plans").select(
            "record", "root", "node", "variant_node", "variant", F.col("_c.label").alias("model")
        )
        flat = n.filter((F.col("root") == "row") & (F.col("depth") == 0)).select(
            "record", "root", "node", F.lit(None).cast("int").alias("variant_node"), F.lit("").alias("variant"), F.lit("").alias("model")
        )
        return nested.unionByName(flat)

    def outputs(self) -> DataFrame:
        """Model slots: record, root, node, variant_node, variant, model, status, error (a text, or null), error_type and error_message (of an error that is an object)."""
        n = self.nodes
        slots = entity(self._slots(), n, {"status": "status", "error": "error"})
        errors = n.filter("label = 'error' and kind = 'object'").select("record", "root", "node", F.col("parent").alias("slot_node"))
        told = entity(errors, n, {"type": "error_type", "message": "error_message"}).drop("node").withColumnRenamed("slot_node", "node")
        return slots.join(told, ["record", "root", "node"], "left")

    def predictions(self) -> DataFrame:
        """Ranked predictions: record, root, node, slot_node, variant, model, rank, condition."""
        n, slots = self.nodes, self._slots().drop("variant_node")
        held = children(slots, n.filter("depth = if(root = 'row', 1, 4) and label = 'predictions'"), "slot_node").drop("_c")
        own = n.filter("depth = if(root = 'row', 2, 5)")
        rows = children(held, own, "_list").select(
            "record", "root", "node", "slot_node", "variant", "model", _rank().cast("int").alias("_place"), F.col("_c.kind").alias("kind")
        )
        rows = entity(rows, n, {"condition": "condition", "rank": "_said"})
        return rows.withColumn("rank", F.coalesce(F.expr("try_cast(_said as int)"), F.col("_place"))).drop("_said", "_place")

    def plan_items(self) -> DataFrame:
        """Non-null plan items: record, root, node, prediction_node, variant, model, rank, step, text. A plan that is one text is one item."""
        n = self.nodes
        plans = children(
            self.predictions().select("record", "root", "node", "variant", "model", "rank"), n.filter("label = 'plan'"), "prediction_node"
        )
        single = plans.filter("_c.kind in ('string', 'number', 'boolean')").select(
            "record", "root", "node", "prediction_node", "variant", "model", "rank", F.lit(1).alias("step"), F.col("_c.scalar").alias("text")
        )
        lists = plans.filter("_c.kind = 'array'").drop("_c")
        # A plan that is one object with a text is one item as well.
        objects = plans.filter("_c.kind = 'object'").select("record", "root", "node", "prediction_node", "variant", "model", "rank", F.lit(1).alias("step"))
        items = children(lists, n.filter("depth = if(root = 'row', 4, 7)"), "_plan").filter("_c.kind != 'null'")
        plain = items.select(
            "record", "root", "node", "prediction_node", "variant", "model", "rank", (F.col("_c.ordinal") + 1).alias("step"), F.col("_c.scalar").alias("text"), F.col("_c.kind").alias("_kind")
        )
        packed = plain.filter("_kind = 'object'").drop("text", "_kind").unionByName(objects)
        packed = entity(packed, n, {"text": "text"}).filter("text is not null")
        return plain.filter("_kind != 'object'").drop("_kind").unionByName(packed).unionByName(single)

    def scores(self) -> DataFrame:
        """Metric values: record, root, node, slot_node, variant, model, rank, part (condition or plan), metric, status, value."""
        n, slots = self.nodes, self._slots().drop("variant_node")
        held = children(slots, n.filter("depth = if(root = 'row', 1, 4) and label = 'evaluation'"), "slot_node").drop("_c")
        own = n.filter("depth = if(root = 'row', 2, 5)")
        entries = children(held, own, "_list").select(
            "record", "root", "node", "slot_node", "variant", "model", _rank().cast("int").alias("_place")
        )
        entries = entity(entries, n, {"rank": "_said"}).withColumn("rank", F.coalesce(F.expr("try_cast(_said as int)"), F.col("_place")))
        parts = children(entries.drop("_said", "_place"), n.filter("label in ('condition', 'plan') and kind = 'object'"), "_entry")
        parts = parts.withColumn("part", F.col("_c.label")).drop("_c")
        metrics = children(parts, n.filter("label = 'metrics'"), "_part").drop("_c")
        values = children(metrics, n.filter("kind = 'object'"), "_metrics").withColumn("metric", F.col("_c.label")).drop("_c")
        values = values.select("record", "root", "node", "slot_node", "variant", "model", "rank", "part", "metric")
        return entity(values, n, {"status": "status", "value": "_value"}).withColumn("value", F.expr("try_cast(_value as double)")).drop("_value")

    def judge_scores(self) -> DataFrame:
        """The single judges' scores of a metric: record, root, node, score_node, variant, model, rank, part, metric, ordinal, judge, score."""
        n = self.nodes
        values = self.scores().select("record", "root", "node", "variant", "model", "rank", "part", "metric")
        lists = children(values, n.filter("label = 'runs' and kind = 'array'"), "score_node").drop("_c")
        runs = children(lists, n.filter("kind = 'object'"), "_runs").withColumn("ordinal", F.col("_c.ordinal")).drop("_c", "_runs")
        runs = runs.select("record", "root", "node", "score_node", "variant", "model", "rank", "part", "metric", "ordinal")
        return entity(runs, n, {"judge": "judge", "score": "_score"}).withColumn("score", F.expr("try_cast(_score as double)")).drop("_score")

    def prompts(self) -> DataFrame:
        """Prompts: record, root, node, owner_node (the variant, or the slot of a row), variant, system, user (also of a prompt that is one text)."""
        n, label = self.nodes, "label = 'assessment_plan_prompts' and kind != 'null'"
        variants = self.variants().drop("ordinal")
        rows = n.filter("root = 'row' and depth = 0").select("record", "root", "node", F.lit("").alias("variant"))
        held = children(variants.unionByName(rows), n.filter(f"depth = if(root = 'row', 1, 2) and {label}"), "owner_node")
        held = entity(held.withColumn("_text", F.col("_c.scalar")).drop("_c"), n, {"system": "system", "user": "user"})
        return held.withColumn("user", F.coalesce("user", "_text")).drop("_text")

    def answers(self) -> DataFrame:
        """Raw answers of the slots: record, root, node, slot_node, variant, model, raw (null where there is none). A JSON object written as text stays that text."""
        held = children(self._slots().drop("variant_node"), self.nodes.filter("depth = if(root = 'row', 1, 4) and label = 'assessment_plan_raw'"), "slot_node")
        return held.select("record", "root", "node", "slot_node", "variant", "model", F.col("_c.scalar").alias("raw"))

    def responses(self) -> DataFrame:
        """Model calls of the slots: record, root, node, slot_node, variant, model, step (the key where calls are grouped by what they were for, else empty), ordinal,
        reported_model, response_id, request_id, prompt_tokens, completion_tokens, total_tokens, cached_tokens (null where the count is missing)."""
        n = self.nodes
        held = children(self._slots().drop("variant_node"), n.filter("depth = if(root = 'row', 1, 4) and label = 'model_responses'"), "slot_node")
        keys = ["record", "root", "node", "slot_node", "variant", "model"]
        flat = held.filter("_c.kind = 'array'").select(*keys, F.lit("").alias("step"))
        groups = children(held.filter("_c.kind = 'object'").drop("_c"), n.filter("kind = 'array'"), "_all").select(*keys, F.col("_c.label").alias("step"))
        calls = children(flat.unionByName(groups), n.filter("kind = 'object'"), "_list").select(*keys, "step", F.col("_c.ordinal").alias("ordinal"))
        calls = entity(calls, n, {k: k for k in ("reported_model", "response_id", "request_id")})
        counts = ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens")
        usage = n.filter("label = 'token_usage' and kind = 'object'").select("record", "root", "node", F.col("parent").alias("_call"))
        usage = entity(usage, n, {k: k for k in counts}).drop("node").withColumnRenamed("_call", "node")
        return calls.join(usage, ["record", "root", "node"], "left").withColumns({k: F.expr(f"try_cast({k} as bigint)") for k in counts})

    def components(self) -> DataFrame:
        """Components of a variant, or of the row itself (empty variant): record, root, node, owner_node (the variant; null for those of the row), variant, name, component, status, top_k."""
        n = self.nodes
        held = children(self.variants().drop("ordinal"), n.filter("depth = 2 and label = 'components' and kind = 'object'"), "owner_node").drop("_c")
        rows = n.filter("root = 'components' and depth = 0").select("record", "root", "node", F.lit("").alias("variant"), F.lit(None).cast("int").alias("owner_node"))
        each = children(held.unionByName(rows), n.filter("kind = 'object'"), "_components").withColumn("name", F.col("_c.label")).drop("_c", "_components")
        each = entity(each, n, {"component": "component", "status": "status"})
        settings = n.filter("label = 'settings' and kind = 'object'").select("record", "root", "node", F.col("parent").alias("_owner"))
        settings = entity(settings, n, {"top_k": "top_k"}).drop("node").withColumnRenamed("_owner", "node")
        return each.join(settings, ["record", "root", "node"], "left").withColumn("top_k", F.expr("try_cast(top_k as bigint)"))

    def keywords(self) -> DataFrame:
        """Retrieval keywords of the components: record, root, node, component_node, variant, name, ordinal, keyword."""
        n = self.nodes
        owners = self.components().select("record", "root", "node", "variant", "name")
        captures = children(owners, n.filter("label = 'capture' and kind = 'object'"), "component_node").drop("_c")
        lists = children(captures, n.filter("label = 'retrieval_keywords' and kind = 'array'"), "_capture").drop("_c", "_capture")
        words = children(lists, n.filter("kind in ('string', 'number', 'boolean')"), "_list")
        return words.select("record", "root", "node", "component_node", "variant", "name", F.col("_c.ordinal").alias("ordinal"), F.col("_c.scalar").alias("keyword"))
