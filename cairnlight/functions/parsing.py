"""Parsers for model output: strict and lenient JSON, delimited tuples; noun phrases by rule."""

from __future__ import annotations

import html
import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks that divide the fields and the records of a tuple list.
FIELD, RECORD, END = "<|>", "##", "<|COMPLETE|>"


def strict_object(text: str | None) -> str | None:
    """The JSON object of a text in a normal form (sorted keys), or null: duplicate keys, NaN, infinities and anything but an object are rejected."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) != len(items):
            raise ValueError("duplicate key")
        return dict(items)

    def number(x: str) -> float:
        v = float(x)
        if not math.isfinite(v):
            raise ValueError("not finite")
        return v

    def reject(x: str) -> None:
        raise ValueError(x)

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=reject, parse_float=number)
    except (ValueError, TypeError, RecursionError):
        return None
    return json.dumps(value, sort_keys=True, ensure_ascii=False) if isinstance(value, dict) else None


def repaired_object(text: str | None) -> str | None:
    """A JSON object read leniently: the part from the first brace on, without fences, trailing commas and comments, closed where it breaks off."""
    if not text or "{" not in text:
        return None
    body = re.sub(r"```\w*", "", text[text.index("{") :])
    try:
        whole = body[: json.JSONDecoder().raw_decode(body)[1]]  # the object, if text follows it
    except (ValueError, RecursionError):
        whole = ""
    for candidate in (body, whole, body[: body.rfind("}") + 1]):
        if (found := strict_object(candidate)) is not None:
            return found
    body = re.sub(r",\s*([}\]])", r"\1", re.sub(r"//[^\n\"]*$", "", body, flags=re.M)).rstrip()
    closers, inside, skip = [], False, False
    for ch in body:
        if skip:
            skip = False
        elif inside:
            skip, inside = ch == "\\", ch != '"'
        elif ch == '"':
            inside = True
        elif ch in "{[":
            closers.append("}" if ch == "{" else "]")
        elif ch in "}]" and closers:
            closers.pop()
    tail = '"' if inside else ""
    for cut in (body + tail, body.rstrip(",: ") + tail, re.sub(r',?\s*"[^"]*"?\s*:?\s*$', "", body)):
        closed = cut + "".join(reversed(closers))
        if (found := strict_object(re.sub(r",\s*([}\]])", r"\1", closed))) is not None:
            return found
    return strict_object(body[: body.rfind("}") + 1])


@F.pandas_udf(T.StringType())
def strict_json(s: pd.Series) -> pd.Series:
    return s.map(strict_object, na_action="ignore")


@F.pandas_udf(T.StringType())
def lenient_json(s: pd.Series) -> pd.Series:
    return s.map(repaired_object, na_action="ignore")


def records(text: Column) -> Column:
    """The tuples of a delimited list as arrays of trimmed fields, without brackets and quotes."""
    body = F.split(F.replace(text, F.lit(END), F.lit("")), re.escape(RECORD))
    inner = F.transform(body, lambda r: F.regexp_replace(F.trim(r), r"^\(|\)$", ""))
    fields = F.transform(inner, lambda r: F.transform(F.split(r, re.escape(FIELD)), lambda f: F.regexp_replace(F.trim(f), '^"+|"+$', "")))
    return F.filter(fields, lambda f: F.size(f) > 1)


def extracted_entities(df: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit, title, type, description): entity tuples, names upper-cased, one per name and unit with its descriptions joined."""
    r = df.select(unit, F.explode(records(F.col(text))).alias("f")).filter((F.col("f")[0] == "entity") & (F.size("f") >= 4))
    rows = r.select(unit, F.upper(F.col("f")[1]).alias("title"), F.upper(F.col("f")[2]).alias("type"), F.col("f")[3].alias("d")).filter("title <> ''")
    return rows.groupBy(unit, "title").agg(F.min("type").alias("type"), F.array_join(F.array_sort(F.collect_set("d")), "\n").alias("description"))


def extracted_relationships(df: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit, source, target, description, weight): relationship tuples; a last field that is no number weighs 1; repeated pairs of a unit add up."""
    r = df.select(unit, F.explode(records(F.col(text))).alias("f")).filter((F.col("f")[0] == "relationship") & (F.size("f") >= 5))
    weight = F.coalesce(F.element_at("f", -1).try_cast("double"), F.lit(1.0))
    rows = r.select(unit, F.upper(F.col("f")[1]).alias("source"), F.upper(F.col("f")[2]).alias("target"), F.col("f")[3].alias("d"), weight.alias("w"))
    return rows.groupBy(unit, "source", "target").agg(F.array_join(F.array_sort(F.collect_set("d")), "\n").alias("description"), F.sum("w").alias("weight"))


def extracted_claims(df: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit, subject_id, object_id, type, status, start_date, end_date, description, source_text) of claim tuples; missing fields are null."""
    f = F.col("f")
    names = ("subject_id", "object_id", "type", "status", "start_date", "end_date", "description", "source_text")
    r = df.select(unit, F.explode(records(F.col(text))).alias("f"))
    return r.select(unit, *[F.try_element_at(f, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def merge_phrases(tagged: list[tuple[str, str]], grammar: dict[tuple[str, str], str]) -> list[tuple[str, str]]:
    """Neighbouring words merged as long as the grammar has a rule for their tags, from left to right."""
    out = list(tagged)
    i = 0
    while i + 1 < len(out):
        made = grammar.get((out[i][1], out[i + 1][1]))
        if made:
            out[i : i + 2] = [(f"{out[i][0]} {out[i + 1][0]}", made)]
            i = max(0, i - 1)
        else:
            i += 1
    return out


PHRASE = re.compile(r"[A-Z][a-z0-9]+(?:[ -][A-Z]?[a-z0-9]+)?(?:-[a-z]+)*|[a-z]+-[a-z]+(?:-[a-z]+)*")


def noun_phrases(text: str, most: int = 15) -> list[str]:
    """Candidate phrases by form alone: names, hyphenated words and pairs led by a capital; each word at most `most` letters; upper-cased, distinct, in order."""
    out: dict[str, None] = {}
    for m in PHRASE.finditer(html.unescape(text)):
        phrase = m.group()
        words = re.split(r"[ -]", phrase)
        if (len(words) > 1 or phrase[0].isupper()) and all(w and len(w) <= most for w in words):
            out[phrase.upper()] = None
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def phrases(s: pd.Series) -> pd.Series:
    return s.map(lambda t: noun_phrases(t) if isinstance(t, str) else None)
