"""Text functions as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_tag(c: str | Column) -> Column:
    """A description without the concept tag in brackets at its end, in lower case."""
    return F.lower(F.trim(F.regexp_replace(_col(c), r"\s*\([^()]*\)\s*$", "")))


def has_phrase(c: str | Column, phrase: str) -> Column:
    """Whether the phrase stands in the text with no letter or digit next to it."""
    quoted = "".join(f"\\{x}" if not (x.isalnum() or x == " ") else x for x in phrase.lower())
    return F.lower(_col(c)).rlike(f"(^|[^a-z0-9]){quoted}([^a-z0-9]|$)")


def has_all_words(c: str | Column, phrase: str | Column) -> Column:
    """Whether all words of the phrase occur in the text, in any order."""
    words = F.split(F.lower(_col(phrase) if isinstance(phrase, Column) else F.lit(phrase)), r"\s+")
    return F.forall(words, lambda w: F.contains(F.lower(_col(c)), w))


def sub_phrases(c: str | Column, least: int = 2) -> Column:
    """All runs of at least `least` words of a description."""
    words = F.split(_col(c), " ")
    n = F.size(words)
    lengths = F.sequence(F.lit(least), F.greatest(n, F.lit(least)))
    runs = F.transform(
        lengths,
        lambda k: F.when(
            k <= n, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
        ).otherwise(F.array().cast("array<string>")),
    )
    return F.flatten(runs)


def replace_terms(c: str | Column, terms: dict[str, str]) -> Column:
    """Each term replaced as a whole word, longer terms first."""
    out = _col(c)
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        out = F.regexp_replace(out, rf"(?i)(?<![a-z0-9]){term}(?![a-z0-9])", terms[term])
    return out


def one_space(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def clean_text(c: str | Column) -> Column:
    """HTML entities resolved, control characters dropped, trimmed; only texts with an entity leave the JVM."""
    c = _col(c)
    plain = F.when(F.contains(c, F.lit("&")), _unescaped(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)
    return F.trim(F.regexp_replace(plain, r"[\x00-\x1f\x7f-\x9f]", ""))


def node_name(c: str | Column) -> Column:
    return F.upper(F.trim(_col(c)))


def plain_number(c: str | Column) -> Column:
    """142.0 becomes 142; other texts stay."""
    return F.regexp_replace(_col(c), r"^(-?\d+)\.0+$", "$1")


def times_text(n: str | Column) -> Column:
    n = _col(n)
    return F.when(n == 1, "once").otherwise(F.concat(n.cast("string"), F.lit(" times")))


def person_uuid(c: str | Column) -> Column:
    """The uuid at the end of an id in lower case, or the whole id in lower case."""
    c = _col(c)
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(c, f"({UUID})$", 1), F.lit("")), c))


def condition_code(c: str | Column) -> Column:
    """The condition in an id: without the uuid at its end and the prefix nota_."""
    return F.regexp_replace(F.regexp_replace(_col(c), f"_?{UUID}$", ""), "^nota_", "")


def tokens(c: str | Column) -> Column:
    """Lower-case words separated by white space; an empty text has none."""
    return F.filter(F.split(F.lower(_col(c)), r"\s+"), lambda w: w != "")


def estimated_tokens(c: str | Column) -> Column:
    return F.round(F.length(_col(c)) / 4).cast("int")


def token_chunks(tokens_: Column, size: int, overlap: int) -> Column:
    """Windows of size tokens that start every size - overlap tokens and stop once a window reaches the end."""
    step, n = size - overlap, F.size(tokens_)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap) / step).cast("int") - 1, F.lit(0)))
    return F.when(n > 0, F.transform(starts, lambda i: F.slice(tokens_, i * step + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def sentences(c: str | Column) -> Column:
    """Sentences by their end marks, or lines."""
    return F.filter(F.split(_col(c), r"(?<=[.!?])\s+|[\r\n]+"), lambda s: F.trim(s) != "")


def keyword_overlap(c: str | Column, keywords: list[str]) -> Column:
    """Share of the keywords that stand in the text."""
    low = F.lower(_col(c))
    hits = sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    return hits / F.lit(float(max(1, len(keywords))))


def joined_id(*columns: str | Column) -> Column:
    """SHA-512 over the columns as text, one after the other; nulls are empty."""
    return F.sha2(F.concat(*[F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns]), 512)
