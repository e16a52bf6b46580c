"""Text metrics in Arrow batches; model-based ones take a scorer from outside."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _grams(w: list[str], n: int) -> Counter:
    return Counter(zip(*(w[i:] for i in range(n))))


def bleu(candidate: list[str], reference: list[str], most: int = 4) -> float:
    """Sentence BLEU; a precision without a match counts as 1 / (2 * its n-grams); 0 without any common word."""
    if not candidate or not reference:
        return 0.0
    logs = []
    for n in range(1, most + 1):
        c, r = _grams(candidate, n), _grams(reference, n)
        total = sum(c.values())
        if not total:
            continue
        hits = sum((c & r).values())
        if not hits and n == 1:
            return 0.0
        logs.append(math.log(hits / total if hits else 1 / (2 * total)))
    brevity = min(1.0, math.exp(1 - len(reference) / len(candidate)))
    return brevity * math.exp(sum(logs) / len(logs))


def rouge_n(candidate: list[str], reference: list[str], n: int) -> float:
    """F1 of the common n-grams."""
    c, r = _grams(candidate, n), _grams(reference, n)
    hits = sum((c & r).values())
    return 2 * hits / (sum(c.values()) + sum(r.values())) if hits else 0.0


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one bit per word of b."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full, row = (1 << len(b)) - 1, (1 << len(b)) - 1
    for w in a:
        match = row & places.get(w, 0)
        row = (row + match | row - match) & full
    return len(b) - row.bit_count()


def rouge_l(candidate: list[str], reference: list[str]) -> float:
    n = common_subsequence(candidate, reference)
    return 2 * n / (len(candidate) + len(reference)) if n else 0.0


def meteor(candidate: list[str], reference: list[str]) -> float:
    """METEOR with exact matches only, taken from left to right: recall-weighted mean, less a penalty for chunks."""
    free: dict[str, list[int]] = {}
    for i, w in enumerate(reference):
        free.setdefault(w, []).append(i)
    pairs = [(i, free[w].pop(0)) for i, w in enumerate(candidate) if free.get(w)]
    if not pairs:
        return 0.0
    p, r = len(pairs) / len(candidate), len(pairs) / len(reference)
    chunks = 1 + sum(1 for x, y in zip(pairs, pairs[1:]) if (y[0] - x[0], y[1] - x[1]) != (1, 1))
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / len(pairs)) ** 3)


def text_metrics(df: DataFrame, id_column: str, candidate: str, reference: str) -> DataFrame:
    """id, bleu, rouge1, rouge2, rouge_l, meteor; null texts give null metrics."""
    kind = df.schema[id_column].dataType.simpleString()

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, a, b in zip(pdf[id_column], pdf[candidate], pdf[reference]):
                if a is None or b is None:
                    rows.append((key, *[None] * 5))
                    continue
                x, y = words(a), words(b)
                rows.append((key, bleu(x, y), rouge_n(x, y, 1), rouge_n(x, y, 2), rouge_l(x, y), meteor(x, y)))
            yield pd.DataFrame(rows, columns=[id_column, "bleu", "rouge1", "rouge2", "rouge_l", "meteor"])

    return df.select(id_column, candidate, reference).mapInPandas(parts, f"{id_column} {kind}, bleu double, rouge1 double, rouge2 double, rouge_l double, meteor double")


def scored_pairs(df: DataFrame, id_column: str, candidate: str, reference: str, scorer: Callable[[list[str], list[str]], list[float]], batch: int = 64) -> DataFrame:
    """id, score, status by a batch scorer given from outside; a batch that fails is tried pair by pair, so one bad pair costs only itself."""
    kind = df.schema[id_column].dataType.simpleString()

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    scores = scorer(part[candidate].tolist(), part[reference].tolist())
                    rows += [(k, float(s), "scored") for k, s in zip(part[id_column], scores)]
                except Exception:  # noqa: BLE001
                    for k, a, b in zip(part[id_column], part[candidate], part[reference]):
                        try:
                            rows.append((k, float(scorer([a], [b])[0]), "scored"))
                        except Exception as e:  # noqa: BLE001
                            rows.append((k, None, f"error: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=[id_column, "score", "status"])

    return df.select(id_column, candidate, reference).mapInPandas(parts, f"{id_column} {kind}, score double, status string")
