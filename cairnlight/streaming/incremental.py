"""Structured Streaming: incremental cutoffs and latest states by foreachBatch, event-time windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnlight.sources.io import Store


class IncrementalMin:
    """Cutoffs kept in a store: each micro-batch is reduced to (key, cutoff) and merged with what is stored.

    The new state is written beside the old one under the number of its batch, so a batch that is run again
    after a failure finds the state it started from and gives the same result.
    """

    def __init__(self, store: Store, key: str, value: str, target: Column):
        self.store, self.key, self.value, self.target = store, key, value, target

    def update(self, batch: DataFrame, number: int) -> None:
        new = batch.filter(self.target).groupBy(self.key).agg(F.min(self.value).alias("cutoff"))
        before = f"state-{number - 1}"
        if number > 0 and self.store.has(before):
            new = new.unionByName(self.store.get(before)).groupBy(self.key).agg(F.min("cutoff").alias("cutoff"))
        self.store.set(f"state-{number}", new)
        if number > 1 and self.store.has(f"state-{number - 2}"):
            self.store.delete(f"state-{number - 2}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def state(self, number: int) -> DataFrame:
        return self.store.get(f"state-{number}")


class IncrementalLatest(IncrementalMin):
    """Latest row by key and revision, merged batch by batch."""

    def __init__(self, store: Store, keys: list[str], order: list[str], rest: list[str]):
        self.store, self.keys, self.order, self.rest = store, keys, order, rest

    def update(self, batch: DataFrame, number: int) -> None:
        rows, before = batch.select(*self.keys, *self.order, *self.rest), f"state-{number - 1}"
        if number > 0 and self.store.has(before):
            rows = rows.unionByName(self.store.get(before))
        m = rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *self.rest)).alias("_m")).select(*self.keys, "_m.*")
        self.store.set(f"state-{number}", m)


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, length: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window; rows later than the watermark are dropped on a stream, on a table all count."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, length, slide) if slide else F.window(time, length)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by a time gap, on tables and streams."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def per_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a step on every micro-batch until the source is used up."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
