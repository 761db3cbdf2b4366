"""What a store tells about itself: instruments of its operations, and events of its commits."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The counters and histograms (milliseconds) of a store, and the kinds of its events.
COUNTERS = (
    "shard.reads", "shard.writes", "shard.splits_committed", "leaf.tombstones.reaped", "leaf.tombstones.created", "leaf.tombstones.expired", "leaf.splits", "cache.hits", "cache.misses",
    "atomic_write.completed", "coordinator.completed", "tree.lifecycle", "events.published", "events.dropped", "config.changed",
)
HISTOGRAMS = ("leaf.write.duration", "leaf.scan.duration", "leaf.compaction.duration")
EVENT_KINDS = ("Set", "Delete", "DeleteRange", "SplitCommitted", "CompactionCompleted", "TreeDeleted", "TreeRecovered", "TreePurged", "SnapshotCompleted", "ResizeCompleted", "ReshardCompleted", "AtomicWriteCompleted")

#: Events that go to one file at most.
ONE_FILE = 100_000

EVENTS = T.StructType([T.StructField(n, T.StringType()) for n in ("tree_id", "kind", "key", "operation_id")] + [T.StructField("at_ticks", T.LongType())])


class Metrics:
    """Counts and durations of this process by instrument and tag; a report, never a source of results."""

    def __init__(self):
        self.counts: dict[tuple[str, str], int] = defaultdict(int)
        self.times: dict[str, list[float]] = {}
        self.since = time.monotonic()

    def add(self, instrument: str, n: int = 1, tag: str = "") -> None:
        if instrument not in COUNTERS:
            raise ValueError(f"no counter {instrument}")
        self.counts[instrument, tag] += n

    @contextmanager
    def timed(self, instrument: str) -> Iterator[None]:
        if instrument not in HISTOGRAMS:
            raise ValueError(f"no histogram {instrument}")
        began = time.monotonic()
        try:
            yield
        finally:
            ms = (time.monotonic() - began) * 1000
            n, total, least, most = self.times.get(instrument, [0, 0.0, ms, ms])
            self.times[instrument] = [n + 1, total + ms, min(least, ms), max(most, ms)]

    def rate(self, instrument: str) -> float:
        """Counts a second since the start, over all tags."""
        return sum(n for (name, _), n in self.counts.items() if name == instrument) / max(1e-9, time.monotonic() - self.since)

    def table(self, spark: SparkSession) -> DataFrame:
        """(instrument, tag, n, total_ms, least_ms, most_ms): all instruments, also those that saw nothing."""
        rows = [(name, tag, n, None, None, None) for (name, tag), n in self.counts.items()]
        rows += [(name, "", 0, None, None, None) for name in COUNTERS if not any(k[0] == name for k in self.counts)]
        rows += [(name, "", int(x[0]), x[1], x[2], x[3]) for name in HISTOGRAMS for x in [self.times.get(name, [0, 0.0, None, None])]]
        return spark.createDataFrame(rows, "instrument string, tag string, n long, total_ms double, least_ms double, most_ms double")


def events_of_entries(entries: DataFrame, tree_id: str, at_ticks: int, operation_id: str | None) -> DataFrame:
    """A Set or a Delete for each entry of a commit."""
    return event_rows(entries, F.lit(tree_id), F.when(F.col("is_tombstone"), "Delete").otherwise("Set"), F.col("key"), at_ticks, operation_id)


def event_rows(rows: DataFrame, tree_id: Column, kind: Column, key: Column, at_ticks: int, operation_id: str | None) -> DataFrame:
    values = (tree_id, kind, key, F.lit(operation_id).cast("string"), F.lit(at_ticks).cast("long"))
    return rows.select(*[v.alias(n) for v, n in zip(values, EVENTS.names, strict=True)])


class Publisher:
    """Appends events to a folder of Parquet files, which ``event_stream`` reads; what fails is counted, never raised."""

    def __init__(self, root: str, metrics: Metrics):
        self.path, self.metrics = f"{root}/events", metrics

    def publish(self, rows: DataFrame, n: int) -> None:
        if not n:
            return
        try:
            (rows.coalesce(1) if n <= ONE_FILE else rows).write.mode("append").parquet(self.path)
            self.metrics.add("events.published", n)
        except Exception:  # the commit stands, whatever becomes of its events
            self.metrics.add("events.dropped", n)


def event_stream(spark: SparkSession, root: str) -> DataFrame:
    """The events of a store as a stream."""
    return spark.readStream.schema(EVENTS).parquet(f"{root.rstrip('/')}/events")
