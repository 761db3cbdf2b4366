"""Tree events: what a commit publishes, as a batch derivation and as a stream."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidelog.plans.schema import MUTATIONS

log = logging.getLogger(__name__)


def events_of(log: DataFrame) -> DataFrame:
    """Adds ``kind``: a Set for each key written, a Delete only where the key was there before."""
    was = F.lag("is_tombstone").over(Window.partitionBy("key").orderBy("hlc"))
    rows = log.withColumn("_was", was).where(~F.col("is_tombstone") | (F.col("_was") == F.lit(False)))
    return rows.withColumn("kind", F.when(F.col("is_tombstone"), "Delete").otherwise("Set")).drop("_was")


def range_event(tree: str, start: str, end: str, count: int) -> tuple[str, str, str] | None:
    """The one event of a range delete, if it deleted anything."""
    return (tree, "DeleteRange", f"{start}..{end}") if count > 0 else None


def is_published(override: Column, default: bool) -> Column:
    """A tree's own setting, else the default."""
    return F.coalesce(override, F.lit(default))


def mutation_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the mutations appended under ``path``."""
    return spark.readStream.schema(MUTATIONS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def subscribe(stream: DataFrame, callback: Callable[[DataFrame, int], None] | list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Calls back, one after another, with each micro-batch; the batch id makes a repeated delivery recognisable.

    An observer that fails loses its batch; the others, and the stream, go on.
    """

    def deliver(batch: DataFrame, n: int) -> None:
        for observe in [callback] if callable(callback) else callback:
            try:
                observe(batch, n)
            except Exception:
                log.exception("an observer failed on batch %d", n)

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_divergence(pairs: DataFrame, max_late: str | None = None) -> DataFrame:
    """(serial, at, kind) of a stream ``pairs(serial, at, a, b)``: where two states begin to differ, change while they differ, or agree again.

    Keeps the last pair of each part as state; rows of a micro-batch are taken in order of ``at``.
    State grows with the number of parts and isn't dropped by a watermark.
    """
    import numpy as np
    import pandas as pd

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        last = state.get if state.exists else (0, 0)  # two states agree before the first pair
        was_a, was_b = np.concatenate([[last[0]], a[:-1]]), np.concatenate([[last[1]], b[:-1]])
        differs, differed, moved = a != b, was_a != was_b, (a != was_a) | (b != was_b)
        kind = np.select([differs & ~differed, differs & moved, ~differs & differed], ["entered", "changed", "resolved"], "")
        state.update((int(a[-1]), int(b[-1])))
        yield pd.DataFrame({"serial": key[0], "at": rows["at"].to_numpy(), "kind": kind})[kind != ""]

    schema = T.StructType([pairs.schema["serial"], pairs.schema["at"], T.StructField("kind", T.StringType())])
    return pairs.groupBy("serial").applyInPandasWithState(step, schema, "a long, b long", "append", "NoTimeout")
