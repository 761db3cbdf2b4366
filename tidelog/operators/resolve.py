"""Last writer wins: the fold under every read.

Resolution comes first and liveness second: tombstones and expired versions take part in the
fold, else a deleted key would rise again. Ties are broken by origin, tombstone and value, so
merging is commutative for equal stamps too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

META = ("is_tombstone", "expires_at_ticks", "origin_cluster_id")


def priority() -> list[Column]:
    """Newest first, then a total order over equal stamps."""
    return [F.desc("hlc"), F.desc_nulls_last("origin_cluster_id"), F.desc("is_tombstone"), F.desc_nulls_last("value"), F.desc("expires_at_ticks")]


def resolve(entries: DataFrame, *keys: str) -> DataFrame:
    """The winning version of each key, all columns kept.

    The row number lets Spark keep one row of each key before the shuffle (WindowGroupLimit), so
    a key of many versions doesn't meet in one task in full.
    """
    first = F.row_number().over(Window.partitionBy(*(keys or ("key",))).orderBy(*priority()))
    return entries.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def is_live(now_ticks: int) -> Column:
    """Neither deleted nor expired; a version expires at its tick."""
    return ~F.col("is_tombstone") & ((F.col("expires_at_ticks") == 0) | (F.col("expires_at_ticks") > now_ticks))


def is_expired(now_ticks: int) -> Column:
    """Past its time to live; a tombstone never expires."""
    return ~F.col("is_tombstone") & (F.col("expires_at_ticks") != 0) & (F.col("expires_at_ticks") <= now_ticks)


def live(entries: DataFrame, now_ticks: int) -> DataFrame:
    """Winning versions that readers see, with all their metadata."""
    return resolve(entries).where(is_live(now_ticks))


def tombstones(keys: DataFrame, stamp: Column, origin: Column | None = None) -> DataFrame:
    """Deletion entries for ``keys(key)``."""
    return keys.select("key", F.lit(None).cast("binary").alias("value"), stamp.alias("hlc"), F.lit(True).alias("is_tombstone"), F.lit(0).cast("long").alias("expires_at_ticks"), (F.lit(None).cast("string") if origin is None else origin).alias("origin_cluster_id"))


def delta_since(entries: DataFrame, cursor: Column) -> DataFrame:
    """Versions after a stamp, deleted and expired ones included."""
    return entries.where(F.col("hlc") > cursor)


def delta_for_slots(entries: DataFrame, cursor: Column, slots: DataFrame, slot: Column) -> DataFrame:
    """Versions after a stamp whose slot is in ``slots(slot)``."""
    return delta_since(entries, cursor).withColumn("slot", slot).join(slots.select("slot"), "slot", "left_semi").drop("slot")
