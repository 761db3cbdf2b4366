"""Counts and health figures of trees and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.operators.resolve import is_live, live, resolve

# Operations a second from which a shard is hot, and the slots it must own to be split.
HOT_RATE, LEAST_SLOTS = 200.0, 2


def count_live(entries: DataFrame, now_ticks: int) -> DataFrame:
    """One row ``n``."""
    return live(entries, now_ticks).agg(F.count(F.lit(1)).alias("n"))


def count_per_shard(entries: DataFrame, now_ticks: int, shard: Column, shards: DataFrame) -> DataFrame:
    """(shard, n) for each of ``shards(shard)``, empty ones included."""
    counted = live(entries, now_ticks).groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return shards.select("shard").join(counted, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_for_slots(entries: DataFrame, now_ticks: int, slot: Column, slots: DataFrame) -> DataFrame:
    """One row ``n``: live keys whose slot is in ``slots(slot)``."""
    return live(entries, now_ticks).withColumn("slot", slot).join(slots.select("slot"), "slot", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def count_with_moved(entries: DataFrame, now_ticks: int, slot: Column, moved: DataFrame) -> DataFrame:
    """One row (n, moved_slots): live keys outside the slots in ``moved(slot)``, and those of them that keys were seen in."""
    rows = live(entries, now_ticks).withColumn("slot", slot).join(moved.select("slot", F.lit(True).alias("moved")), "slot", "left")
    return rows.agg(F.count_if(F.col("moved").isNull()).alias("n"), F.array_sort(F.collect_set(F.when(F.col("moved"), F.col("slot")))).alias("moved_slots"))


def leaf_stats(entries: DataFrame, now_ticks: int, *by: str) -> DataFrame:
    """(…, live, dead) over winning versions; dead are deleted or expired."""
    return resolve(entries).groupBy(*by).agg(F.count_if(is_live(now_ticks)).alias("live"), F.count_if(~is_live(now_ticks)).alias("dead"))


def diagnostics(entries: DataFrame, now_ticks: int, shard: Column) -> DataFrame:
    """(shard, live, tombstones, tombstone_ratio) for each shard, and the whole tree as the row whose shard is null."""
    rows = resolve(entries).withColumn("shard", shard)
    counts = rows.rollup("shard").agg(F.count_if(is_live(now_ticks)).alias("live"), F.count_if(~is_live(now_ticks)).alias("tombstones"))
    total = F.col("live") + F.col("tombstones")
    return counts.withColumn("tombstone_ratio", F.when(total > 0, F.col("tombstones") / total).otherwise(0.0))


def hotness(operations: DataFrame, shard: Column, seconds: float, is_write: Column) -> DataFrame:
    """(shard, reads, writes, rate) of an operation log over a window of ``seconds``."""
    counts = operations.groupBy(shard.alias("shard")).agg(F.count_if(~is_write).alias("reads"), F.count_if(is_write).alias("writes"))
    return counts.withColumn("rate", (F.col("reads") + F.col("writes")) / F.lit(float(seconds)))


def hotness_over(operations: DataFrame, shard: Column, at_ticks: Column, width_ticks: int, is_write: Column) -> DataFrame:
    """(shard, window, reads, writes, rate): the same for each window of so many ticks; ``window`` is its first tick."""
    window = at_ticks - F.pmod(at_ticks, F.lit(width_ticks))
    counts = operations.groupBy(shard.alias("shard"), window.alias("window")).agg(F.count_if(~is_write).alias("reads"), F.count_if(is_write).alias("writes"))
    return counts.withColumn("rate", (F.col("reads") + F.col("writes")) / F.lit(width_ticks / 1e7))


def hot_shards(rates: DataFrame, owners: DataFrame, busy: DataFrame, most: int, threshold: float = HOT_RATE) -> DataFrame:
    """The ``most`` hottest shards that are neither splitting nor cooling down (``busy(shard)``) and own two slots at least."""
    return rates.where(F.col("rate") >= threshold).join(busy.select("shard"), "shard", "left_anti").join(owners.where(F.size("slots") >= LEAST_SLOTS).select("shard"), "shard", "left_semi").orderBy(F.desc("rate"), "shard").limit(most)


def slots_by_owner(slot_map: DataFrame) -> DataFrame:
    """(shard, slots): the sorted slots of each owner of ``slot_map(slot, shard)``."""
    return slot_map.groupBy("shard").agg(F.array_sort(F.collect_list("slot")).alias("slots"))


def owner_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(slot, old_shard, new_shard) of the slots whose owner changed."""
    both = old.select("slot", F.col("shard").alias("old_shard")).join(new.select("slot", F.col("shard").alias("new_shard")), "slot")
    return both.where("old_shard <> new_shard")


def split_owner(slot_map: DataFrame, owner: int, new_shard: int) -> DataFrame:
    """The map after a split: the upper half of the owner's slots, from count / 2 on, moves to the new shard."""
    own = Window.partitionBy("shard").orderBy("slot")
    upper = (F.col("shard") == owner) & (F.row_number().over(own) > F.floor(F.count(F.lit(1)).over(Window.partitionBy("shard")) / 2))
    return slot_map.withColumn("_up", upper).select("slot", F.when(F.col("_up"), F.lit(new_shard)).otherwise(F.col("shard")).alias("shard"))


def reshard(slot_map: DataFrame, shards: int) -> DataFrame:
    """The map grown to ``shards`` owners by splitting the largest owner again and again (the smallest number among equals).

    The map has at most a few thousand slots, whatever the data, so it is grown on the driver.
    """
    if not 2 <= shards <= 4096:
        raise ValueError("2 to 4096 shards")
    owned: dict[int, list[int]] = {}
    for r in slot_map.orderBy("slot").collect():
        owned.setdefault(r.shard, []).append(r.slot)
    if shards < len(owned):
        raise ValueError("a tree that holds keys can only grow")
    while len(owned) < shards:
        largest = max(owned, key=lambda s: (len(owned[s]), -s))
        half = len(owned[largest]) // 2
        if not half:
            raise ValueError("more shards than slots")
        owned[max(owned) + 1], owned[largest] = owned[largest][half:], owned[largest][:half]
    return slot_map.sparkSession.createDataFrame([(x, s) for s, xs in owned.items() for x in xs], "slot int, shard int")
