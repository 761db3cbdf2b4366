"""Hybrid logical clocks, version vectors and the order of split states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.plans.order import rank
from tidelog.plans.schema import hlc, zero

#: States of a split in the order in which they may only advance.
SPLIT_STATES = ("none", "splitting", "split")


def tick(previous: Column, now: Column) -> Column:
    """A stamp after ``previous`` at wall time ``now``."""
    ahead = now > previous["wall_ticks"]
    return F.when(ahead, hlc(now, 0)).otherwise(hlc(previous["wall_ticks"], previous["counter"] + 1))


def merge_clocks(a: Column, b: Column, now: Column) -> Column:
    """A stamp after both ``a`` and ``b`` at wall time ``now``."""
    wall = F.greatest(now, a["wall_ticks"], b["wall_ticks"])
    on = lambda x: F.when(x["wall_ticks"] == wall, x["counter"] + 1).otherwise(0)
    return hlc(wall, F.greatest(on(a), on(b)))


def stamp(batch: DataFrame, now_ticks: int, last_wall: int, last_counter: int, position: str) -> DataFrame:
    """Adds ``hlc``: unique stamps after the last one, rising with ``position`` (a whole number)."""
    wall, counter = (now_ticks, -1) if now_ticks > last_wall else (last_wall, last_counter)
    return rank(batch, position, F.floor(F.col(position) / (1 << 16)), "_n").withColumn("hlc", hlc(F.lit(wall), F.lit(counter) + F.col("_n"))).drop("_n")


def vector_of(entries: DataFrame, replica: str = "origin_cluster_id") -> DataFrame:
    """(replica, hlc): the newest stamp of each replica."""
    return entries.groupBy(F.col(replica).alias("replica")).agg(F.max("hlc").alias("hlc"))


def merge_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pointwise maximum."""
    return a.unionByName(b).groupBy("replica").agg(F.max("hlc").alias("hlc"))


def dominates_or_equals(mine: DataFrame, other: DataFrame) -> DataFrame:
    """One row ``dominates``: whether every entry of ``other`` is at most mine; a replica that I lack stands at zero."""
    both = other.withColumnRenamed("hlc", "theirs").join(mine.withColumnRenamed("hlc", "mine"), "replica", "left")
    return both.agg(F.coalesce(F.bool_and(F.coalesce("mine", zero()) >= F.col("theirs")), F.lit(True)).alias("dominates"))


def is_newer_than(mine: DataFrame, other: DataFrame) -> DataFrame:
    """One row ``newer``: whether any entry of mine is beyond the other's."""
    both = mine.withColumnRenamed("hlc", "mine").join(other.withColumnRenamed("hlc", "theirs"), "replica", "left")
    return both.agg(F.coalesce(F.bool_or(F.col("mine") > F.coalesce("theirs", zero())), F.lit(False)).alias("newer"))


def prune_vector(vector: DataFrame, cutoff_ticks: int) -> DataFrame:
    """Without entries whose wall time is before the cutoff."""
    return vector.where(F.col("hlc.wall_ticks") >= cutoff_ticks)


def merge_split_states(a: Column, b: Column) -> Column:
    """The further of two split states."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, SPLIT_STATES)), x)
    return F.when(rank(a) >= rank(b), a).otherwise(b)
