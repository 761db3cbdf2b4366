"""Whole-tree operations: merge, snapshot and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.resolve import live, resolve


def merge_trees(target: DataFrame, source: DataFrame) -> DataFrame:
    """The winners of both trees; tombstones take part and stamps stay as they are."""
    return resolve(target.unionByName(source))


def snapshot(entries: DataFrame, now_ticks: int) -> DataFrame:
    """Live winners, copied as they are; deleted and expired keys are left behind."""
    return live(entries, now_ticks)


def is_reapable(now_ticks: int, grace_ticks: int | None) -> Column:
    """Deleted, or expired, for longer than the grace period; without one nothing is reaped."""
    if grace_ticks is None:
        return F.lit(False)
    cutoff = now_ticks - grace_ticks
    expired = ~F.col("is_tombstone") & (F.col("expires_at_ticks") != 0) & (F.col("expires_at_ticks") <= cutoff)
    return (F.col("is_tombstone") & (F.col("hlc.wall_ticks") <= cutoff)) | expired


def compact(entries: DataFrame, now_ticks: int, grace_ticks: int | None) -> DataFrame:
    """What compaction keeps: the winner of each key unless it can be reaped."""
    return resolve(entries).where(~is_reapable(now_ticks, grace_ticks))


def reaped(entries: DataFrame, now_ticks: int, grace_ticks: int | None) -> DataFrame:
    """What compaction removes of the winners."""
    return resolve(entries).where(is_reapable(now_ticks, grace_ticks))
