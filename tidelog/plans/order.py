"""Ranks and running figures over long orders, without one task that holds a whole group.

Rows fall into buckets that follow the order; a small table of the buckets gives what stands
before each, and windows run inside buckets alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEFORE = (Window.unboundedPreceding, -1)


def null_safe_join(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on columns of one name; nulls are equal."""
    renamed = other.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys], how).drop(*[f"_right_{k}" for k in keys])


def _start(rows: DataFrame, groups: list[str], bucket: Column, figure: Column, over) -> DataFrame:
    sums = rows.groupBy(*groups, bucket.alias("_bucket")).agg(figure.alias("_f"))
    order = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(*BEFORE)
    return sums.select(*groups, "_bucket", over("_f").over(order).alias("_earlier"))


def rank(rows: DataFrame, key: str, bucket: Column, name: str = "rank", descending: bool = False, groups: tuple[str, ...] = ()) -> DataFrame:
    """Adds the rank from 1 of ``key``; ``bucket`` is a function of the key that keeps its order."""
    groups = list(groups)
    rows = rows.withColumn("_bucket", bucket)
    sums = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*groups).orderBy(F.desc("_bucket") if descending else F.asc("_bucket")).rowsBetween(*BEFORE)
    starts = sums.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*groups, "_bucket").orderBy(F.desc(key) if descending else F.asc(key))
    return null_safe_join(rows.withColumn("_r", F.row_number().over(inner)), starts, [*groups, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_r")).cast("long")).drop("_bucket", "_before", "_r")


def running_max(rows: DataFrame, groups: tuple[str, ...], order: str, value: str, name: str, width: int = 1 << 16, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the greatest ``value`` of the earlier rows of the group, null for the first; ``order`` is a whole number, ``ties`` order rows that agree in it."""
    rows = rows.withColumn("_bucket", F.floor(F.col(order) / width))
    starts = _start(rows, list(groups), F.col("_bucket"), F.max(value), F.max)
    inner = Window.partitionBy(*groups, "_bucket").orderBy(order, *ties).rowsBetween(*BEFORE)
    joined = null_safe_join(rows.withColumn("_inner", F.max(value).over(inner)), starts, [*groups, "_bucket"])
    return joined.withColumn(name, F.greatest("_inner", "_earlier")).drop("_bucket", "_inner", "_earlier")
