"""Point reads, ordered scans and keyset pages over entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.resolve import is_live, live, resolve
from tidelog.plans.schema import zero


def in_range(start: str | None, end: str | None) -> Column:
    """start <= key < end, either bound open; it reaches the Parquet scan."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col("key") >= start)
    return out & (F.col("key") < end) if end is not None else out


def get(entries: DataFrame, key: str, now_ticks: int) -> DataFrame:
    """The live value of one key: no row when absent, deleted or expired."""
    return live(entries.where(F.col("key") == key), now_ticks).select("key", "value")


def get_with_version(entries: DataFrame, keys: DataFrame, now_ticks: int) -> DataFrame:
    """(key, value, hlc) for each key asked; a key that isn't live has a null value and the zero stamp."""
    found = live(entries.join(keys.select("key"), "key", "left_semi"), now_ticks).select("key", "value", "hlc")
    return keys.select("key").distinct().join(found, "key", "left").select("key", "value", F.coalesce("hlc", zero()).alias("hlc"))


def exists(entries: DataFrame, keys: DataFrame, now_ticks: int) -> DataFrame:
    """(key, found) for each key asked."""
    return get_with_version(entries, keys, now_ticks).select("key", (F.col("hlc") > zero()).alias("found"))


def get_many(entries: DataFrame, keys: DataFrame, now_ticks: int) -> DataFrame:
    """(key, value) of the live keys among those asked; keys asked twice come once."""
    return live(entries.join(keys.select("key"), "key", "left_semi"), now_ticks).select("key", "value")


def get_raw(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Winning versions with metadata, expired ones included, deleted ones not."""
    return resolve(entries.join(keys.select("key"), "key", "left_semi")).where(~F.col("is_tombstone"))


def scan_entries(entries: DataFrame, now_ticks: int, start: str | None = None, end: str | None = None, reverse: bool = False) -> DataFrame:
    """(key, value) of the live keys in [start, end), in key order; ``reverse`` turns the order alone."""
    found = live(entries.where(in_range(start, end)), now_ticks).select("key", "value")
    return found.orderBy(F.desc("key") if reverse else F.asc("key"))


def scan_keys(entries: DataFrame, now_ticks: int, start: str | None = None, end: str | None = None, reverse: bool = False) -> DataFrame:
    """(key) of the live keys in [start, end), in key order."""
    return live(entries.where(in_range(start, end)), now_ticks).select("key").orderBy(F.desc("key") if reverse else F.asc("key"))


def effective_range(start: str | None, end: str | None, after: str | None, reverse: bool) -> Column:
    """The range that is left once ``after`` was yielded."""
    out = in_range(start, end)
    if after is None:
        return out
    return out & (F.col("key") < after if reverse else F.col("key") > after)


def page(entries: DataFrame, now_ticks: int, size: int, after: str | None = None, start: str | None = None, end: str | None = None, reverse: bool = False, slots: DataFrame | None = None, slot: Column | None = None) -> DataFrame:
    """The next ``size`` live entries after a key: a top-k by key, not a sort. ``slots(slot)`` keeps to keys of some slots."""
    rows = entries.where(effective_range(start, end, after, reverse))
    if slots is not None:
        rows = rows.withColumn("slot", slot).join(slots.select("slot"), "slot", "left_semi").drop("slot")
    return live(rows, now_ticks).select("key", "value").orderBy(F.desc("key") if reverse else F.asc("key")).limit(size)


def resume_after(last: str | None, start: str | None, end: str | None, reverse: bool) -> tuple[str | None, str | None]:
    """Bounds that reopen an interrupted scan: after ``last`` going up, below it going down."""
    if last is None:
        return start, end
    return (start, last) if reverse else (last + "\0", end)


def typed(rows: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Values decoded from JSON by the caller's schema, which is never inferred."""
    return rows.withColumn("typed", F.from_json(F.col(value).cast("string"), schema))


def encode(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns encoded as one JSON value."""
    return rows.withColumn("value", F.to_json(F.struct(*columns)).cast("binary"))


def live_filter(entries: DataFrame, now_ticks: int) -> DataFrame:
    """The liveness filter alone, over rows that are resolved already."""
    return entries.where(is_live(now_ticks))
