"""Writes as queries: each returns the entries to append, or what the caller is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.operators.resolve import is_expired, is_live, live, resolve, tombstones
from tidelog.operators.scan import in_range
from tidelog.plans.schema import zero


def entries_of(requests: DataFrame, stamp: Column, expires: Column | None = None, origin: Column | None = None) -> DataFrame:
    """Set entries for ``requests(key, value)``; a plain set clears any expiry."""
    return requests.select("key", F.col("value").cast("binary").alias("value"), stamp.alias("hlc"), F.lit(False).alias("is_tombstone"), (F.lit(0) if expires is None else expires).cast("long").alias("expires_at_ticks"), (F.lit(None) if origin is None else origin).cast("string").alias("origin_cluster_id"))


def last_of_each(requests: DataFrame, position: str) -> DataFrame:
    """Of a batch that names a key twice, the later request."""
    return requests.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(position)))).where("_n = 1").drop("_n")


def expiry(now_ticks: int, ttl_ticks: int) -> int:
    """The absolute tick at which a time to live ends."""
    if ttl_ticks <= 0:
        raise ValueError("a time to live must be positive")
    if now_ticks + ttl_ticks >= 2**63:
        raise OverflowError("the time to live ends beyond the last tick")
    return now_ticks + ttl_ticks


def set_if_version(entries: DataFrame, requests: DataFrame, now_ticks: int) -> DataFrame:
    """(key, new_value, applied, current) for ``requests(key, new_value, expected)``.

    A key that isn't live stands at the zero stamp, so it takes a request that expects zero.
    """
    now = live(entries.join(requests.select("key"), "key", "left_semi"), now_ticks).select("key", F.col("hlc").alias("current"))
    both = requests.join(now, "key", "left").withColumn("current", F.coalesce("current", zero()))
    return both.select("key", "new_value", (F.col("current") == F.col("expected")).alias("applied"), "current")


def get_or_set(entries: DataFrame, requests: DataFrame, now_ticks: int) -> DataFrame:
    """(key, existing, wrote) for ``requests(key, value)``: a live value is returned, else the request is written."""
    now = live(entries.join(requests.select("key"), "key", "left_semi"), now_ticks).select("key", F.col("value").alias("existing"), F.lit(True).alias("_live"))
    return requests.select("key", "value").join(now, "key", "left").select("key", "value", "existing", F.col("_live").isNull().alias("wrote"))


def delete(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, deleted) for ``requests(key)``: true unless the key is absent or deleted; an expired key counts as there."""
    there = resolve(entries.join(requests.select("key"), "key", "left_semi")).where(~F.col("is_tombstone")).select("key", F.lit(True).alias("_there"))
    return requests.select("key").distinct().join(there, "key", "left").select("key", F.col("_there").isNotNull().alias("deleted"))


def delete_range(entries: DataFrame, start: str, end: str, now_ticks: int, stamp: Column, origin: Column | None = None) -> DataFrame:
    """Tombstones for the live keys in [start, end); expired keys are left alone."""
    return tombstones(live(entries.where(in_range(start, end)), now_ticks).select("key"), stamp, origin)


def delete_range_step(entries: DataFrame, start: str, end: str, size: int, now_ticks: int) -> DataFrame:
    """The keys that one step of a paged range delete removes, each with ``is_complete`` of the step."""
    probe = live(entries.where(in_range(start, end)), now_ticks).select("key").orderBy("key").limit(size + 1)
    ranked = probe.withColumn("n", F.row_number().over(Window.orderBy("key"))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.where(F.col("n") <= size).select("key", (F.col("total") <= size).alias("is_complete"))


def key_fingerprint(batches: DataFrame) -> DataFrame:
    """(operation_id, n_keys, fingerprint) of ``batches(operation_id, key)``: a digest of the sorted, length-prefixed keys.

    A repeated operation must bring the same keys; values and the order of keys don't matter.
    """
    keys = F.array_sort(F.collect_list("key"))
    told = F.concat_ws("", F.transform(keys, lambda k: F.concat(F.octet_length(k).cast("string"), F.lit(":"), k)))
    return batches.groupBy("operation_id").agg(F.count(F.lit(1)).alias("n_keys"), F.sha2(told, 256).alias("fingerprint"))


def pre_image(entries: DataFrame, batch: DataFrame, now_ticks: int) -> DataFrame:
    """(key, had_value, value, expires_at_ticks, action): what undoing a batch would do with each key.

    ``restore`` writes the old value with what is left of its time; an expired or absent key gets a tombstone.
    """
    before = resolve(entries.join(batch.select("key"), "key", "left_semi")).withColumn("_live", is_live(now_ticks)).withColumn("_expired", is_expired(now_ticks))
    both = batch.select("key").distinct().join(before, "key", "left")
    was = F.coalesce("_live", F.lit(False))
    action = F.when(was, "restore").when(F.coalesce("_expired", F.lit(False)), "expire").otherwise("delete")
    return both.select("key", was.alias("had_value"), F.when(was, F.col("value")).alias("value"), F.when(was, F.col("expires_at_ticks")).otherwise(0).cast("long").alias("expires_at_ticks"), action.alias("action"))


def compensate(images: DataFrame, stamp: Column) -> DataFrame:
    """Entries that undo a batch, from its pre-images."""
    back = F.col("had_value")
    return images.select("key", "value", stamp.alias("hlc"), (~back).alias("is_tombstone"), "expires_at_ticks", F.lit(None).cast("string").alias("origin_cluster_id"))
