"""Registered queries that go through the mutable store: each writes the mutation log to a store of its own and reads it back.

The store's clock is that of today, so every entry of the log that expires at all has expired.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators import resolve
from tidelog.plans.registry import FLAT, evlog, flat, query, text
from tidelog.plans.schema import ENTRIES
from tidelog.sources.cursor import Cursors
from tidelog.sources.store import Store

ALIVE = "NOT is_tombstone AND expires = 0"


def scratch(spark: SparkSession, **options) -> Store:
    """A new store in the folder that the cluster shares, or in a temporary one where it names none on a local master; it goes when the driver ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidelog-store-")
    store = Store(spark, f"{named.rstrip('/')}/stores/{uuid.uuid4().hex}", **options)

    def drop() -> None:
        with contextlib.suppress(Exception):  # at exit the JVM may be gone already
            store.catalog.files.delete("")

    atexit.register(drop)
    return store


def loaded(spark: SparkSession, d: str, where: str = "true", name: str = "log", **options):
    """A tree that holds the log's entries with their stamps."""
    tree = scratch(spark, **options).tree(name)
    tree.bulk_load_raw(evlog(spark, d).where(where).select(*ENTRIES.names))
    return tree


@query(f"SELECT key, value FROM resolved WHERE {ALIVE}")
def store_scan(spark, d):
    return text(loaded(spark, d).scan_entries(), "key", "value")


@query(f"SELECT key, value FROM resolved WHERE {ALIVE}")
def store_merge(spark, d):
    tree = loaded(spark, d, "event_id % 2 = 0")
    tree.store.tree("other").bulk_load_raw(evlog(spark, d).where("event_id % 2 = 1").select(*ENTRIES.names))
    tree.store.merge("log", "other")
    return text(tree.scan_entries(), "key", "value")


@query(f"SELECT {FLAT} FROM resolved WHERE {ALIVE}")
def store_snapshot(spark, d):
    tree = loaded(spark, d)
    tree.store.snapshot("log", "copy")
    return flat(tree.store.tree("copy").entries())


@query(f"SELECT {FLAT} FROM resolved WHERE {ALIVE}")
def store_compact(spark, d):
    tree = loaded(spark, d)
    tree.compact(grace_ticks=0)
    return flat(tree.entries())


@query(f"SELECT {FLAT} FROM resolved")
def store_resize(spark, d):
    tree = loaded(spark, d)
    tree.store.resize("log", 64, 32)
    return flat(tree.entries())


@query(f"SELECT key FROM resolved WHERE {ALIVE} AND NOT (key >= 'u00010/' AND key < 'u00020/')")
def store_delete_range(spark, d):
    tree = loaded(spark, d)
    tree.delete_range("u00010/", "u00020/")
    return tree.scan_keys()


@query(f"SELECT key, coalesce(max(CASE WHEN event_id % 2 = 1 THEN 'new' END), any_value(live_value)) AS value FROM evlog LEFT JOIN (SELECT key, value AS live_value FROM (SELECT * FROM evlog WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY wall DESC, ctr DESC) = 1) WHERE {ALIVE}) USING (key) GROUP BY key HAVING max(event_id % 2) = 1 OR any_value(live_value) IS NOT NULL")
def store_set_many(spark, d):
    tree = loaded(spark, d, "event_id % 2 = 0")
    tree.set_many(evlog(spark, d).where("event_id % 2 = 1").select("key", F.lit(b"new").alias("value"), F.col("event_id").alias("position")))
    return text(tree.scan_entries(), "key", "value")


@query(f"SELECT key, value FROM resolved WHERE {ALIVE}")
def store_apply_feed(spark, d):
    tree = loaded(spark, d, "origin_cluster_id = 'site-a'")
    feed = evlog(spark, d).where("origin_cluster_id = 'site-b'").withColumn("sequence", F.col("event_id"))
    tree.apply_feed(feed.select(*ENTRIES.names, "sequence"), "site-a")
    return text(tree.scan_entries(), "key", "value")


@query(f"SELECT key, CAST(user_id AS BIGINT) AS user FROM resolved WHERE {ALIVE}")
def store_typed(spark, d):
    live = loaded(spark, d).scan_entries().select("key", F.substring("key", 2, 5).cast("long").alias("user"))
    tree = scratch(spark).tree("typed").typed()
    tree.bulk_load(live, "user")
    return tree.entries(T.StructType([T.StructField("user", T.LongType())])).select("key", F.col("typed.user").alias("user"))


@query("SELECT key, count(*) AS n FROM evlog WHERE NOT is_tombstone GROUP BY key")
def store_bulk_append(spark, d):
    """The chunks of a load, each under its number and one of them twice: how often each key came."""
    tree, rows = scratch(spark).tree("log"), evlog(spark, d).where("NOT is_tombstone").withColumn("chunk", F.col("event_id") % 3)
    for chunk in (0, 1, 1, 2):
        part = rows.where(F.col("chunk") == chunk).groupBy("key").agg(F.count(F.lit(1)).cast("string").cast("binary").alias("value"))
        tree.bulk_append(part, "load", chunk)
    return tree.entries().groupBy("key").agg(F.sum(F.col("value").cast("string").cast("long")).alias("n"))


@query("SELECT CASE WHEN is_tombstone THEN 'Delete' ELSE 'Set' END AS kind, key, count(*) AS n FROM evlog GROUP BY ALL")
def store_events(spark, d):
    tree = loaded(spark, d, publish_events=True)
    return spark.read.parquet(f"{tree.store.root}/events").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


PAGES = f"SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM resolved WHERE {ALIVE} AND key >= 'u00003/' AND key < 'u00009/'"


@query(f"SELECT key, i // 4 AS page, least(4, n - i // 4 * 4) = 4 AS has_more FROM ({PAGES})")
def store_cursor_pages(spark, d):
    """The pages of a cursor over a small range, one by one: a full page says that there is more."""
    tree = loaded(spark, d)
    cursors, rows, page, more = Cursors(tree.store), [], 0, True
    name = cursors.open("log", "keys", "u00003/", "u00009/")
    while more:
        keys, more = cursors.next(name, "keys", 4)
        rows += [(k, page, more) for k in keys]
        page += 1
    return spark.createDataFrame(rows, "key string, page long, has_more boolean")


@query(f"SELECT key FROM resolved WHERE {ALIVE} AND NOT (key >= 'u00003/' AND key < 'u00009/')")
def store_cursor_delete(spark, d):
    tree = loaded(spark, d)
    cursors = Cursors(tree.store)
    name, done = cursors.open("log", "deletes", "u00003/", "u00009/"), False
    while not done:
        _, _, done = cursors.delete_step(name, 12)
    return tree.scan_keys()


@query(f"SELECT key, value FROM resolved WHERE {ALIVE}")
def store_read_cache(spark, d):
    """Reads through the cache: the first fills it, the second brings it up to the entries that came meanwhile."""
    tree = scratch(spark, cache=True).tree("log")
    for half in (0, 1):
        tree.bulk_load_raw(evlog(spark, d).where(F.col("event_id") % 2 == half).select(*ENTRIES.names))
        found = text(tree.scan_entries(), "key", "value")
        found.isEmpty()
    return found


@query(f"SELECT key, row_number() OVER (ORDER BY key DESC) - 1 AS i FROM resolved WHERE {ALIVE} AND key >= 'u00003/' AND key < 'u00009/'")
def store_resilient_scan(spark, d):
    """A small range from its end, page by page, while the tree is resized under the scan."""
    tree = loaded(spark, d)
    rows = []
    for i, (key, _) in enumerate(tree.scan_resilient("u00003/", "u00009/", reverse=True, page_size=16)):
        if i == 16:
            tree.store.resize("log", 64, 32)
        rows.append((key, i))
    return spark.createDataFrame(rows, "key string, i long")


@query(f"SELECT {FLAT} FROM resolved")
def store_undo_resize(spark, d):
    tree = loaded(spark, d)
    tree.store.resize("log", 64, 32)
    tree.store.undo_resize("log")
    return flat(resolve.resolve(tree.entries()))


@query(f"SELECT 'before' AS state, 64 AS shards, count(*) AS n FROM resolved WHERE {ALIVE} UNION ALL SELECT 'after', 71, count(*) FROM resolved WHERE {ALIVE}")
def store_reshard(spark, d):
    """Shards and keys of a tree before its map grows to 70 shards, one of which splits again, and after: no key is lost."""
    tree = loaded(spark, d)
    told = lambda state: tree.count_per_shard().agg(F.lit(state).alias("state"), F.count(F.lit(1)).cast("int").alias("shards"), F.sum("n").alias("n"))
    before = told("before")
    tree.store.reshard("log", 70)
    tree.store.split_shard("log", 0)
    return before.unionByName(told("after"))


@query(f"SELECT key, value FROM resolved WHERE {ALIVE}")
def store_recover(spark, d):
    """A tree that was deleted and recovered, beside an alias of it that was purged."""
    tree = loaded(spark, d)
    store = tree.store
    store.tree("other")
    store.catalog.set_alias("other", "log")
    store.soft_delete("other")
    store.purge("other")
    store.soft_delete("log")
    store.recover("log")
    return text(tree.scan_entries(), "key", "value")


@query("SELECT 'Set' AS kind, 'batch/' || lpad(CAST(i AS VARCHAR), 2, '0') AS key, 'op' AS operation_id, 'first' AS value FROM range(20) r(i) UNION ALL SELECT 'AtomicWriteCompleted', NULL, 'op', NULL")
def store_atomic(spark, d):
    """The events of a batch that came twice under one operation id, with the values that its keys have."""
    store = scratch(spark, publish_events=True)
    tree = store.tree("log")
    for value in (b"first", b"again"):
        tree.set_many_atomic({f"batch/{i:02d}": value for i in range(20)}, operation_id="op")
    events = spark.read.parquet(f"{store.root}/events").select("kind", "key", "operation_id")
    return events.join(text(tree.scan_entries(), "key", "value"), "key", "left").select("kind", "key", "operation_id", "value")
