"""The store: trees that can be read and written, over manifests and Parquet.

Writes are small batches appended as new versions; ``compact`` folds them. Every read pins one
manifest, so scans, snapshots and counts see one state, whatever is written meanwhile. All that a
write depends on, its stamps included, is judged on the manifest that its commit follows, and judged
anew after a lost race.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.clock import stamp
from tidelog.operators import aggregate, algebra, capture, facts, mutate, resolve, scan
from tidelog.plans.schema import SYSTEM_PREFIX, TICKS_PER_DAY, hlc
from tidelog.sources.catalog import Catalog, Entry, TreeError, check_name, check_sizes, now_ticks
from tidelog.sources.manifest import Log, Manifest
from tidelog.sources.telemetry import EVENT_KINDS, Metrics, Publisher, event_rows, events_of_entries

#: How long the outcome of an operation id is remembered, and how long a cursor may idle.
OPERATION_TICKS = CURSOR_TICKS = 2 * TICKS_PER_DAY
#: Refreshes of a cached tree by what is new, before it is read in full again.
DELTAS = 8

Pairs = DataFrame | dict[str, bytes] | Iterable[tuple[str, bytes]]


def to_json(value: Any) -> bytes:
    return json.dumps(value, separators=(",", ":"), sort_keys=True).encode()


def from_json(value: bytes) -> Any:
    return json.loads(value)


class Store:
    """``publish_events`` is the default of trees that don't say; ``cache`` keeps resolved trees between reads."""

    def __init__(self, spark: SparkSession, root: str, publish_events: bool = False, cache: bool = False):
        self.spark, self.root, self.catalog = spark, root.rstrip("/"), Catalog(spark, root)
        self.metrics = Metrics()
        self.publisher = Publisher(self.root, self.metrics)
        self.publish_events, self.cache, self.held = publish_events, cache, {}

    def tree(self, tree_id: str, **options) -> Tree:
        """A tree by name, made when it isn't there."""
        self.catalog.register(tree_id, **options)
        return Tree(self, tree_id)

    def log(self, physical: str) -> Log:
        return Log(self.spark, f"{self.root}/trees/{physical}")

    def announce(self, tree_id: str, kind: str, key: str | None = None, operation_id: str | None = None) -> None:
        """One event of a tree that publishes."""
        if kind not in EVENT_KINDS:
            raise ValueError(f"no event of kind {kind}")
        entry = self.catalog.find(tree_id)
        if self.publish_events if entry is None or entry.publish_events is None else entry.publish_events:
            self.publisher.publish(event_rows(self.spark.range(1), F.lit(tree_id), F.lit(kind), F.lit(key).cast("string"), now_ticks(), operation_id), 1)

    def _finished(self, tree_id: str, kind: str, what: str) -> None:
        self.metrics.add("coordinator.completed", tag=what)
        self.announce(tree_id, kind)

    def merge(self, target: str, source: str) -> None:
        """Newest versions of both trees win in the target; the source stays."""
        check_name(target), check_name(source)
        if target == source:
            raise ValueError("a tree can't be merged with itself")
        self.catalog.need(source)
        self.tree(target).bulk_load_raw(self.tree(source).log.entries(), sort=False)
        self.metrics.add("coordinator.completed", tag="merge")

    def snapshot(self, source: str, target: str, max_leaf_keys: int | None = None, max_internal_children: int | None = None) -> None:
        """Copy the live entries, as they are, to a new tree."""
        check_name(target)
        if source == target:
            raise ValueError("a snapshot needs another name")
        entry = self.catalog.need(source)
        if self.catalog.find(target):
            raise TreeError(f"tree {target} is there already")
        sizes = (max_leaf_keys or entry.max_leaf_keys, max_internal_children or entry.max_internal_children)
        check_sizes(*sizes)
        rows = algebra.snapshot(self.tree(source).entries(), now_ticks())
        self.tree(target, max_leaf_keys=sizes[0], max_internal_children=sizes[1], shard_count=entry.shard_count).bulk_load_raw(rows)
        self._finished(source, "SnapshotCompleted", "snapshot")

    def resize(self, tree_id: str, max_leaf_keys: int, max_internal_children: int, partitions: int | None = None) -> None:
        """Rewrite a tree with other sizes under a new physical id; the old data stays for ``undo_resize``."""
        check_sizes(max_leaf_keys, max_internal_children)
        entry, tree = self.catalog.need(tree_id), self.tree(tree_id)
        now, physical = tree.log.latest(), entry.physical_id
        if now.folders:
            physical = f"{SYSTEM_PREFIX}{tree_id}_{now.version}_{max_leaf_keys}"
            new = self.log(physical)
            folder = new.write(resolve.resolve(tree.log.entries(now)), sort=True, partitions=partitions)
            new.commit(lambda m: Manifest(m.version, [folder], now.wall, now.counter, now.marks, now.operations))

        def change(e: Entry) -> None:
            e.previous = {"physical_id": e.physical_id, "max_leaf_keys": e.max_leaf_keys, "max_internal_children": e.max_internal_children}
            e.physical_id, e.max_leaf_keys, e.max_internal_children = physical, max_leaf_keys, max_internal_children

        self.catalog.update(tree_id, change)
        self._finished(tree_id, "ResizeCompleted", "resize")

    def undo_resize(self, tree_id: str) -> None:
        def change(e: Entry) -> None:
            if not e.previous:
                raise TreeError(f"tree {tree_id} was not resized")
            for k, v in e.previous.items():
                setattr(e, k, v)
            e.previous = None

        self.catalog.update(tree_id, change)

    def reshard(self, tree_id: str, shards: int) -> None:
        """Grow the shard map by splitting the largest owners; an empty tree may take any number."""
        entry = self.catalog.need(tree_id)
        if not 2 <= shards <= len(entry.slots):
            raise ValueError(f"2 to {len(entry.slots)} shards")
        if self.tree(tree_id).log.latest().folders:
            grown = aggregate.reshard(self.catalog.shard_map(tree_id), shards)
            self.catalog.set_shard_map(tree_id, [r.shard for r in grown.orderBy("slot").collect()])  # a few thousand slots
        else:
            self.catalog.set_shard_map(tree_id, [i % shards for i in range(len(entry.slots))])
        self._finished(tree_id, "ReshardCompleted", "reshard")

    def split_shard(self, tree_id: str, owner: int) -> int:
        """Move the upper half of a shard's slots to a new shard."""
        new = self.catalog.split_shard(tree_id, owner)
        self.metrics.add("shard.splits_committed")
        self.announce(tree_id, "SplitCommitted", f"{owner}->{new}")
        return new

    def soft_delete(self, tree_id: str) -> None:
        self.announce(tree_id, "TreeDeleted")
        self.catalog.soft_delete(tree_id)
        self.metrics.add("tree.lifecycle", tag="deleted")

    def recover(self, tree_id: str) -> None:
        self.catalog.recover(tree_id)
        self.metrics.add("tree.lifecycle", tag="recovered")
        self.announce(tree_id, "TreeRecovered")

    def purge(self, tree_id: str) -> None:
        entry = self.catalog.need(tree_id, deleted=True)
        self.catalog.purge(tree_id)
        self.metrics.add("tree.lifecycle", tag="purged")
        if self.publish_events if entry.publish_events is None else entry.publish_events:
            self.publisher.publish(event_rows(self.spark.range(1), F.lit(tree_id), F.lit("TreePurged"), F.lit(None), now_ticks(), None), 1)

    def set_publish_events(self, tree_id: str, value: bool | None) -> None:
        self.catalog.set_publish_events(tree_id, value)
        self.metrics.add("config.changed", tag="publish_events")

    def is_complete(self, tree_id: str) -> bool:
        """Merges, snapshots, resizes and reshards end before their call returns."""
        return True


class Tree:
    """One tree: reads pin the latest manifest, writes commit the next."""

    def __init__(self, store: Store, tree_id: str):
        self.store, self.spark, self.tree_id = store, store.spark, tree_id

    @property
    def entry(self) -> Entry:
        return self.store.catalog.need(self.tree_id)

    @property
    def log(self) -> Log:
        return self.store.log(self.entry.physical_id)

    def entries(self, version: int | None = None) -> DataFrame:
        log = self.log
        return log.entries(None if version is None else log.at(version))

    # Reads

    def _rows(self) -> DataFrame:
        """What reads see: all versions, or the winners that the cache holds, brought up to the last manifest."""
        store, log = self.store, self.log
        store.metrics.add("shard.reads")
        if not store.cache:
            return log.entries()
        m, held = log.latest(), store.held.get(log.root)
        if held and held[0] == m.version:
            store.metrics.add("cache.hits")
            return held[2]
        store.metrics.add("cache.misses")
        if held and set(held[1]) <= set(m.folders) and held[3] < DELTAS:
            rows = resolve.resolve(held[2].unionByName(log.read([f for f in m.folders if f not in held[1]]))).persist()
            store.held[log.root] = (m.version, m.folders, rows, held[3] + 1)
            return rows
        rows = resolve.resolve(log.entries(m)).persist()
        if held:
            held[2].unpersist()
        store.held[log.root] = (m.version, m.folders, rows, 0)
        return rows

    def get(self, key: str) -> bytes | None:
        with self.store.metrics.timed("leaf.scan.duration"):
            row = scan.get(self._rows(), key, now_ticks()).first()
        return None if row is None else bytes(row.value)

    def get_with_version(self, key: str) -> tuple[bytes | None, tuple[int, int]]:
        row = scan.get_with_version(self._rows(), self._keys([key]), now_ticks()).first()
        return None if row.value is None else bytes(row.value), (row.hlc.wall_ticks, row.hlc.counter)

    def exists(self, key: str) -> bool:
        return self.get(key) is not None

    def get_many(self, keys: DataFrame | Iterable[str]) -> DataFrame:
        return scan.get_many(self._rows(), self._keys(keys), now_ticks())

    def scan_keys(self, start: str | None = None, end: str | None = None, reverse: bool = False) -> DataFrame:
        return scan.scan_keys(self._rows(), now_ticks(), start, end, reverse)

    def scan_entries(self, start: str | None = None, end: str | None = None, reverse: bool = False) -> DataFrame:
        return scan.scan_entries(self._rows(), now_ticks(), start, end, reverse)

    def scan_resilient(self, start: str | None = None, end: str | None = None, reverse: bool = False, page_size: int = 512) -> Iterable[tuple[str, bytes]]:
        """Live entries in pages; each page opens the tree anew behind the last key, so the scan outlives resizes and reshards."""
        last = None
        while True:
            low, high = scan.resume_after(last, start, end, reverse)
            rows = scan.page(self._rows(), now_ticks(), page_size, None, low, high, reverse).collect()  # at most a page
            for r in rows:
                yield r.key, bytes(r.value)
            if len(rows) < page_size:
                return
            last = rows[-1].key

    def count(self) -> int:
        return aggregate.count_live(self._rows(), now_ticks()).first().n

    def count_per_shard(self) -> DataFrame:
        from tidelog.functions.hashing import virtual_slot

        slots = self.store.catalog.shard_map(self.tree_id)
        rows = resolve.live(self._rows(), now_ticks()).withColumn("slot", virtual_slot(F.col("key"))).join(slots, "slot")
        counts = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        return slots.select("shard").distinct().join(counts, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("n")).orderBy("shard")

    def diagnostics(self) -> DataFrame:
        from tidelog.functions.hashing import virtual_slot

        slots = self.store.catalog.shard_map(self.tree_id)
        rows = self.entries().withColumn("slot", virtual_slot(F.col("key"))).join(slots, "slot")
        return aggregate.diagnostics(rows, now_ticks(), F.col("shard"))

    def health(self) -> dict[str, Any]:
        """What is known of the tree without reading its data: sizes, folders to fold, rates of this process, and its last splits."""
        entry, m = self.entry, self.log.latest()
        owned = sorted(entry.slots.count(s) for s in set(entry.slots))
        return {
            "tree_id": self.tree_id, "physical_id": entry.physical_id, "is_alias": entry.physical_id in self.store.catalog.ids() and entry.physical_id != self.tree_id, "shard_count": entry.shard_count,
            "map_version": entry.map_version, "least_slots": owned[0], "most_slots": owned[-1], "version": m.version, "folders": len(m.folders), "is_compacted": m.folders == [m.compacted],
            "reads_per_second": self.store.metrics.rate("shard.reads"), "writes_per_second": self.store.metrics.rate("shard.writes"), "recent_splits": entry.recent_splits,
        }

    # Writes

    def _keys(self, keys: DataFrame | Iterable[str]) -> DataFrame:
        return keys if isinstance(keys, DataFrame) else self.spark.createDataFrame([(k,) for k in keys], "key string")

    def _requests(self, pairs: Pairs) -> DataFrame:
        """(key, value, position) without nulls."""
        if isinstance(pairs, DataFrame):
            if not pairs.where(F.col("key").isNull() | F.col("value").isNull()).isEmpty():
                raise ValueError("keys and values can't be null")
            return pairs
        pairs = list(pairs.items() if isinstance(pairs, dict) else pairs)
        if any(k is None or v is None for k, v in pairs):
            raise ValueError("keys and values can't be null")
        return self.spark.createDataFrame([(k, bytearray(v), i) for i, (k, v) in enumerate(pairs)], "key string, value binary, position int")

    def _commit(self, make: Callable[[Manifest], DataFrame | None], operation: tuple[str, list] | None = None, marks: Callable[[str], dict] | None = None, sort: bool = False, partitions: int | None = None) -> int:
        """Append what ``make`` gives for the manifest that the commit follows; returns its rows, and 0 where an operation is done already."""
        log, wrote = self.log, {}

        def change(m: Manifest) -> Manifest | None:
            wrote.clear()
            if operation and self._is_done(m, operation):
                return None
            rows = make(m)
            if rows is not None:
                folder = log.write(rows, sort, partitions)
                n, last = log.told(folder)
                if n:
                    wrote.update(n=n, folder=folder)
                    m.folders.append(folder)
                    m.wall, m.counter = max((m.wall, m.counter), last)
                    for origin, mark in (marks(folder) if marks else {}).items():
                        m.marks[origin] = max(m.marks.get(origin, [0, 0]), mark)
            if operation:
                m.operations = {k: v for k, v in m.operations.items() if v[2] + OPERATION_TICKS > now_ticks()} | {operation[0]: operation[1]}
            return m if wrote or operation else None

        with self.store.metrics.timed("leaf.write.duration"):
            log.commit(change)
        if wrote:
            self._tell(log.read([wrote["folder"]]), operation and operation[0])
        return wrote.get("n", 0)

    def _tell(self, rows: DataFrame, operation_id: str | None) -> None:
        """Count a commit and publish its events."""
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_tombstone").alias("dead")).first()
        self.store.metrics.add("shard.writes", n.n)
        self.store.metrics.add("leaf.tombstones.created", n.dead)
        if self.entry.publish_events if self.entry.publish_events is not None else self.store.publish_events:
            self.store.publisher.publish(events_of_entries(rows, self.tree_id, now_ticks(), operation_id), n.n)

    def _is_done(self, m: Manifest, operation: tuple[str, list]) -> bool:
        done = m.operations.get(operation[0])
        if not done or done[2] + OPERATION_TICKS <= now_ticks():
            return False
        if done[:2] != operation[1][:2]:
            raise TreeError(f"operation {operation[0]} was made with other keys")
        return True

    def _stamped(self, rows: DataFrame, m: Manifest, ttl_ticks: int | None = None, origin: str | None = None) -> DataFrame:
        """Set entries of ``rows(key, value, position)`` after the last stamp of a manifest."""
        now = now_ticks()
        expires = 0 if ttl_ticks is None else mutate.expiry(now, ttl_ticks)
        return mutate.entries_of(stamp(rows, now, m.wall, m.counter, "position"), F.col("hlc"), F.lit(expires), F.lit(origin))

    def set(self, key: str, value: bytes, ttl_ticks: int | None = None, origin: str | None = None) -> None:
        rows = self._requests({key: value})
        self._commit(lambda m: self._stamped(rows, m, ttl_ticks, origin))

    def set_many(self, pairs: Pairs, ttl_ticks: int | None = None) -> int:
        """Upsert in order: of a key named twice the later value wins. A DataFrame needs ``key, value, position``."""
        rows = mutate.last_of_each(self._requests(pairs), "position")
        return self._commit(lambda m: self._stamped(rows, m, ttl_ticks))

    def set_many_atomic(self, pairs: dict[str, bytes] | list[tuple[str, bytes]], operation_id: str | None = None) -> str:
        """All or nothing, in one commit; a repeated operation id with the same keys does nothing again."""
        pairs = list(pairs.items() if isinstance(pairs, dict) else pairs)
        keys, operation = [k for k, _ in pairs], None
        rows = self._requests(pairs) if pairs else None
        if len(set(keys)) < len(keys):
            raise ValueError("an atomic batch names a key once")
        if operation_id is not None:
            if not operation_id.strip() or "/" in operation_id:
                raise ValueError("an operation id is neither blank nor has a slash")
            told = "".join(f"{len(k.encode())}:{k}" for k in sorted(keys))
            operation = (operation_id, [len(keys), hashlib.sha256(told.encode()).hexdigest(), now_ticks()])
        if not pairs:
            return "committed"
        done = "committed" if self._commit(lambda m: self._stamped(rows, m), operation) else "repeated"
        self.store.metrics.add("atomic_write.completed", tag=done)
        if done == "committed":
            self.store.announce(self.tree_id, "AtomicWriteCompleted", operation_id=operation_id)
        return done

    def set_if_version(self, key: str, value: bytes, expected: tuple[int, int]) -> bool:
        return self._conditional(key, value, lambda have, stamped: stamped == expected)[0]

    def get_or_set(self, key: str, value: bytes) -> bytes | None:
        """The live value that was there, or None after writing."""
        return self._conditional(key, value, lambda have, stamped: have is None)[1]

    def _conditional(self, key, value, holds) -> tuple[bool, bytes | None]:
        """Write if a condition holds for the state that the commit follows."""
        request, done = self._requests({key: value}), {}

        def make(m: Manifest) -> DataFrame | None:
            row = scan.get_with_version(self.log.entries(m), self._keys([key]), now_ticks()).first()
            done["have"] = None if row.value is None else bytes(row.value)
            done["wrote"] = holds(done["have"], (row.hlc.wall_ticks, row.hlc.counter))
            return self._stamped(request, m) if done["wrote"] else None

        self._commit(make)
        return done["wrote"], done["have"]

    def delete(self, key: str) -> bool:
        """True unless the key is absent or deleted."""

        def make(m: Manifest) -> DataFrame | None:
            if not mutate.delete(self.log.entries(m), self._keys([key])).first().deleted:
                return None
            return resolve.tombstones(self._keys([key]), self._next(m))

        return self._commit(make) > 0

    @staticmethod
    def _next(m: Manifest):
        """One stamp after the last of a manifest."""
        return hlc(*max((now_ticks(), 0), (m.wall, m.counter + 1)))

    def delete_range(self, start: str, end: str) -> int:
        """Tombstones for the live keys in [start, end): one stamp for all, so no order is needed."""
        n = self._commit(lambda m: mutate.delete_range(self.log.entries(m), start, end, now_ticks(), self._next(m)))
        if n:
            self.store.announce(self.tree_id, "DeleteRange", f"{start}..{end}")
        return n

    def heal_shadow(self, silo: str) -> int:
        """Move a site's live shadow values to their shared keys and delete the shadows, in one commit; returns their number."""

        def make(m: Manifest) -> DataFrame:
            moved = facts.heal_shadow(self.log.entries(m), silo, now_ticks())
            promoted = mutate.entries_of(moved.select(F.col("shared_key").alias("key"), "value"), self._next(m))
            return promoted.unionByName(resolve.tombstones(moved.select("key"), self._next(m)))

        return self._commit(make) // 2

    def bulk_load(self, rows: DataFrame, partitions: int | None = None, operation_id: str | None = None) -> int:
        """Load ``rows(key, value)`` into an empty tree, range-partitioned and sorted; null or repeated keys and null values are refused."""

        def make(m: Manifest) -> DataFrame:
            if m.folders:
                raise TreeError("a bulk load needs an empty tree")
            return mutate.entries_of(rows, self._next(m))

        return self._bulk(rows, make, operation_id, partitions)

    def bulk_append(self, rows: DataFrame, operation_id: str, chunk: int = 0, partitions: int | None = None) -> int:
        """Add a chunk of ``rows(key, value)`` to a tree; a chunk of an operation that came before does nothing."""
        if not operation_id.strip():
            raise ValueError("an append needs an operation id")
        return self._bulk(rows, lambda m: mutate.entries_of(rows, self._next(m)), f"{operation_id}-{chunk}", partitions)

    def _bulk(self, rows: DataFrame, make, operation_id: str | None, partitions: int | None) -> int:
        if not self._requests(rows).groupBy("key").count().where("count > 1").isEmpty():
            raise ValueError("keys repeat")
        return self._commit(make, (operation_id, [0, "", now_ticks()]) if operation_id else None, sort=True, partitions=partitions)

    def bulk_load_stream(self, stream: DataFrame, checkpoint: str, operation_id: str):
        """Append a stream of ``(key, value)`` micro-batch by micro-batch; each is a chunk by its number, so a repeated one does nothing."""
        return stream.writeStream.foreachBatch(lambda rows, n: self.bulk_append(rows, operation_id, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def bulk_load_raw(self, entries: DataFrame, sort: bool = True) -> None:
        """Load entries with their stamps, expiry and origin as they are; the clock moves past the last of them."""
        self._commit(lambda m: entries, sort=sort)

    def apply_feed(self, feed: DataFrame, local: str, arrival: str = "sequence") -> int:
        """Apply a change feed of this tree; data and marks move in one commit, and marks only forward."""

        def make(m: Manifest) -> DataFrame:
            rows = [(self.tree_id, json.loads(o), w, c) for o, (w, c) in m.marks.items()]
            marks = self.spark.createDataFrame(rows, "tree_id string, origin_cluster_id string, w long, c int").select("tree_id", "origin_cluster_id", hlc(F.col("w"), F.col("c")).alias("hwm"))
            return capture.apply_feed(feed.withColumn("tree_id", F.lit(self.tree_id)), marks, local, arrival).where("applied")

        def marks(folder: str) -> dict[str, list[int]]:
            told = self.log.read([folder]).groupBy("origin_cluster_id").agg(F.max("hlc").alias("h")).collect()  # one row for each origin
            return {json.dumps(r.origin_cluster_id): [r.h.wall_ticks, r.h.counter] for r in told}

        return self._commit(make, marks=marks)

    def compact(self, grace_ticks: int | None = TICKS_PER_DAY, partitions: int | None = None) -> bool:
        """Fold all versions to the winners that can't be reaped; what others commit meanwhile stays. False where nothing changes."""
        log, done = self.log, {}

        def change(m: Manifest) -> Manifest | None:
            if not done or not set(done["folders"]) <= set(m.folders):  # the first time, or another compaction came between
                rows, now = log.entries(m), now_ticks()
                if m.folders in ([], [m.compacted]) and algebra.reaped(rows, now, grace_ticks).isEmpty():
                    return None
                gone = algebra.reaped(rows, now, grace_ticks).agg(F.count_if("is_tombstone").alias("dead"), F.count_if(~F.col("is_tombstone")).alias("expired")).first()
                done.update(folders=m.folders[:], folder=log.write(algebra.compact(rows, now, grace_ticks), sort=True, partitions=partitions), gone=gone)
            m.folders = [done["folder"], *[f for f in m.folders if f not in done["folders"]]]
            m.compacted = done["folder"]
            return m

        with self.store.metrics.timed("leaf.compaction.duration"):
            log.commit(change)
        if not done:
            return False
        self.store.metrics.add("leaf.tombstones.reaped", done["gone"].dead)
        self.store.metrics.add("leaf.tombstones.expired", done["gone"].expired)
        self.store._finished(self.tree_id, "CompactionCompleted", "compaction")
        return True

    # Typed values

    def typed(self, encode: Callable[[Any], bytes] = to_json, decode: Callable[[bytes], Any] = from_json) -> TypedTree:
        """The same tree with values that are encoded and decoded, as JSON unless told otherwise."""
        return TypedTree(self, encode, decode)


class TypedTree:
    """A tree whose values are Python objects; a scan decodes by a schema in Spark (``scan.typed``)."""

    def __init__(self, tree: Tree, encode: Callable[[Any], bytes], decode: Callable[[bytes], Any]):
        self.tree, self.encode, self.decode = tree, encode, decode

    def _decoded(self, value: bytes | None) -> Any:
        return None if value is None else self.decode(value)

    def _encoded(self, pairs: dict[str, Any] | Iterable[tuple[str, Any]]) -> list[tuple[str, bytes]]:
        return [(k, self.encode(v)) for k, v in (pairs.items() if isinstance(pairs, dict) else pairs)]

    def get(self, key: str) -> Any:
        return self._decoded(self.tree.get(key))

    def get_with_version(self, key: str) -> tuple[Any, tuple[int, int]]:
        value, version = self.tree.get_with_version(key)
        return self._decoded(value), version

    def get_many(self, keys: Iterable[str]) -> dict[str, Any]:
        """The values of a list of keys that the caller holds."""
        return {r.key: self.decode(bytes(r.value)) for r in self.tree.get_many(list(keys)).collect()}

    def get_or_set(self, key: str, value: Any) -> Any:
        return self._decoded(self.tree.get_or_set(key, self.encode(value)))

    def set(self, key: str, value: Any, ttl_ticks: int | None = None) -> None:
        self.tree.set(key, self.encode(value), ttl_ticks)

    def set_if_version(self, key: str, value: Any, expected: tuple[int, int]) -> bool:
        return self.tree.set_if_version(key, self.encode(value), expected)

    def set_many(self, pairs, ttl_ticks: int | None = None) -> int:
        return self.tree.set_many(self._encoded(pairs), ttl_ticks)

    def set_many_atomic(self, pairs, operation_id: str | None = None) -> str:
        return self.tree.set_many_atomic(self._encoded(pairs), operation_id)

    def bulk_load(self, rows: DataFrame, *columns: str, operation_id: str | None = None) -> int:
        """Load rows whose ``columns`` become one JSON value."""
        return self.tree.bulk_load(scan.encode(rows, *columns).select("key", "value"), operation_id=operation_id)

    def entries(self, schema, start: str | None = None, end: str | None = None, reverse: bool = False) -> DataFrame:
        """(key, value, typed) in key order, decoded by a schema in Spark."""
        return scan.typed(self.tree.scan_entries(start, end, reverse), schema)
