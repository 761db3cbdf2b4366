"""The mutable API: one test per behaviour, over a store in a temporary folder."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import resolve
from tidelog.plans.schema import TICKS_PER_DAY, hlc
from tidelog.sources.catalog import TreeError, now_ticks
from tidelog.sources.cursor import CursorError, Cursors
from tidelog.sources.manifest import Conflict, Log
from tidelog.sources.store import Store


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def keys(df):
    return [r.key for r in df.collect()]


def test_set_get_overwrite_delete(store):
    t = store.tree("t")
    assert t.get("a") is None and not t.exists("a") and t.get_with_version("a") == (None, (0, 0))
    t.set("a", b"1")
    first = t.get_with_version("a")
    t.set("a", b"2")
    assert t.get("a") == b"2" and t.get_with_version("a")[1] > first[1]
    assert t.delete("a") and not t.delete("a") and not t.delete("missing")
    assert t.get("a") is None and t.count() == 0


def test_scans(store):
    t = store.tree("t")
    t.set_many({k: k.encode() for k in "cabfed"})
    t.delete("e")
    assert keys(t.scan_keys()) == list("abcdf") and keys(t.scan_keys(reverse=True)) == list("fdcba")
    assert keys(t.scan_keys("b", "e")) == list("bcd") and keys(t.scan_entries("b", "e", reverse=True)) == list("dcb")
    assert sorted(keys(t.get_many(["a", "a", "zz", "e"]))) == ["a"]


def test_later_of_a_batch_wins(store):
    t = store.tree("t")
    assert t.set_many([("a", b"1"), ("b", b"2"), ("a", b"3")]) == 2
    assert t.get("a") == b"3"
    with pytest.raises(ValueError):
        t.set_many([("a", None)])


def test_time_to_live(store, spark):
    t = store.tree("t")
    t.set("a", b"1", ttl_ticks=TICKS_PER_DAY)
    t.set("b", b"1", ttl_ticks=1)
    assert t.get("a") == b"1" and t.get("b") is None
    assert t.delete("b") and not t.delete("b")  # an expired key counts as there, once
    t.set("a", b"2")
    assert t.entries().groupBy("key").agg(F.max_by("expires_at_ticks", "hlc").alias("e")).where("key = 'a'").first().e == 0
    for ttl, error in ((0, ValueError), (-5, ValueError), (2**63, OverflowError)):
        with pytest.raises(error):
            t.set("a", b"1", ttl_ticks=ttl)


def test_conditional_writes(store):
    t = store.tree("t")
    assert not t.set_if_version("a", b"1", (5, 0)) and t.set_if_version("a", b"1", (0, 0))
    version = t.get_with_version("a")[1]
    assert not t.set_if_version("a", b"2", (0, 0)) and t.set_if_version("a", b"2", version) and not t.set_if_version("a", b"3", version)
    assert t.get_or_set("a", b"9") == b"2" and t.get_or_set("b", b"9") is None and t.get("b") == b"9"


def test_atomic_batches(store):
    t = store.tree("t")
    assert t.set_many_atomic({"a": b"1", "b": b"2"}, "op") == "committed"
    before = t.log.latest().version
    assert t.set_many_atomic([("b", b"7"), ("a", b"8")], "op") == "repeated" and t.get("a") == b"1" and t.log.latest().version == before
    with pytest.raises(TreeError):
        t.set_many_atomic({"a": b"1", "c": b"2"}, "op")
    for pairs, op in (([("a", b"1"), ("a", b"2")], None), ([("a", None)], None), ([("a", b"1")], " "), ([("a", b"1")], "x/y")):
        with pytest.raises(ValueError):
            t.set_many_atomic(pairs, op)
    assert t.set_many_atomic([]) == "committed" and t.log.latest().version == before


def test_delete_range(store):
    t = store.tree("t")
    t.set_many({k: b"1" for k in "abcdef"})
    assert t.delete_range("b", "e") == 3 and t.delete_range("b", "e") == 0 and keys(t.scan_keys()) == list("aef")


def test_bulk_load(store, spark):
    t = store.tree("t")
    rows = spark.range(100).select(F.format_string("k%03d", "id").alias("key"), F.lit(b"v").alias("value"))
    assert t.bulk_load(rows, 3, "load") == 100 and t.bulk_load(rows, 3, "load") == 0
    with pytest.raises(TreeError):
        t.bulk_load(rows)
    with pytest.raises(ValueError):
        store.tree("u").bulk_load(rows.union(rows))


def test_cursors_page_and_survive(store):
    t, c = store.tree("t"), Cursors(store)
    t.set_many({k: b"1" for k in "abcdef"})
    name = c.open("t", "keys")
    assert c.next(name, "keys", 4) == (list("abcd"), True)
    assert Cursors(store).next(name, "keys", 2) == (list("ef"), True)  # a full page says more, even the last
    assert c.next(name, "keys", 2) == ([], False) and c.next(name, "keys", 2) == ([], False)
    back = c.open("t", "entries", "b", "e", reverse=True)
    assert c.next(back, "entries", 9) == ([("d", b"1"), ("c", b"1"), ("b", b"1")], False)
    with pytest.raises(CursorError):
        c.next(back, "keys", 1)
    assert c.open("t", "entries", "b", "e", True, back) == back
    with pytest.raises(CursorError):
        c.open("t", "entries", "b", "f", True, back)
    c.close(back), c.close(back)
    with pytest.raises(CursorError):
        c.next(back, "entries", 1)
    assert c.sweep() == [] and c.sweep(now_ticks() + 3 * TICKS_PER_DAY) == [name]


def test_delete_cursor(store):
    t, c = store.tree("t"), Cursors(store)
    t.set_many({k: b"1" for k in "abcdef"})
    with pytest.raises(ValueError):
        c.open("t", "deletes", "a")
    name = c.open("t", "deletes", "b", "f")
    assert c.delete_step(name, 3) == (3, 3, False) and c.delete_step(name, 3) == (1, 4, True) and c.delete_step(name, 3) == (0, 4, True)
    assert keys(t.scan_keys()) == ["a", "f"]


def test_merge_snapshot_compact(store):
    a, b = store.tree("a"), store.tree("b")
    a.set_many({"x": b"old", "y": b"1"})
    b.set_many({"x": b"new", "z": b"2"})
    b.delete("z")
    store.merge("a", "b")
    store.merge("a", "b")
    assert {r.key: bytes(r.value) for r in a.scan_entries().collect()} == {"x": b"new", "y": b"1"}
    store.snapshot("a", "copy")
    a.set("y", b"later")
    assert store.tree("copy").get("y") == b"1"
    assert resolve.resolve(store.tree("copy").entries()).where("is_tombstone").count() == 0
    for bad in (lambda: store.snapshot("a", "copy"), lambda: store.merge("a", "none")):
        with pytest.raises(TreeError):
            bad()
    for bad in (lambda: store.snapshot("a", "a"), lambda: store.merge("a", "a"), lambda: store.snapshot("a", "_tidelog_x"), lambda: store.snapshot("a", "n", 1, 9)):
        with pytest.raises(ValueError):
            bad()
    a.compact(grace_ticks=None)
    assert a.entries().where("is_tombstone").count() == 1
    a.compact(grace_ticks=0)
    assert a.entries().count() == 2 and len(a.log.latest().folders) == 1
    assert a.log.vacuum() and a.get("x") == b"new"


def test_resize_and_undo(store):
    t = store.tree("t")
    t.set_many({k: b"1" for k in "abc"})
    store.resize("t", 64, 32)
    t.set("d", b"1")
    assert t.count() == 4 and t.entry.max_leaf_keys == 64
    store.undo_resize("t")
    assert t.count() == 3 and t.entry.max_leaf_keys == 128
    with pytest.raises(TreeError):
        store.undo_resize("t")


def test_shards(store):
    t = store.tree("t", shard_count=4)
    t.set_many({f"k{i}": b"1" for i in range(30)})
    assert sum(r.n for r in t.count_per_shard().collect()) == 30 and t.count_per_shard().count() == 4
    assert store.split_shard("t", 0) == 4
    slots = store.catalog.need("t").slots
    assert slots.count(0) == slots.count(4) == 512 and max(i for i, s in enumerate(slots) if s == 0) < min(i for i, s in enumerate(slots) if s == 4)
    store.reshard("t", 8)
    assert len(set(store.catalog.need("t").slots)) == 8 and t.count() == 30
    with pytest.raises(ValueError):
        store.reshard("t", 4)
    total = t.diagnostics().where("shard IS NULL").first()
    assert (total.live, total.tombstones, total.tombstone_ratio) == (30, 0, 0.0)


def test_lifecycle(store):
    c = store.catalog
    store.tree("t").set("a", b"1")
    c.soft_delete("t"), c.soft_delete("t")
    assert not c.exists("t")
    with pytest.raises(TreeError):
        store.tree("t").get("a")
    c.recover("t")
    assert store.tree("t").get("a") == b"1"
    for bad in (c.recover, c.purge):
        with pytest.raises(TreeError):
            bad("t")
    c.soft_delete("t")
    assert c.sweep() == [] and c.sweep(now_ticks() + 4 * TICKS_PER_DAY) == ["t"] and c.ids() == []


def test_aliases_and_names(store):
    c = store.catalog
    store.tree("a").set("k", b"1")
    store.tree("b")
    c.set_alias("b", "a")
    assert store.tree("b").get("k") == b"1" and c.resolve("b") == "a"
    store.tree("z")
    for target in ("z", "b"):
        with pytest.raises(ValueError):
            c.set_alias("z", target)
    c.remove_alias("b")
    assert store.tree("b").get("k") is None and c.ids() == ["a", "b", "z"]
    for name in ("_tidelog_x", "", "a/b"):
        with pytest.raises(ValueError):
            store.tree(name)


def test_racing_commits(store, spark):
    log = store.tree("t").log
    other, lost = Log(spark, log.root), []

    def change(m):
        if not lost:  # another writer is faster, once
            lost.append(other.commit(lambda n: n).version)
        return m

    assert log.commit(change).version == 2 and lost == [1]
    with pytest.raises(Conflict):
        log.commit(lambda m: (other.commit(lambda n: n), m)[1], attempts=2)


def test_two_sites_converge(store, spark):
    sites = {}
    for name, writes in (("east", {"a": b"1", "b": b"2"}), ("west", {"b": b"3", "c": b"4"})):
        sites[name] = store.tree(name)
        for k, v in writes.items():
            sites[name].set(k, v, origin=name)
    sites["east"].delete("a")
    east, west = (sites[n].entries().withColumn("origin_cluster_id", F.coalesce("origin_cluster_id", F.lit(n))).withColumn("sequence", F.col("hlc.wall_ticks")) for n in ("east", "west"))
    east, west = (spark.createDataFrame(x.collect(), x.schema) for x in (east, west))
    assert sites["west"].apply_feed(east, "west") == 3 and sites["east"].apply_feed(west, "east") == 2
    assert sites["west"].apply_feed(east, "west") == 0  # again: all at or below the mark
    a, b = ({r.key: bytes(r.value) for r in sites[n].scan_entries().collect()} for n in ("east", "west"))
    assert a == b == {"b": b"3", "c": b"4"}


def test_raw_load_keeps_stamps(store, spark):
    e = spark.range(3).select(F.format_string("k%d", "id").alias("key"), F.lit(b"v").alias("value"), hlc(F.col("id") + 5, 1).alias("hlc"), F.lit(False).alias("is_tombstone"), F.lit(0).cast("long").alias("expires_at_ticks"), F.lit("far").alias("origin_cluster_id"))
    t = store.tree("t")
    t.bulk_load_raw(e)
    assert t.get_with_version("k2") == (b"v", (7, 1))


def rival(store, action):
    """Makes the tree's next commit lose a race to ``action``, once."""
    log_class, done = Log, []
    first = log_class.write

    def write(self, rows, *args, **kwargs):
        folder = first(self, rows, *args, **kwargs)
        if not done:
            done.append(1)
            action()
        return folder

    return log_class, write


def test_compaction_keeps_what_others_commit(store, monkeypatch):
    t = store.tree("t")
    for k in "abc":
        t.set(k, b"1")
    cls, write = rival(store, lambda: (store.tree("t").compact(grace_ticks=0), store.tree("t").set("new", b"2")))
    monkeypatch.setattr(cls, "write", write)
    t.compact(grace_ticks=0)
    monkeypatch.undo()
    assert t.get("new") == b"2" and t.count() == 4 and t.get("a") == b"1"
    t.set("c", b"3")
    assert t.compact(grace_ticks=0) and not t.compact(grace_ticks=0)  # nothing left to do


def test_merged_and_loaded_stamps_move_the_clock(store, spark):
    far = now_ticks() + 9 * TICKS_PER_DAY
    e = spark.createDataFrame([("k", b"old", (far, 3), False, 0, "far")], resolve_schema())
    store.tree("a").bulk_load_raw(e)
    store.merge("b", "a")
    store.snapshot("a", "c")
    for name in "abc":
        t = store.tree(name)
        t.set("k", b"new")
        assert t.get("k") == b"new" and t.get_with_version("k")[1] > (far, 3)


def resolve_schema():
    from tidelog.plans.schema import ENTRIES

    return ENTRIES


def test_null_values_are_refused(store, spark):
    t = store.tree("t")
    t.set("a", b"1")
    nulls = spark.createDataFrame([("a", None, 0)], "key string, value binary, position int")
    for bad in (lambda: t.set_many(nulls), lambda: store.tree("u").bulk_load(nulls.drop("position")), lambda: t.set_many([(None, b"1")])):
        with pytest.raises(ValueError):
            bad()
    assert t.get("a") == b"1"


def test_an_operation_is_judged_in_its_commit(store, monkeypatch):
    t, told = store.tree("t"), []
    cls, write = rival(store, lambda: told.append(store.tree("t").set_many_atomic({"a": b"1"}, "op")))
    monkeypatch.setattr(cls, "write", write)
    told.append(t.set_many_atomic({"a": b"2"}, "op"))
    monkeypatch.undo()
    assert told == ["committed", "repeated"] and t.get("a") == b"1"


def test_a_bulk_load_that_loses_a_race_finds_the_tree_full(store, spark, monkeypatch):
    t = store.tree("t")
    rows = spark.createDataFrame([("a", b"1")], "key string, value binary")
    cls, write = rival(store, lambda: store.tree("t").set("z", b"9"))
    monkeypatch.setattr(cls, "write", write)
    with pytest.raises(TreeError):
        t.bulk_load(rows)


def test_marks_move_forward_only(store, spark, monkeypatch):
    t = store.tree("t")

    def feed(*walls):
        return spark.createDataFrame([(f"k{w}", b"v", (w, 0), False, 0, "far", w) for w in walls], "key string, value binary, hlc struct<wall_ticks:bigint,counter:int>, is_tombstone boolean, expires_at_ticks bigint, origin_cluster_id string, sequence long")

    cls, write = rival(store, lambda: store.tree("t").apply_feed(feed(9), "me"))
    monkeypatch.setattr(cls, "write", write)
    assert t.apply_feed(feed(5), "me") == 0  # judged anew: the mark stands at 9 by then
    monkeypatch.undo()
    assert t.log.latest().marks == {'"far"': [9, 0]} and t.apply_feed(feed(7, 10), "me") == 1


def test_purge_of_an_alias_spares_its_target(store):
    store.tree("a").set("k", b"1")
    store.tree("b").set("k", b"2")
    store.catalog.set_alias("b", "a")
    store.soft_delete("b")
    store.purge("b")
    assert store.tree("a").get("k") == b"1" and store.tree("b").get("k") is None


def test_two_changes_of_a_catalog_entry_both_hold(store):
    store.tree("t")
    c, other = store.catalog, Store(store.spark, store.root).catalog

    def change(e):
        if e.max_leaf_keys != 64:
            other.update("t", lambda x: setattr(x, "max_leaf_keys", 64))
        e.max_internal_children = 32

    c.update("t", change)
    assert (c.need("t").max_leaf_keys, c.need("t").max_internal_children) == (64, 32)


def test_typed_values(store, spark):
    from pyspark.sql import types as T

    t = store.tree("t").typed()
    t.set("a", {"n": 1})
    assert t.get("a") == {"n": 1} and t.get("b") is None and t.get_or_set("a", 5) == {"n": 1} and t.get_or_set("b", [1]) is None
    value, version = t.get_with_version("a")
    assert value == {"n": 1} and not t.set_if_version("a", 2, (0, 0)) and t.set_if_version("a", {"n": 2}, version)
    assert t.set_many({"c": "x", "d": None}) == 2 and t.get_many(["a", "c", "zz"]) == {"a": {"n": 2}, "c": "x"}
    assert t.set_many_atomic({"e": 1}, "op") == "committed" and t.set_many_atomic({"e": 1}, "op") == "repeated"
    u = store.tree("u").typed()
    assert u.bulk_load(spark.range(5).select(F.format_string("k%d", "id").alias("key"), F.col("id").alias("n")), "n") == 5
    got = u.entries(T.StructType([T.StructField("n", T.LongType())])).collect()
    assert [(r.key, r.typed.n) for r in got] == [(f"k{i}", i) for i in range(5)]


def test_streamed_load_is_idempotent(store, spark, tmp_path):
    t = store.tree("t")
    rows = spark.range(6).select(F.format_string("k%d", "id").alias("key"), F.lit(b"v").alias("value"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    t.bulk_load_stream(stream, f"{tmp_path}/ck", "load").awaitTermination()
    before = t.log.latest().version
    assert t.count() == 6 and before == 3
    t.bulk_load_stream(stream, f"{tmp_path}/ck2", "load").awaitTermination()  # the same chunks under their numbers
    assert t.log.latest().version == before
    assert t.bulk_append(rows, "more", 0) == 6 and t.bulk_append(rows, "more", 0) == 0


def test_events_and_metrics(spark, tmp_path):
    from tidelog.sources import telemetry

    store = Store(spark, f"file://{tmp_path}/store", publish_events=True)
    t = store.tree("t")
    t.set_many_atomic({"a": b"1", "b": b"2"}, "op")
    t.delete("a"), t.delete("a"), t.delete_range("x", "z"), t.delete_range("a", "z")
    t.compact(grace_ticks=0)
    store.set_publish_events("t", False)
    t.set("quiet", b"1")
    store.set_publish_events("t", None)
    store.soft_delete("t"), store.recover("t")
    got = sorted((r.kind, r.key, r.operation_id) for r in spark.read.parquet(f"{store.root}/events").collect())
    want = [("Set", "a", "op"), ("Set", "b", "op"), ("AtomicWriteCompleted", None, "op"), ("Delete", "a", None), ("Delete", "b", None), ("DeleteRange", "a..z", None), ("CompactionCompleted", None, None), ("TreeDeleted", None, None), ("TreeRecovered", None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    told = {(r.instrument, r.tag): r.n for r in store.metrics.table(spark).collect()}
    assert {k for k, _ in told} == {*telemetry.COUNTERS, *telemetry.HISTOGRAMS} and len(telemetry.COUNTERS) + len(telemetry.HISTOGRAMS) == 18
    assert told["shard.writes", ""] == 5 and told["leaf.tombstones.created", ""] == 2 and told["atomic_write.completed", "committed"] == 1 and told["tree.lifecycle", "deleted"] == 1
    assert t.health()["is_compacted"] is False and t.health()["folders"] == 2


def test_cached_reads_see_new_commits(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", cache=True)
    t = store.tree("t")
    t.set("a", b"1")
    assert t.get("a") == b"1" and t.get("a") == b"1"
    t.set("a", b"2")
    assert t.get("a") == b"2"
    t.compact(grace_ticks=0)
    assert t.get("a") == b"2" and store.metrics.counts["cache.hits", ""] == 1 and store.metrics.counts["cache.misses", ""] == 3


def test_heal_shadow_and_resilient_scan(store):
    t = store.tree("t")
    t.set_many({"shadow/east/a": b"own", "a": b"shared", "b": b"1", "shadow/west/c": b"x"})
    assert t.heal_shadow("east") == 1 and t.heal_shadow("east") == 0
    assert list(t.scan_resilient(page_size=2)) == [("a", b"own"), ("b", b"1"), ("shadow/west/c", b"x")]
    assert [k for k, _ in t.scan_resilient("a", "c", True, 1)] == ["b", "a"]
