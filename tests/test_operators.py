"""Laws and small cases of the pure query layer."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import clock, hashing
from tidelog.operators import aggregate, algebra, capture, facts, mutate, resolve, scan
from tidelog.plans.order import rank, running_max
from tidelog.plans.schema import ENTRIES, hlc, ticks


def entries(spark, rows):
    return spark.createDataFrame([(k, None if v is None else v.encode(), (w, c), v is None, x, o) for k, v, w, c, x, o in rows], ENTRIES)


def told(df):
    return sorted((r.key, r.value and bytes(r.value), tuple(r.hlc), r.is_tombstone, r.expires_at_ticks, r.origin_cluster_id) for r in df.collect())


def noise(seed, n=200):
    r = random.Random(seed)
    return [(f"k{r.randrange(20)}", r.choice(["a", "b", None]), r.randrange(9), r.randrange(3), r.choice([0, 0, 5, 50]), r.choice(["x", "y", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_merge_laws(spark, seed):
    a, b, c = (entries(spark, noise(seed * 3 + i)) for i in range(3))
    ab = told(algebra.merge_trees(a, b))
    assert ab == told(algebra.merge_trees(b, a))  # for equal stamps too
    assert told(algebra.merge_trees(algebra.merge_trees(a, b), c)) == told(algebra.merge_trees(a, algebra.merge_trees(b, c)))
    assert told(algebra.merge_trees(a, a)) == told(resolve.resolve(a))
    shuffled = noise(seed * 3)
    random.Random(1).shuffle(shuffled)
    assert told(resolve.resolve(entries(spark, shuffled))) == told(resolve.resolve(a))


def test_pairs(spark):
    e = entries(spark, [("a", "old", 1, 0, 0, None), ("a", "new", 2, 0, 0, None), ("b", "x", 1, 0, 0, None), ("b", None, 2, 0, 0, None), ("c", None, 1, 0, 0, None), ("c", "back", 2, 0, 0, None)])
    assert [(k, v) for k, v, *_ in told(resolve.resolve(e))] == [("a", b"new"), ("b", None), ("c", b"back")]
    assert [r.key for r in scan.scan_keys(e, 9).collect()] == ["a", "c"]


def test_expiry_is_inclusive_and_hides_nothing_older(spark):
    e = entries(spark, [("a", "v", 1, 0, 0, None), ("a", "w", 2, 0, 10, None), ("b", "v", 1, 0, 11, None)])
    assert [r.key for r in scan.scan_keys(e, 10).collect()] == ["b"]
    assert mutate.delete(e, e.select("key")).where("deleted").count() == 2
    assert [r.key for r in mutate.delete_range(e, "a", "z", 10, hlc(9, 0)).collect()] == ["b"]


def test_range_reaches_the_scan(spark, tmp_path):
    entries(spark, noise(1)).write.parquet(f"{tmp_path}/e")
    plan = scan.scan_entries(spark.read.parquet(f"{tmp_path}/e"), 9, "k1", "k2")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,k1)" in plan and "LessThan(key,k2)" in plan


def test_clock(spark):
    row = spark.range(1).select(hlc(5, 3).alias("a"), hlc(7, 1).alias("b"))
    got = row.select(clock.tick(F.col("a"), F.lit(4)), clock.tick(F.col("a"), F.lit(9)), clock.merge_clocks(F.col("a"), F.col("b"), F.lit(1)), clock.merge_clocks(F.col("a"), F.col("a"), F.lit(1)), clock.merge_clocks(F.col("a"), F.col("b"), F.lit(9))).first()
    assert [tuple(x) for x in got] == [(5, 4), (9, 0), (7, 2), (5, 4), (9, 0)]
    states = spark.range(1).select(clock.merge_split_states(F.lit("split"), F.lit("none"))).first()[0]
    assert states == "split"
    at = spark.sql("SELECT timestamp_ntz'1970-01-01 00:00:01' AS t").select(ticks(F.col("t"))).first()[0]
    assert at == 621355968000000000 + 10_000_000


def test_vectors(spark):
    v = lambda *rows: spark.createDataFrame([(r, (w, 0)) for r, w in rows], "replica string, hlc struct<wall_ticks:bigint,counter:int>")
    a, b, none = v(("x", 3), ("y", 1)), v(("x", 2), ("z", 5)), v()
    assert {r.replica: r.hlc.wall_ticks for r in clock.merge_vectors(a, b).collect()} == {"x": 3, "y": 1, "z": 5}
    assert clock.dominates_or_equals(a, none).first()[0] and not clock.dominates_or_equals(a, b).first()[0] and clock.dominates_or_equals(a, a).first()[0]
    assert clock.is_newer_than(a, b).first()[0] and not clock.is_newer_than(none, a).first()[0] and not clock.is_newer_than(a, a).first()[0]
    assert clock.prune_vector(a, 2).count() == 1


def test_hashes(spark):
    import xxhash

    words = ["", "a", "u00001/click", "höß😀"]
    df = spark.createDataFrame([(w,) for w in words], "k string")

    def fnv(units):
        h = 2166136261
        for u in units:
            h = (h ^ u) * 16777619 & 0xFFFFFFFF
        return h

    got = df.select("k", hashing.log_partition(F.col("k"), 1000).alias("p"), hashing.silo(F.col("k")).alias("s"), hashing.xxh32(F.col("k")).alias("x")).collect()
    for r in got:
        raw = r.k.encode("utf-16-le")
        assert r.p == fnv(raw) % 1000 and r.s == fnv([raw[i] + 256 * raw[i + 1] for i in range(0, len(raw), 2)]) % 2 and r.x == xxhash.xxh32_intdigest(r.k.encode())


def test_orders_in_buckets(spark):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), r.randrange(1000)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, v long")
    got = {x.i: (x.rank, x.m) for x in running_max(rank(df, "i", F.floor(F.col("i") / 7), groups=("g",)), ("g",), "i", "v", "m", width=11).collect()}
    for g in "ab":
        best, n = None, 0
        for i, h, v in rows:
            if h == g:
                n += 1
                assert got[i] == (n, best)
                best = v if best is None else max(best, v)


def test_apply_in_arrival_order(spark):
    feed = entries(spark, [(f"k{i}", "v", w, 0, 0, o) for i, (w, o) in enumerate([(5, "s"), (3, "s"), (6, "s"), (6, "s"), (9, "me"), (4, "t")])])
    feed = feed.withColumn("tree_id", F.lit("t")).withColumn("n", F.substring("key", 2, 9).cast("long"))
    marks = spark.createDataFrame([("t", "t", (4, 0))], "tree_id string, origin_cluster_id string, hwm struct<wall_ticks:bigint,counter:int>")
    assert [r.key for r in capture.apply_feed(feed, marks, "me", "n").where("applied").orderBy("n").collect()] == ["k0", "k2"]


def test_capture_filters(spark):
    m = entries(spark, [("a1", "v", 1, 0, 0, None), ("b1", "v", 1, 0, 0, "far")]).withColumn("tree_id", F.lit("t"))
    n = lambda **k: capture.capture(m, "here", **k).count()
    assert (n(), n(trees=[]), n(trees=["t"]), n(trees=["u"]), n(prefixes=[]), n(prefixes=["b", "c"])) == (2, 0, 2, 0, 2, 1)
    assert {r.origin_cluster_id for r in capture.capture(m, "here").collect()} == {"here", "far"}
    for bad in (("", 1), ("x", 0)):
        with pytest.raises(ValueError):
            capture.validate_options(*bad)


def test_peers(spark):
    log = entries(spark, [("a", "vv", 1, 0, 0, None), ("b", None, 5, 0, 0, None)])
    peers = spark.createDataFrame([("x", (0, 0), None, 20_000_000), ("y", (5, 0), 10_000_000, 20_000_000)], "peer string, cursor struct<wall_ticks:bigint,counter:int>, last_contact_ticks long, now_ticks long")
    got = {r.peer: r for r in capture.peer_lag(log, peers).collect()}
    assert (got["x"].entries_behind, got["x"].bytes_behind) == (2, 2) and got["x"].seconds_since_contact != got["x"].seconds_since_contact
    assert (got["y"].entries_behind, got["y"].seconds_since_contact) == (0, 1.0)


FACTS = "serial string, fact_id string, fact_type string, detail string, wall long, counter int, arrival long"
NC, MRB, INSPECT, REWORK = "NonConformanceRaised", "MrbDisposition", "InspectionRecorded", "ReworkCompleted"


def chain(spark, *steps, serial="p"):
    return spark.createDataFrame([(serial, f"f{i}", t, d, i, 0, -i) for i, (t, d) in enumerate(steps)], FACTS)


@pytest.mark.parametrize(
    ("steps", "state"),
    [
        ([("ProcessStepCompleted", None)], facts.NOMINAL),
        ([(INSPECT, "Fail")], facts.FLAGGED),
        ([(NC, "Minor"), (MRB, "UseAsIs")], facts.NOMINAL),
        ([(NC, "Major"), (MRB, "UseAsIs")], facts.REWORK),
        ([(NC, "Major"), (REWORK, "Passed"), (MRB, "UseAsIs")], facts.NOMINAL),
        ([(NC, "Major"), (INSPECT, "Pass"), (MRB, "UseAsIs")], facts.NOMINAL),
        ([(NC, "Major"), (REWORK, "Passed"), (REWORK, "Failed"), (MRB, "UseAsIs")], facts.REWORK),
        ([(NC, "Critical"), (REWORK, "Passed"), (MRB, "UseAsIs")], facts.SCRAP),
        ([(NC, "Minor"), (MRB, "ReturnToVendor")], facts.SCRAP),
        ([(NC, "Minor"), (MRB, "Rework")], facts.REWORK),
    ],
)
def test_fold(spark, steps, state):
    df = chain(spark, *steps)
    assert facts.compliance_fold(df).first().state == state
    assert facts.compliance_fold(df.union(df).orderBy(F.rand(1))).first().state == state  # order and repeats don't matter


def test_divergence_and_next_action(spark):
    df = chain(spark, (NC, "Minor"), (MRB, "UseAsIs"))
    row = facts.divergence(df).first()
    assert (row.state, row.naive_state) == (facts.NOMINAL, facts.FLAGGED)


def step(stage):
    return ("ProcessStepCompleted", None, stage, None, None)


def inspect(kind, outcome="Pass"):
    return (INSPECT, outcome, None, kind, None)


def raised(number):
    return (NC, "Major", None, None, number)


def judged(number, kind):
    return (MRB, kind, None, None, number)


MACHINED = [step("Forge"), step("HeatTreat"), step("Machining")]


@pytest.mark.parametrize(
    ("steps", "action", "number"),
    [
        ([], None, None),
        ([step("Forge")], "CompleteHeatTreat", None),
        ([inspect("Visual")], "CompleteHeatTreat", None),
        ([step("Forge"), step("HeatTreat")], "CompleteMachining", None),
        (MACHINED, "RecordCmmInspection", None),
        ([*MACHINED, inspect("CMM", "Fail")], "RecordCmmInspection", None),
        ([*MACHINED, inspect("CMM")], "RecordNdtInspection", None),
        ([*MACHINED, inspect("CMM"), inspect("FPI")], "SignOffFai", None),
        ([*MACHINED, inspect("CMM"), inspect("Visual")], "RecordNdtInspection", None),
        ([*MACHINED, inspect("CMM"), inspect("XRay"), ("FinalAcceptance", None, None, None, None)], "Terminal", None),
        ([*MACHINED, inspect("CMM"), raised("NC-1"), raised("NC-2")], "IssueMrb", "NC-1"),
        ([*MACHINED, raised("NC-1"), raised("NC-2"), judged("NC-1", "UseAsIs")], "IssueMrb", "NC-2"),
        ([*MACHINED, raised("NC-1"), judged("NC-1", "Rework")], "CompleteRework", None),
        ([*MACHINED, raised("NC-1"), judged("NC-1", "Rework"), (REWORK, "Passed", None, None, None)], "SignOffFai", None),
        ([*MACHINED, raised("NC-1"), judged("NC-1", "Rework"), (REWORK, "Failed", None, None, None)], "RecordNdtInspection", None),
        ([*MACHINED, inspect("CMM"), raised("NC-1"), judged("NC-1", "UseAsIs")], "RecordNdtInspection", None),
        ([*MACHINED, raised("NC-1"), judged("NC-1", "Scrap")], "Terminal", None),
        ([*MACHINED, raised("NC-1"), judged("NC-1", "ReturnToVendor")], "Terminal", None),
        ([(NC, "Critical", None, None, "NC-9")], "IssueMrb", "NC-9"),
    ],
)
def test_next_action(spark, steps, action, number):
    rows = [("p", f"f{i}", *s, i, 0) for i, s in enumerate(steps)]
    random.Random(3).shuffle(rows)
    got = facts.next_action(spark.createDataFrame(rows, "serial string, fact_id string, fact_type string, detail string, stage string, inspection string, nc_number string, wall long, counter int")).collect()
    assert [(r.next_action, r.open_nc) for r in got] == ([(action, number)] if steps else [])


def test_parts_and_registers_are_live(spark):
    e = entries(spark, [("p/1", "v", 1, 0, 0, None), ("q/1", "v", 1, 0, 0, None), ("q/1", None, 2, 0, 0, None), ("r/1", "v", 1, 0, 5, None)])
    assert [r.serial for r in facts.parts(e, 9).collect()] == ["p"]
    assert facts.facts_of(e, "q", 9).count() == 0 and [r.key for r in facts.facts_of(e, "p", 9).collect()] == ["p/1"]
    own = entries(spark, [("p/1", "mine", 1, 0, 0, None), ("q/1", "gone", 1, 0, 5, None)])
    assert {r.key: bytes(r.value) for r in facts.register_value(e, own, 9).collect()} == {"p/1": b"mine"}


def test_null_origins_stay_in_a_feed(spark):
    feed = entries(spark, [("k0", "v", 5, 0, 0, None), ("k1", "v", 3, 0, 0, None), ("k2", "v", 6, 0, 0, "s")]).withColumn("tree_id", F.lit("t")).withColumn("n", F.substring("key", 2, 9).cast("long"))
    marks = spark.createDataFrame([("t", None, (4, 0))], "tree_id string, origin_cluster_id string, hwm struct<wall_ticks:bigint,counter:int>")
    assert {r.key: r.applied for r in capture.apply_feed(feed, marks, "me", "n").collect()} == {"k0": True, "k1": False, "k2": True}


def test_start_after(spark):
    row = spark.range(1).select(facts.start_after(hlc(5, 2), "east").alias("a"), facts.start_after(hlc(5, 2**31 - 1), "east").alias("b")).first()
    assert row.a == f"{5:020d}{3:010d}|east|" and row.b == f"{6:020d}{0:010d}|east|"


def test_fact_codec_and_keys(spark):
    e = spark.createDataFrame([("p/1", b'{"$type":"inspection","serial":"p","outcome":"pass","measurements":{"a":"1"}}')], "key string, value binary")
    row = facts.decode_facts(e).first()
    assert (row.fact_type, row.outcome, row.measurements, row.severity) == ("inspection", "pass", {"a": "1"}, None)
    k = spark.range(1).select(facts.replog_key(F.lit(5), F.lit(2), F.lit("east"), F.lit(True), F.lit("a|b")).alias("k"))
    assert tuple(k.select(facts.parse_replog_key(F.col("k")).alias("p")).first().p) == (5, 2, "east", True, "a|b")
    assert facts.next_serial(4, "fam", 2024) == "fam-2024-00005"
    chaos = spark.createDataFrame([("a", True, 0, 0), ("b", False, 5, 4), ("c", False, 0, 0)], "name string, paused boolean, delay_ms int, reorder_window int")
    assert tuple(facts.chaos_overview(chaos).first()) == (1, 1, 1, "a,b")


def test_split_and_reshard(spark):
    m = spark.range(8).select(F.col("id").cast("int").alias("slot"), (F.col("id") % 2).cast("int").alias("shard"))
    assert {r.slot for r in aggregate.split_owner(m, 0, 2).where("shard = 2").collect()} == {4, 6}
    assert aggregate.reshard(m, 4).select("shard").distinct().count() == 4
    with pytest.raises(ValueError):
        aggregate.reshard(m, 9)


def test_undo_restores(spark):
    e = entries(spark, [("a", "old", 1, 0, 99, None), ("b", "x", 1, 0, 5, None)])
    batch = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    images = mutate.pre_image(e, batch, 10)
    assert {r.key: r.action for r in images.collect()} == {"a": "restore", "b": "expire", "c": "delete"}
    written = mutate.entries_of(batch.withColumn("value", F.lit(b"new")), hlc(20, 0))
    back = resolve.live(e.unionByName(written).unionByName(mutate.compensate(images, hlc(30, 0))), 10)
    assert [(r.key, bytes(r.value), r.expires_at_ticks) for r in back.collect()] == [("a", b"old", 99)]
