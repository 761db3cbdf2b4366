"""Event-sourced facts: ordered folds, their divergence, indexes and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidelog.operators.resolve import live

# States of a part in order of severity, the stages in order, non-destructive inspections, and the fact types.
STATES = ("Nominal", "UnderInspection", "Flagged", "Rework", "Scrap")
NOMINAL, UNDER_INSPECTION, FLAGGED, REWORK, SCRAP = range(5)
STAGES = ("Forge", "HeatTreat", "Machining", "NDT", "MRB", "FAI")
NDT_INSPECTIONS = ("FPI", "EddyCurrent", "XRay")
FACT_TYPES = ("ProcessStepCompleted", "InspectionRecorded", "NonConformanceRaised", "MrbDisposition", "ReworkCompleted", "FinalAcceptance")

FACT_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("serial", "factId", "$type", "site", "operator", "description", "stage", "heatLot", "inspection", "outcome", "ncNumber", "defectCode", "severity", "disposition", "reworkOperation", "faiReportId", "inspectorId")] + [T.StructField("retestPassed", T.BooleanType()), T.StructField("certificateIssued", T.BooleanType()), T.StructField("calibrationTs", T.TimestampType()), T.StructField("processParameters", T.MapType(T.StringType(), T.StringType())), T.StructField("measurements", T.MapType(T.StringType(), T.StringType()))])


def decode_facts(rows: DataFrame, value: str = "value") -> DataFrame:
    """Facts of all types from JSON, as one wide row; columns of other types stay null."""
    fact = F.from_json(F.col(value).cast("string"), FACT_SCHEMA)
    return rows.withColumn("fact", fact).select(*[c for c in rows.columns if c != value], "fact.*").withColumnRenamed("$type", "fact_type")


def fact_key(serial: Column, wall: Column, counter: Column, fact_id: Column) -> Column:
    """A key under which a part's facts lie together in order of their stamps."""
    return F.concat_ws("/", serial, F.lpad(wall.cast("string"), 20, "0"), F.lpad(counter.cast("string"), 10, "0"), fact_id)


def facts_of(entries: DataFrame, serial: str, now_ticks: int) -> DataFrame:
    """Live entries of one part, in order of key: a range of keys, since ``0`` follows ``/``."""
    return live(entries.where((F.col("key") >= serial + "/") & (F.col("key") < serial + "0")), now_ticks).orderBy("key")


def parts(entries: DataFrame, now_ticks: int) -> DataFrame:
    """(serial): the different prefixes before the first slash of live keys."""
    return live(entries, now_ticks).where(F.instr("key", "/") > 1).select(F.substring_index("key", "/", 1).alias("serial")).distinct()


def _step(state: Column, f: Column) -> Column:
    """The state machine: (st, arm) after one fact; Scrap is final, and ``arm`` says that a rework passed."""
    st, arm = state["st"], state["arm"]
    to = lambda s, a: F.struct(s.cast("int").alias("st"), a.alias("arm"))
    worse = lambda s: to(F.greatest(st, F.lit(s)), F.lit(False))
    passed = to(st, arm | (st == REWORK))
    kind, what = f["fact_type"], f["detail"]
    return (
        F.when(st == SCRAP, state)
        .when(kind == "InspectionRecorded", F.when(what == "Pass", passed).otherwise(worse(FLAGGED)))
        .when(kind == "NonConformanceRaised", F.when(what == "Critical", worse(SCRAP)).when(what == "Major", worse(REWORK)).otherwise(worse(FLAGGED)))
        .when((kind == "MrbDisposition") & (what == "UseAsIs"), F.when(st == FLAGGED, to(F.lit(NOMINAL), arm)).when((st == REWORK) & arm, to(F.lit(NOMINAL), F.lit(False))).otherwise(state))
        .when(kind == "MrbDisposition", F.when(what == "Rework", worse(REWORK)).otherwise(worse(SCRAP)))
        .when(kind == "ReworkCompleted", F.when(what == "Passed", passed).otherwise(worse(FLAGGED)))
        .otherwise(state)
    )


def fold(facts: DataFrame, order: list[str]) -> DataFrame:
    """(serial, state) of ``facts(serial, fact_type, detail, …)`` reduced in the order of the given columns; a part has few facts."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "fact_type", "detail")))
    start = F.struct(F.lit(0).alias("st"), F.lit(False).alias("arm"))
    return facts.groupBy("serial").agg(listed.alias("fs")).select("serial", F.aggregate("fs", start, _step)["st"].alias("state"))


def compliance_fold(facts: DataFrame) -> DataFrame:
    """The state by clock order, whatever the order of arrival; a fact that came twice counts once."""
    return fold(facts.dropDuplicates(["serial", "fact_id"]), ["wall", "counter", "fact_id"])


def naive_fold(facts: DataFrame) -> DataFrame:
    """The state by order of arrival."""
    return fold(facts, ["arrival", "fact_id"])


def divergence(facts: DataFrame) -> DataFrame:
    """(serial, state, naive_state) where the two folds differ."""
    return compliance_fold(facts).join(naive_fold(facts).withColumnRenamed("state", "naive_state"), "serial").where("state <> naive_state")


def part_summary(facts: DataFrame) -> DataFrame:
    """(serial, family, latest_stage, state, naive_state, n_facts, diverges); the family is the serial without its last two segments."""
    newest = facts.groupBy("serial").agg(F.max_by("fact_type", F.struct("wall", "counter", "fact_id")).alias("latest_stage"), F.count(F.lit(1)).alias("n_facts"))
    both = newest.join(compliance_fold(facts), "serial").join(naive_fold(facts).withColumnRenamed("state", "naive_state"), "serial")
    return both.withColumn("family", F.regexp_extract("serial", r"^(.*?)(?:-[^-]*){0,2}$", 1)).withColumn("diverges", F.col("state") != F.col("naive_state"))


def latest_per_group(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """The newest row of each group."""
    first = F.row_number().over(Window.partitionBy(*groups).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def describe_activity(fact_type: Column, detail: Column) -> Column:
    """A line of text for each type of fact."""
    say = lambda text: F.concat(F.lit(text), F.lit(": "), F.coalesce(detail, F.lit("-")))
    out = F.when(fact_type == "ProcessStepCompleted", say("step"))
    for kind, text in zip(FACT_TYPES[1:], ("inspection", "non-conformance", "disposition", "rework", "acceptance"), strict=True):
        out = out.when(fact_type == kind, say(text))
    return out.otherwise(say("other"))


def next_action(facts: DataFrame) -> DataFrame:
    """(serial, next_action, open_nc) of ``facts(serial, fact_id, fact_type, detail, stage, inspection, nc_number, wall, counter)``: the first rule that holds.

    An accepted part, and one that was scrapped or returned, needs nothing. Then come: a
    non-conformance whose number no disposition names (the first, with its number); rework ordered
    after the last one done; after rework, sign-off or another test by the retest; then the furthest
    stage, and the inspections that machining asks for. Order is that of the stamps.
    """
    at = F.struct("wall", "counter", "fact_id")
    kind, what, number = F.col("fact_type"), F.col("detail"), F.coalesce("nc_number", F.lit(""))
    mrb, done = kind == "MrbDisposition", kind == "ReworkCompleted"
    passed = (kind == "InspectionRecorded") & (what == "Pass")
    stage = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")) - 1
    per = facts.groupBy("serial").agg(
        F.bool_or((kind == "FinalAcceptance") | mrb & what.isin("Scrap", "ReturnToVendor")).alias("terminal"),
        F.array_sort(F.collect_list(F.when(kind == "NonConformanceRaised", F.struct(at.alias("at"), number.alias("number"))))).alias("raised"),
        F.collect_set(F.when(mrb, number)).alias("judged"),
        F.max(F.when(mrb & (what == "Rework"), at)).alias("ordered"),
        F.max(F.when(done, at)).alias("done"),
        F.max_by(what, F.when(done, at)).alias("retest"),
        F.max(F.when(kind == "ProcessStepCompleted", stage)).alias("stage"),
        F.bool_or(passed & (F.col("inspection") == "CMM")).alias("measured"),
        F.bool_or(passed & F.col("inspection").isin(*NDT_INSPECTIONS)).alias("tested"),
    )
    is_open = F.filter("raised", lambda x: ~F.array_contains(F.col("judged"), x["number"]))
    per = per.withColumn("nc", F.get(is_open, 0))
    holds = lambda c: F.coalesce(c, F.lit(False))
    action = (
        F.when(holds(F.col("terminal")), "Terminal")
        .when(F.col("nc").isNotNull(), "IssueMrb")
        .when(F.col("ordered").isNotNull() & (F.col("done").isNull() | (F.col("done") < F.col("ordered"))), "CompleteRework")
        .when(F.col("done").isNotNull(), F.when(F.col("retest") == "Passed", "SignOffFai").otherwise("RecordNdtInspection"))
        .when(F.coalesce("stage", F.lit(0)) == STAGES.index("Forge"), "CompleteHeatTreat")
        .when(F.col("stage") == STAGES.index("HeatTreat"), "CompleteMachining")
        .when(~holds(F.col("measured")), "RecordCmmInspection")
        .when(~holds(F.col("tested")), "RecordNdtInspection")
        .otherwise("SignOffFai")
    )
    return per.select("serial", action.alias("next_action"), F.when(action == "IssueMrb", F.nullif(F.col("nc.number"), F.lit(""))).alias("open_nc"))


def register_value(shared: DataFrame, shadow: DataFrame, now_ticks: int) -> DataFrame:
    """(key, value) of two trees' entries: a site's own live value where it has one, else the shared live one."""
    both = live(shared, now_ticks).select("key", F.col("value").alias("shared")).join(live(shadow, now_ticks).select("key", F.col("value").alias("own"), F.lit(True).alias("_own")), "key", "full")
    return both.select("key", F.when(F.col("_own"), F.col("own")).otherwise(F.col("shared")).alias("value"))


def label_union(shared: DataFrame, shadow: DataFrame) -> DataFrame:
    """(serial, label) of both sets, each once."""
    return shared.select("serial", "label").union(shadow.select("serial", "label")).distinct()


def heal_shadow(entries: DataFrame, silo: str, now_ticks: int) -> DataFrame:
    """(key, shared_key, value): live shadow values with the shared key each moves to."""
    prefix = f"shadow/{silo}/"
    own = live(entries.where(F.col("key").startswith(prefix)), now_ticks)
    return own.select("key", F.expr(f"substring(key, {len(prefix) + 1})").alias("shared_key"), "value")


def replog_key(wall: Column, counter: Column, cluster: Column, is_delete: Column, key: Column) -> Column:
    """A log key whose order is that of the stamps."""
    return F.concat(F.lpad(wall.cast("string"), 20, "0"), F.lpad(counter.cast("string"), 10, "0"), F.lit("|"), cluster, F.lit("|"), F.when(is_delete, "D").otherwise("S"), F.lit("|"), key)


def parse_replog_key(key: Column) -> Column:
    """(wall, counter, cluster, is_delete, key) of a log key."""
    part = lambda n: F.regexp_extract(key, r"^(\d{20})(\d{10})\|([^|]*)\|([SD])\|(.*)$", n)
    return F.struct(part(1).cast("long").alias("wall"), part(2).cast("int").alias("counter"), part(3).alias("cluster"), (part(4) == "D").alias("is_delete"), part(5).alias("key"))


def start_after(cursor: Column, cluster: str) -> Column:
    """The least log key of a cluster beyond a stamp: the counter goes up by one, or the wall clock where it is full."""
    full = cursor["counter"] == F.lit(2**31 - 1)
    wall, counter = F.when(full, cursor["wall_ticks"] + 1).otherwise(cursor["wall_ticks"]), F.when(full, F.lit(0)).otherwise(cursor["counter"] + 1)
    return F.concat(F.lpad(wall.cast("string"), 20, "0"), F.lpad(counter.cast("string"), 10, "0"), F.lit(f"|{cluster}|"))


def ship_batch(log: DataFrame, current: DataFrame, cursor: Column, size: int) -> DataFrame:
    """(key, op, value, hlc): the next entries after the cursor, the latest of each key, with current values; a key that is gone ships as a delete."""
    page = log.where(F.col("hlc") > cursor).orderBy("hlc").limit(size)
    latest = latest_per_group(page, ["key"], ["hlc"]).select("key", "hlc")
    both = latest.join(current.select("key", "value", F.lit(True).alias("_there")), "key", "left")
    return both.select("key", F.when(F.col("_there"), "Set").otherwise("Delete").alias("op"), "value", "hlc")


def transitions(pairs: DataFrame) -> DataFrame:
    """(serial, at, kind): where two states begin to differ, change while they differ, or agree again.

    ``pairs(serial, at, a, b)`` is the history of both states, in order of ``at``.
    """
    order = Window.partitionBy("serial").orderBy("at")
    was_a, was_b = F.lag("a").over(order), F.lag("b").over(order)
    differed, differs = F.coalesce(was_a != was_b, F.lit(False)), F.col("a") != F.col("b")
    changed = (F.col("a") != was_a) | (F.col("b") != was_b)
    kind = F.when(differs & ~differed, "entered").when(differs & differed & changed, "changed").when(~differs & differed, "resolved")
    return pairs.withColumn("kind", kind).where("kind IS NOT NULL").select("serial", "at", "kind")


def next_serial(count: int, family: str, year: int) -> str:
    """The serial of the part after ``count`` parts."""
    return f"{family}-{year:04d}-{count + 1:05d}"


def chaos_overview(backends: DataFrame) -> DataFrame:
    """One row (paused, delayed, reordering, disturbed) of ``backends(name, paused, delay_ms, reorder_window)``."""
    odd = F.col("paused") | (F.col("delay_ms") > 0) | (F.col("reorder_window") > 0)
    return backends.agg(F.count_if("paused").alias("paused"), F.count_if(F.col("delay_ms") > 0).alias("delayed"), F.count_if(F.col("reorder_window") > 0).alias("reordering"), F.array_join(F.array_sort(F.collect_list(F.when(odd, F.col("name")))), ",").alias("disturbed"))
