"""Streams over appended mutation files."""

from conftest import DATA
from pyspark.sql import functions as F

from tidelog.operators import facts, resolve
from tidelog.plans import registry
from tidelog.plans.schema import MUTATIONS
from tidelog.streaming import events


def test_stream_of_mutations_gives_the_batch_state(spark, tmp_path):
    log = registry.log(spark, DATA).select(*MUTATIONS.names)
    for i in range(3):
        log.where(F.pmod(F.xxhash64("key", "hlc"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    got, seen = [], set()

    def callback(batch, n):
        if n not in seen:  # a repeated delivery
            seen.add(n)
            got.extend(batch.collect())

    events.subscribe(events.mutation_stream(spark, f"{tmp_path}/log", 1), callback, f"{tmp_path}/ck").awaitTermination()
    assert len(seen) == 3
    streamed = resolve.resolve(spark.createDataFrame(got, MUTATIONS))
    assert {(r.key, r.hlc) for r in streamed.collect()} == {(r.key, r.hlc) for r in resolve.resolve(log).collect()}


def test_live_divergence_equals_the_batch_query(spark, tmp_path):
    rows = [(f"s{i % 5}", i, i * 7 % 3, i * 5 % 2) for i in range(60)]
    schema = "serial string, at long, a long, b long"
    for i in range(3):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import time

        time.sleep(1.1)  # files are taken by the time they were written
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events.live_divergence(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(tuple(r) for r in facts.transitions(spark.createDataFrame(rows, schema)).collect())


def test_event_rules(spark):
    assert events.range_event("t", "a", "c", 0) is None and events.range_event("t", "a", "c", 2) == ("t", "DeleteRange", "a..c")
    row = spark.sql("SELECT CAST(NULL AS BOOLEAN) AS n, false AS f").select(events.is_published(F.col("n"), True), events.is_published(F.col("f"), True)).first()
    assert tuple(row) == (True, False)
