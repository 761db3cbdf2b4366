"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents lie one after another on a line of words in a seeded order. The line
is cut into blocks of equal words, blocks are granted to sources by highest quotients, per
shard, and a seeded permutation of a source's blocks says which ones its quota takes.
"""

from __future__ import annotations

import heapq
import math
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import as_bytes, cut

#: Weights of the sources in code point order, repeating; and how often a source may be used at most.
WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3
#: Documents that one window task orders.
TOGETHER = 50_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> list[float]:
    """Words for each source: by weight of the total, at most ``most`` times its size, the excess reshared by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, full, out = float(sum(sizes)), set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(most * sizes[i] for i in full)
        share = sum(w[i] for i in free)
        for i in range(len(sizes)):
            out[i] = float(most * sizes[i]) if i in full else rest * w[i] / share
        over = {i for i in free if out[i] > most * sizes[i]}
        if not over:
            return out
        full |= over


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1); of equal quotients the first source's goes first."""
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [max(0, math.floor(seats * v / total - 0.5 * len(votes) - 1)) for v in votes]  # a safe start, then quotient by quotient
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def shard_quotas(votes: list[float], seats: int, shards: int) -> list[list[int]]:
    """For each shard the blocks of each source; a source's grants only grow with the seats, so differences are quotas."""
    so_far = [sainte_lague(votes, seats * k // shards) for k in range(shards + 1)]
    return [[b - a for a, b in zip(x, y, strict=True)] for x, y in zip(so_far, so_far[1:], strict=False)]


def _sizes(batches):
    for b in batches:
        rest = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array([len(t.split()) for t in as_bytes(b.column("text"))], pa.int64())], [*rest, "size"])


def _permutation(source: str | None, blocks: int, seed: int) -> tuple[int, int]:
    """(a, c) of the permutation j -> (a j + c) mod blocks."""
    h = xxhash.xxh64_intdigest(repr(source), seed)
    a = h % (1 << 20) % blocks or 1
    while math.gcd(a, blocks) != 1:
        a += 1
    return a, (h >> 24) % blocks


def exact_quota(words: int, target: int, block: int, last_rank: int) -> tuple[int, int]:
    """(whole blocks in order of rank, words of the next) that give a source's target; after its last rank a source begins again.

    All blocks have ``block`` words but for the last on the line, which is shorter and has ``last_rank``.
    """
    if words <= 0:
        return 0, 0
    blocks = -(-words // block)
    short = blocks * block - words
    epochs, rest = divmod(target, words)
    of = lambda k: k * block - (short if k > last_rank else 0)  # noqa: E731  words of the first k ranks
    k = min(blocks, (rest + short) // block)
    while of(k) > rest:
        k -= 1
    return epochs * blocks + k, rest - of(k)


def mix_sources(docs: DataFrame, block_words: int | None = None, shards: int = 8, seed: int = 17, together: int = TOGETHER, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, source, ...)``: doc_id, size, source_size, target, taken, source, shard_words.

    Size is the number of words (null text: 0). Sources go by code point, null last, and weigh
    5, 2, 1 in turn. ``taken`` counts the words that the mix takes of a document, repeats
    included, at most three times its size; over a source they add up to its target, rounded: the
    last block is taken in part. ``shard_words`` says how many of them each shard's quota takes
    (comma-joined). A source of no words has target 0. The result
    depends on the rows and the seed alone, not on their order or partitions. ``block_words``
    left out: a twenty-thousandth of all words, 1 to 1,024. Columns named in ``carry`` are kept, other
    extra columns ignored; an empty table gives an empty result. The driver holds a row for each source.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", *carry)
    sized = kept.mapInArrow(_sizes, kept.withColumn("size", F.lit(0).cast("long")).drop("text").schema)
    buckets = max(64, docs.count() // together)
    sized = cut(sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")))
    sums = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    by_source = [(r.source, r.words) for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()]  # one row for each source
    by_source.sort(key=lambda x: (x[0] is None, (x[0] or "").encode()))
    sizes = [n for _, n in by_source]
    goal, total = targets(sizes), sum(sizes)
    block = block_words or max(1, min(1024, total // 20000))
    quotas = list(zip(*shard_quotas(goal, round(sum(goal) / block), shards), strict=True)) if total else [(0,) * shards] * len(sizes)
    rows = []
    for (name, n), t, own in zip(by_source, goal, quotas, strict=True):
        blocks = max(1, -(-n // block))
        a, c = _permutation(name, blocks, seed)
        whole, part = exact_quota(n, min(round(t), MOST_EPOCHS * n), block, (a * (blocks - 1) + c) % blocks)
        ends = [min(x, whole) for x in accumulate(own)]
        rows.append((name, n, t, blocks, a, c, [0, *ends[:-1], whole], part))
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, blocks long, a long, c long, ends array<long>, part long")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("start", F.coalesce(before, F.lit(0))).withColumnsRenamed({"source": "s", "bucket": "b"}).drop("words")
    run = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    lined = sized.withColumn("run", run).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("at", F.col("start") + F.col("run")).drop("s", "b")
    lined = lined.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    end, wide, first, last = F.col("at") + F.col("size"), F.lit(block).cast("long"), F.expr(f"`at` div {block}"), F.expr(f"(`at` + size - 1) div {block}")
    over = lambda low, high: F.greatest(F.lit(0).cast("long"), F.least(end, high) - F.greatest("at", low))
    piece = lambda j: F.struct(((F.col("a") * j + F.col("c")) % F.col("blocks")).alias("rank"), over(j * wide, (j + 1) * wide).alias("words"), over(j * wide, j * wide + F.col("part")).alias("part"))
    lined = lined.withColumn("pieces", F.when(F.col("size") > 0, F.transform(F.sequence(first, last), piece)).otherwise(F.array().cast("array<struct<rank:bigint,words:bigint,part:bigint>>")))
    # a rank comes again in each epoch: so often before an end
    times = lambda rank, at: F.greatest(F.lit(0).cast("long"), F.floor((at - rank + F.col("blocks") - 1) / F.col("blocks")).cast("long"))
    whole = lambda low, high: F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["words"] * (times(x["rank"], high) - times(x["rank"], low)))
    by_shard = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: whole(F.get("ends", k), F.get("ends", k + 1)))
    rest = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + F.when(x["rank"] == F.get("ends", F.lit(shards)) % F.col("blocks"), x["part"]).otherwise(F.lit(0).cast("long")))
    lined = lined.withColumn("by_shard", F.transform(by_shard, lambda n, k: F.when(k == shards - 1, n + rest).otherwise(n)))
    taken = F.aggregate("by_shard", F.lit(0).cast("long"), lambda s, n: s + n)
    return lined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", F.array_join(F.transform("by_shard", lambda n: n.cast("string")), ",").alias("shard_words"), *carry)
