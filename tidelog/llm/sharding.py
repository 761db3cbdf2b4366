"""Minimax contiguous sharding over atomic groups of equal texts.

Groups are ordered by a hash of their text. The smallest capacity with which a greedy
pass needs no more shards than asked is found by binary search; the driver holds sums
of a fixed number of hash ranges and only those groups that lie in a range where a cut
can fall.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.common import as_bytes, cut

#: Hash ranges whose sums the driver holds.
RANGES = 1 << 16
KEY_BITS = 63


def _digests(batches):
    for b in batches:
        text, null = b.column("text"), np.asarray(b.column("text").is_null())
        raw = as_bytes(text)
        # a null text is a group of its own, apart from the empty text
        keys = [int.from_bytes(hashlib.sha256(t if not z else b"\xff").digest()[:8], "big") >> (64 - KEY_BITS) for t, z in zip(raw, null, strict=True)]
        cols = [b.column("doc_id"), pa.array([len(t) + 1 for t in raw], pa.int64()), pa.array([zlib.crc32(t) for t in raw], pa.int64()), pa.array(keys, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "size", "text_crc32", "gk"])


def greedy_cuts(sizes: list[int], capacity: int) -> list[int]:
    """Indices at which new shards begin when each takes as many groups in order as fit."""
    total, cuts, start = [0, *accumulate(sizes)], [], 0
    while True:
        start = bisect_right(total, total[start] + capacity) - 1
        if start >= len(sizes):
            return cuts
        if cuts and cuts[-1] == start or start == 0:
            raise ValueError("a group exceeds the capacity")
        cuts.append(start)


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """(smallest capacity, cuts) for sizes that fit in memory."""
    if not sizes:
        return 0, []
    lo, hi = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        if len(greedy_cuts(sizes, mid)) < shards:
            hi = mid
        else:
            lo = mid + 1
    return lo, greedy_cuts(sizes, lo)


def _open_ranges(sums: np.ndarray, most: np.ndarray, shards: int) -> np.ndarray:
    """Which ranges can hold a cut, for any capacity that the sums alone don't rule out.

    A capacity is certainly enough when whole ranges fit greedily, and certainly too small when
    even ranges that may be cut anywhere, except through their largest group, need too many shards.
    """
    prefix = np.concatenate([[0], np.cumsum(sums)])

    def coarse(cap: int) -> list[int] | None:
        at, out = 0, []
        while True:
            to = int(np.searchsorted(prefix, prefix[at] + cap, "right")) - 1
            if to >= len(sums):
                return out
            if to <= at:
                return None
            out.append(at := to)

    def fine(cap: int) -> list[int] | None:
        """Furthest ranges in which the cuts can lie."""
        at, out = 0, []  # at: bytes that the shards so far take at most
        if cap < most.max():
            return None
        while at + cap < prefix[-1]:
            reach = at + cap
            stop, first = int(np.searchsorted(prefix, reach, "right")) - 1, int(np.searchsorted(prefix, at, "right")) - 1
            if first < stop < len(sums) and prefix[stop] + most[stop] > reach:  # its largest group doesn't fit any more
                reach = min(reach, prefix[stop + 1] - most[stop])
            at = max(reach, at + 1)
            out.append(min(stop, len(sums) - 1))
        return out

    def least(ok, lo: int, hi: int) -> int:
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
        return lo

    fits = lambda f: lambda c: (x := f(c)) is not None and len(x) < shards
    total = int(prefix[-1])
    high = least(fits(coarse), 1, total)
    low = least(fits(fine), 1, high)
    is_open = np.zeros(len(sums), bool)
    near, at = [], 0
    for _ in range(shards - 1):  # the nearest ranges, for the smallest capacity
        at = min(max(at, int(np.searchsorted(prefix, prefix[at] + low, "right")) - 1), len(sums) - 1)
        near.append(at)
    far = (fine(high) or []) + [len(sums) - 1] * shards
    for a, b in zip(near, far, strict=False):
        is_open[a : b + 1] = True
    return is_open


def find_cuts(groups: DataFrame, shards: int, ranges: int = RANGES) -> list[int]:
    """Keys at which shards 1, 2, ... begin, over ``groups(gk, size)``."""
    shift = KEY_BITS - (ranges.bit_length() - 1)
    ranged = groups.withColumn("range", F.shiftright("gk", shift))
    got = ranged.groupBy("range").agg(F.sum("size").alias("sum"), F.max("size").alias("most")).toPandas()
    if got.empty:
        return []
    sums, most = np.zeros(ranges, np.int64), np.zeros(ranges, np.int64)
    sums[got["range"]], most[got["range"]] = got["sum"], got["most"]
    is_open = _open_ranges(sums, most, shards) & (sums > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], is_open, [0]]).astype(np.int8))).reshape(-1, 2)
    where = F.lit(False)
    for a, b in edges.tolist():
        where = where | F.col("range").between(a, b - 1)
    inner = ranged.where(where).select("gk", "size").toPandas().sort_values("gk")
    # between open ranges no cut can fall: such a stretch is one block
    closed = np.flatnonzero(~is_open & (sums > 0))
    runs = np.split(closed, np.flatnonzero(np.diff(np.cumsum(is_open)[closed]) > 0) + 1) if len(closed) else []
    blocks = [(int(r[0]) << shift, int(sums[r].sum())) for r in runs] + list(zip(inner["gk"].tolist(), inner["size"].tolist(), strict=True))
    blocks.sort()
    _, cuts = minimax_cuts([s for _, s in blocks], shards)
    return [blocks[c][0] for c in cuts]


def shard(docs: DataFrame, shards: int = 8, ranges: int = RANGES) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text (null: none) plus 1. Equal texts stay together, nulls
    as one group; the largest shard is as small as a contiguous cut of the ordered groups
    allows. Slots run gapless from 0 in each shard. Repeated rows each get a slot; an empty
    table gives an empty result; with fewer groups than shards the last shards stay empty.
    """
    spark = docs.sparkSession
    digests = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests, "doc_id long, size long, text_crc32 long, gk long").withColumn("rid", F.monotonically_increasing_id())
    )
    cuts = find_cuts(digests.groupBy("gk").agg(F.sum("size").alias("size")), shards, ranges)
    number = sum((F.when(F.col("gk") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = digests.withColumn("shard", number).withColumn("part", F.shiftright("rid", 33))
    # rows before a part within its shard
    counts = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("part", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    within = F.row_number().over(Window.partitionBy("part", "shard").orderBy("rid")) - 1
    return placed.withColumn("within", within).join(starts, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
