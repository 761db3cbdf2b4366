"""Change capture: filtered logs, sequences, feeds, idempotent apply and lag of peers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import log_partition
from tidelog.operators.resolve import live, resolve, tombstones
from tidelog.operators.scan import in_range
from tidelog.plans.order import null_safe_join, rank, running_max
from tidelog.plans.schema import hlc, zero


def validate_options(cluster: str, partitions: int) -> None:
    """A cluster needs a name, and a log a partition."""
    if not cluster or not cluster.strip():
        raise ValueError("the cluster id is blank")
    if partitions < 1:
        raise ValueError("at least one partition")


def capture(mutations: DataFrame, cluster: str, trees: list[str] | None = None, prefixes: list[str] | None = None, accepts: Column | None = None) -> DataFrame:
    """Mutations that replicate, stamped with their origin.

    ``trees``: None takes all, an empty list none. ``prefixes``: None or empty takes all keys, else
    any prefix will do; a range delete is judged by its first key.
    """
    validate_options(cluster, 1)
    keep = F.lit(True) if trees is None else F.col("tree_id").isin(trees) if trees else F.lit(False)
    if prefixes:
        keep = keep & reduce(lambda a, b: a | b, [F.col("key").startswith(p) for p in prefixes])
    return mutations.where(keep if accepts is None else keep & accepts).withColumn("origin_cluster_id", F.coalesce("origin_cluster_id", F.lit(cluster)))


def sequence(log: DataFrame, partitions: int, order: str) -> DataFrame:
    """Adds ``partition`` and a dense ``sequence`` from 0 in it, by ``order`` (a whole number)."""
    placed = log.withColumn("partition", log_partition(F.col("key"), partitions))
    ranked = rank(placed, order, F.floor(F.col(order) / (1 << 16)), "sequence", groups=("partition",))
    return ranked.withColumn("sequence", F.col("sequence") - 1)


def read_log(log: DataFrame, partition: int, start: int, size: int) -> DataFrame:
    """A page of one partition from a sequence number on."""
    if start < 0 or size < 1:
        raise ValueError("a page starts at 0 or later and has a row at least")
    return log.where((F.col("partition") == partition) & (F.col("sequence") >= start)).orderBy("sequence").limit(size)


def change_feed(log: DataFrame, cursor: Column, exclude: str | None = None) -> DataFrame:
    """Entries of all partitions after a stamp, oldest first, but for those of one origin."""
    rows = log.where(F.col("hlc") > cursor)
    if exclude is not None:
        rows = rows.where(~F.col("origin_cluster_id").eqNullSafe(F.lit(exclude)))
    return rows.orderBy("hlc")


def apply_feed(feed: DataFrame, marks: DataFrame, local: str, arrival: str, *ties: str) -> DataFrame:
    """Adds ``applied`` to each entry of ``feed``, in order of ``arrival`` (a whole number), then of ``ties``.

    An entry applies if its stamp is beyond all that came before from its tree and origin and beyond
    the mark in ``marks(tree_id, origin_cluster_id, hwm)``; entries of the local origin never do. A null origin
    is an origin like any other.
    """
    foreign = feed.where(~F.col("origin_cluster_id").eqNullSafe(F.lit(local)))
    ran = running_max(foreign, ("tree_id", "origin_cluster_id"), arrival, "hlc", "_before", ties=ties)
    ran = null_safe_join(ran, marks, ["tree_id", "origin_cluster_id"], "left")
    ran = ran.withColumn("applied", F.col("hlc") > F.coalesce(F.greatest("_before", "hwm"), zero())).drop("_before", "hwm")
    return ran.unionByName(feed.where(F.col("origin_cluster_id").eqNullSafe(F.lit(local))).withColumn("applied", F.lit(False)))


def advance_marks(applied: DataFrame, marks: DataFrame) -> DataFrame:
    """(tree_id, origin_cluster_id, hwm) after an apply."""
    new = applied.where("applied").select("tree_id", "origin_cluster_id", F.col("hlc").alias("hwm"))
    return new.unionByName(marks.select("tree_id", "origin_cluster_id", "hwm")).groupBy("tree_id", "origin_cluster_id").agg(F.max("hwm").alias("hwm"))


def applied_tree(entries: DataFrame, applied: DataFrame) -> DataFrame:
    """The tree after the applied entries, which keep their source's stamp, expiry and origin."""
    return resolve(entries.unionByName(applied.where("applied").select(*entries.columns)))


def apply_range(entries: DataFrame, start: str, end: str, now_ticks: int, stamp: Column, origin: str) -> DataFrame:
    """Tombstones of a replicated range delete: local stamps, the source's origin; an empty range does nothing."""
    return tombstones(live(entries.where(in_range(start, end)), now_ticks).select("key"), stamp, F.lit(origin))


def peer_lag(log: DataFrame, peers: DataFrame) -> DataFrame:
    """(peer, entries_behind, bytes_behind, seconds_since_contact) for ``peers(peer, cursor, last_contact_ticks, now_ticks)``; NaN if never met.

    Peers are sites, so their list is read first; one pass over the log then counts for all of them.
    """
    sites = peers.select("peer", "cursor.wall_ticks", "cursor.counter").collect()
    size = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
    past = [F.col("hlc") > hlc(p.wall_ticks, p.counter) for p in sites]
    counts = [F.struct(F.lit(p.peer).alias("peer"), F.count_if(c).alias("entries_behind"), F.coalesce(F.sum(F.when(c, size)), F.lit(0)).cast("long").alias("bytes_behind")) for p, c in zip(sites, past, strict=True)]
    since = F.when(F.col("last_contact_ticks").isNull(), F.lit(float("nan"))).otherwise((F.col("now_ticks") - F.col("last_contact_ticks")) / 1e7)
    behind = log.agg(F.array(*counts).alias("all")).select(F.explode("all").alias("x")).select("x.*")
    return peers.join(behind, "peer").select("peer", "entries_behind", "bytes_behind", since.alias("seconds_since_contact"))


def peer_errors(contacts: DataFrame) -> DataFrame:
    """(peer, contacts, errors, errors_in_a_row, last_success_ticks) of ``contacts(peer, at_ticks, ok)``; the row of errors is the one since the last success."""
    last = F.max(F.when(F.col("ok"), F.col("at_ticks")))
    ends = contacts.groupBy("peer").agg(F.count(F.lit(1)).alias("contacts"), F.count_if(~F.col("ok")).alias("errors"), last.alias("last_success_ticks"))
    late = contacts.join(ends.select("peer", "last_success_ticks"), "peer").where(F.col("last_success_ticks").isNull() | (F.col("at_ticks") > F.col("last_success_ticks")))
    row = late.groupBy("peer").agg(F.count(F.lit(1)).alias("errors_in_a_row"))
    return ends.join(row, "peer", "left").select("peer", "contacts", "errors", F.coalesce("errors_in_a_row", F.lit(0)).cast("long").alias("errors_in_a_row"), "last_success_ticks")


def collect_garbage(log: DataFrame, peers: DataFrame, retention_ticks: int) -> DataFrame:
    """Log entries that every peer is past by the retention: what may go."""
    cutoff = peers.agg((F.min("cursor.wall_ticks") - F.lit(retention_ticks)).alias("cutoff"))
    return log.join(F.broadcast(cutoff), F.col("hlc.wall_ticks") < F.col("cutoff")).drop("cutoff")  # one row
