"""A corpus pipeline of five operators: each stage reads what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents, whatever other columns docs have and whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import cut, doc_key, fresh, key_of, release, shield, table, unshield, written
from tidelog.llm.decontaminate import decontaminate
from tidelog.llm.mixing import mix_sources
from tidelog.llm.ngram_join import keep_one
from tidelog.llm.quality import classify_quality
from tidelog.llm.sharding import shard

#: SQL cannot express the classifier's training; the tests compare with a brute-force version.
ORACLE_SQL = None
#: Documents of a source whose copies are decided together.
TOGETHER = 1 << 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; all rows of the stage's input train and are judged.

    Null, empty and blank texts go. Rows that repeat share a fate, a null doc_id changes nothing, no
    rows give no rows. Equal scores are equal decisions: what reaches one half stays.
    """
    rows, other = shield(docs, ("quality_score", "quality_votes", "weak_posterior", "keep"))
    return unshield(classify_quality(rows).where("keep"), docs, other)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the smallest doc_id, a null id last.

    Of rows that agree in doc_id and text one stays; of one doc_id with linked texts the one with the smallest
    hash. Rows of null or blank text are linked with nothing and stay. No rows give no rows.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    Null and blank texts hold none and stay. Rows that repeat share a fate, a null doc_id changes
    nothing; no rows, or no benchmark, give back the rows.
    """
    rows, other = shield(docs, ("leaks", "item_ids", "contaminated"))
    return unshield(decontaminate(rows, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")), docs, other)


def _nearer(size: np.ndarray, extra: np.ndarray, owed: int) -> int:
    """Give or take back one extra copy, or move one from a document to another, as long as that brings the words owed nearer to none."""
    for _ in range(8):
        on, off = np.flatnonzero(extra), np.flatnonzero(~extra)
        off = off[np.argsort(size[off], kind="stable")]
        moves = [(abs(owed + size[i]), (i,)) for i in on[np.argsort(np.abs(owed + size[on]), kind="stable")[:1]]]
        moves += [(abs(owed - size[j]), (j,)) for j in off[np.argsort(np.abs(owed - size[off]), kind="stable")[:1]]]
        if len(on) and len(off):
            place = np.searchsorted(size[off], owed + size[on])
            for near in (np.maximum(place - 1, 0), np.minimum(place, len(off) - 1)):
                gap = np.abs(owed + size[on] - size[off[near]])
                k = int(gap.argmin())
                moves.append((gap[k], (on[k], off[near[k]])))
        best, who = min(moves, key=lambda m: m[0], default=(abs(owed), ()))
        if best >= abs(owed):
            return owed
        for k in who:
            owed += int(size[k]) if extra[k] else -int(size[k])
            extra[k] = not extra[k]
    return owed


def _whole(rows: pa.Table) -> pa.Table:
    """Copies of whole documents: full multiples first, then the words left over, largest document first, as soon as they make up more than half of one."""
    size, taken, h = (rows[c].to_numpy() for c in ("size", "taken", "h"))
    copies, owed = taken // size, 0
    left = taken - copies * size
    order = np.lexsort((h, -size))
    order = order[left[order] > 0]
    extra = np.zeros(len(order), bool)
    for n, k in enumerate(order.tolist()):
        owed += int(left[k])
        if 2 * owed > size[k]:
            extra[n] = True
            owed -= int(size[k])
    _nearer(size[order], extra, owed)
    copies[order] += extra
    return rows.select(["id", "dk", "source"]).append_column("n_copies", pa.array(copies, pa.int64()))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes 0 to 3 times, so that the words of each source come near those that the mix takes of it.

    Rows that agree in doc_id, source and text are taken together and come equally often. Rows of null or blank
    text have no words and go. A null source is a source, and a null doc_id an id; no rows give no rows.
    """
    keyed, _, two = doc_key(docs.select("doc_id", "text", "source"))
    mixed = mix_sources(keyed, carry=("id", "dk")).where("size > 0").groupBy("id", "dk", "source")
    mixed = cut(mixed.agg(F.sum("size").alias("size"), F.sum("taken").alias("taken")).withColumn("h", F.xxhash64(F.lit(17), "id", "dk")))
    parts = mixed.groupBy(F.col("source").alias("s")).agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    dealt = mixed.join(parts, F.col("source").eqNullSafe(F.col("s"))).withColumn("part", F.pmod("h", "parts"))
    copies = dealt.groupBy("source", "part").applyInArrow(_whole, "id long, dk long, source string, n_copies long").where("n_copies > 0")
    i, k, s, n, c = fresh(docs, "mixed_id", "mixed_dk", "mixed_source", "n_copies", "copy")
    copies = copies.withColumnsRenamed({"id": i, "dk": k, "source": s, "n_copies": n})
    joined = docs.join(copies, (key_of(two)[0] == F.col(i)) & (key_of(two)[1] == F.col(k)) & F.col("source").cast("string").eqNullSafe(F.col(s)))
    return joined.withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot: copies and repeated rows each their own slot, in one shard.

    Null texts are a group, apart from empty ones; no rows give no rows.
    """
    return shard(docs, shards=8)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; what stages wrote for themselves, and for the next but one, goes as soon as the next has written."""
    docs, before = table(spark, sf_dir, "documents"), written(spark)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        release(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
