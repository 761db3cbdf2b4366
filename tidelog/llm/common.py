"""Shared plumbing of the training-data operators: table access, lineage cuts, word splitting and packing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of all contracts; ``bytes.split()`` and Arrow's ASCII split use exactly this set.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
NULL_ID = -(2**63)

_written: "weakref.WeakKeyDictionary[SparkSession, list[str]]" = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark reads the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where it is unset on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, so that what follows restarts from there.

    The table survives the loss of executors and goes with ``release`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if spark not in _written:
        _written[spark] = []
        atexit.register(drop_tables, spark)
    _written[spark].append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidelog_path = path
    return back


def written(spark: SparkSession) -> int:
    """How many tables ``cut`` wrote that are still there: a place to ``release`` back to."""
    return len(_written.get(spark, []))


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Remove the tables written after ``written`` gave ``since``, but for those to keep. Nothing that is still to be read may hang on them."""
    paths = _written.get(spark, [])
    kept = {k._tidelog_path for k in keep}
    _delete(spark, [p for p in paths[since:] if p not in kept])
    paths[since:] = [p for p in paths[since:] if p in kept]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def drop_tables(spark: SparkSession) -> None:
    """Remove the tables that ``cut`` wrote in this session."""
    with contextlib.suppress(Exception):  # at exit the JVM may be gone already
        _delete(spark, _written.pop(spark, []))


def doc_key(docs: DataFrame) -> tuple[DataFrame, int, bool]:
    """(``docs(doc_id, text)`` with ``id`` and ``dk``, bytes of all texts, whether ``dk`` is in use). Rows that agree in id and dk are copies of one document: same doc_id, same text.

    ``dk`` hashes the text, but is 0 for all where no doc_id has two different texts: keys that
    travel with each piece of a text then cost nothing. One narrow pass tells which case it is.
    """
    i, k = key_of(True)
    told = docs.select(i.alias("id"), k.alias("dk"), F.octet_length("text").alias("b")).groupBy("id").agg(F.sum("b").alias("b"), (F.min("dk") != F.max("dk")).alias("two"))
    told = told.agg(F.sum("b").alias("b"), F.bool_or("two").alias("two")).first()
    i, k = key_of(bool(told.two))
    return docs.select("*", i.alias("id"), k.alias("dk")), told.b or 0, bool(told.two)


def key_of(two: bool) -> tuple:
    """The expressions of ``id`` and ``dk`` over rows with doc_id and text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce("text", F.lit(""))) if two else F.lit(0).cast("long")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``docs`` has too."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def shield(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """(``docs`` whose columns of these names got others; the new name of each), for operators that would replace them."""
    clash = [c for c in docs.columns if c.lower() in names]
    other = dict(zip(clash, fresh(docs, *[f"user_{c}" for c in clash]), strict=True))
    return docs.withColumnsRenamed(other), other


def unshield(result: DataFrame, docs: DataFrame, other: dict[str, str]) -> DataFrame:
    """The columns of ``docs`` alone, under their own names again."""
    return result.select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns])


#: Rows of a few numbers, and items of their arrays, that are broadcast at most (some 50 MB each, and 100 MB).
BROADCAST_ROWS, BROADCAST_ITEMS = 500_000, 4_000_000


def small_or_merged(written: DataFrame) -> DataFrame:
    """A written table, for a join: broadcast where it has at most ``BROADCAST_ROWS`` rows and ``BROADCAST_ITEMS`` items in their arrays, else merged."""
    items = [F.size(f.name) for f in written.schema.fields if isinstance(f.dataType, T.ArrayType)]
    told = written.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(sum(items, F.lit(0))), F.lit(0)).alias("items")).first()
    return F.broadcast(written) if told.rows <= BROADCAST_ROWS and told["items"] <= BROADCAST_ITEMS else written.hint("merge")


#: Part of all rows from which a key is hot, and tasks that share one.
HOT_PART, SALTS = 1000, 64


def salted_join(left: DataFrame, right: DataFrame, keys: str | list[str], count: str, total: int, tie: str) -> DataFrame:
    """``left`` joined with ``right``, a written table of one row a key with ``count`` rows on the left, of ``total`` in all.

    Keys of more than a thousandth of all rows are at most a thousand, so their list is broadcast
    whatever the size of the table; ``tie`` deals their rows to several tasks.
    """
    keys = [keys] if isinstance(keys, str) else keys
    hot = F.col(count) > max(total // HOT_PART, HOT_PART)
    listed = F.broadcast(right.where(hot).select(*keys, F.lit(True).alias("_hot")))
    dealt = left.join(listed, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(tie), F.lit(SALTS))).otherwise(0).cast("int")).drop("_hot")
    spread = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [*keys, "_salt"]).drop("_salt")


def ranges_for(size: int, each: int, least: int = 8) -> int:
    """Ranges of hashes, so that each holds ``each`` bytes of ``size`` on average."""
    return max(least, -(-size // each))


def tidy() -> None:
    """Give freed memory back to the system: a Python worker that waits for its next task holds no more than it must."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, a null as no bytes."""
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def string_hashes(words: pa.Array, seed: int) -> np.ndarray:
    """64-bit hashes of distinct words, equal on every executor."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def split_words(column: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """(number of words per row, all words one after another) of the words ``[^\\x20\\x09-\\x0D]+``; ``lower`` touches A-Z alone."""
    text = pc.fill_null(column, "").cast(pa.large_string())
    if lower:
        text = pc.ascii_lower(text)
    parts = pc.ascii_split_whitespace(text)
    flat, counts = parts.values[parts.offsets[0].as_py() : parts.offsets[-1].as_py()], np.diff(parts.offsets.to_numpy())
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():  # white space at an end leaves an empty piece
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[full], minlength=len(counts))
        flat = flat.filter(pa.array(full))
    return counts.astype(np.int64), flat


def word_hashes(words: pa.Array, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """For each seed, the hash of each word; each distinct word is hashed once."""
    if not len(words):
        return [np.zeros(0, np.uint64) for _ in seeds]
    coded = pc.dictionary_encode(words)
    at = coded.indices.to_numpy()
    return [string_hashes(coded.dictionary, s)[at] for s in seeds]


def squeeze(x: np.ndarray) -> bytes:
    """Differences of an integer array, compressed; for ascending runs about a byte each."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(x.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()) if len(x) else b""


def stretch(data: bytes) -> np.ndarray:
    """What ``squeeze`` packed."""
    import zstandard

    if not data:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(-1))


def labels(n: int) -> np.ndarray:
    """n whole numbers of which each lies in another of n partitions when rows are dealt by a hash of them (Murmur3 of 32 bits, seed 42, as Spark deals integers)."""
    out, start = np.full(n, -1, np.int32), 0
    while (out < 0).any():
        x = np.arange(start, start + 4 * n, dtype=np.uint32)
        turn = lambda v, by: (v << np.uint32(by)) | (v >> np.uint32(32 - by))
        h = np.uint32(42) ^ (turn(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
        h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
        for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(times)
        to = h.view(np.int32).astype(np.int64) % n
        first = np.unique(to, return_index=True)
        new = out[first[0]] < 0
        out[first[0][new]] = x[first[1][new]].astype(np.int32)
        start += 4 * n
    return out


def numbers(names: np.ndarray) -> dict[int, int]:
    """The place of each label."""
    return {int(x): i for i, x in enumerate(names)}
