"""Hashes that routing and partitioning need."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# 32-bit FNV-1a.
FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 0xFFFFFFFF


def _fnv1a(keys: pd.Series, width: int) -> pd.Series:
    """FNV-1a over the UTF-16 code units of each key, as bytes in little-endian order (width 1) or whole (width 2); all keys advance together."""
    raw = [b"" if k is None else k.encode("utf-16-le") for k in keys]
    n = np.array([len(r) // width for r in raw])
    order = np.argsort(-n, kind="stable")
    units = np.frombuffer(b"".join(raw), "<u1" if width == 1 else "<u2").astype(np.uint64)
    start = (np.cumsum(n) - n)[order]
    hashed = np.full(len(raw), FNV_OFFSET, np.uint64)
    for i in range(int(n.max(initial=0))):
        alive = int(np.searchsorted(-n[order], -i, "left"))  # keys with more than i units come first
        hashed[:alive] = ((hashed[:alive] ^ units[start[:alive] + i]) * np.uint64(FNV_PRIME)) & np.uint64(MASK32)
    out = np.empty(len(raw), np.int64)
    out[order] = hashed.astype(np.int64)
    return pd.Series(out).where(keys.notna().to_numpy(), None).astype("Int64")


@F.pandas_udf(LongType())
def fnv_bytes(keys: pd.Series) -> pd.Series:
    """FNV-1a over the bytes of the key in UTF-16; Spark has no such function, so this is an Arrow UDF."""
    return _fnv1a(keys, 1)


@F.pandas_udf(LongType())
def fnv_units(keys: pd.Series) -> pd.Series:
    """FNV-1a over the UTF-16 code units of the key."""
    return _fnv1a(keys, 2)


def log_partition(key: Column, partitions: int) -> Column:
    """Partition of the replication log: FNV-1a over the bytes of the key in UTF-16."""
    if partitions < 1:
        raise ValueError("at least one partition")
    return F.lit(0) if partitions == 1 else (fnv_bytes(key) % partitions).cast("int")


def silo(key: Column) -> Column:
    """Parity of FNV-1a over the UTF-16 code units of the key."""
    return fnv_units(key).bitwiseAND(F.lit(1)).cast("int")


@F.pandas_udf(LongType())
def xxh32(keys: pd.Series) -> pd.Series:
    """xxHash32 of the key's UTF-8 bytes; Spark's own hashes are other functions, so this one is an Arrow UDF."""
    import xxhash

    return keys.map(lambda k: None if k is None else xxhash.xxh32_intdigest(k.encode()))


def virtual_slot(key: Column, slots: int = 4096) -> Column:
    """Slot of a key in the shard map."""
    return (xxh32(key) % slots).cast("int")
