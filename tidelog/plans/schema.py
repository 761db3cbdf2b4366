"""Schemas of the store and conversions between timestamps and 100-nanosecond ticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ticks at the Unix epoch, ticks of a microsecond and of a day; virtual slots of the shard map.
EPOCH_TICKS, TICKS_PER_MICRO, TICKS_PER_DAY = 621355968000000000, 10, 864000000000
VIRTUAL_SLOTS = 4096
# The structural defaults of a tree.
MAX_LEAF_KEYS, MAX_INTERNAL_CHILDREN, SHARD_COUNT = 128, 128, 64
SYSTEM_PREFIX = "_tidelog_"

HLC = T.StructType([T.StructField("wall_ticks", T.LongType(), False), T.StructField("counter", T.IntegerType(), False)])
ENTRIES = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("hlc", HLC, False),
        T.StructField("is_tombstone", T.BooleanType(), False),
        T.StructField("expires_at_ticks", T.LongType(), False),
        T.StructField("origin_cluster_id", T.StringType()),
    ]
)
MUTATIONS = T.StructType([T.StructField("tree_id", T.StringType()), T.StructField("op", T.StringType()), T.StructField("key", T.StringType()), T.StructField("end_exclusive_key", T.StringType()), *ENTRIES.fields[1:]])
REPLOG = T.StructType([*MUTATIONS.fields, T.StructField("partition", T.IntegerType()), T.StructField("sequence", T.LongType())])


def hlc(wall: Column | int, counter: Column | int) -> Column:
    """A hybrid logical clock stamp; stamps compare by wall ticks, then counter."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(wall).cast("long").alias("wall_ticks"), as_column(counter).cast("int").alias("counter"))


def zero() -> Column:
    """The stamp before all others."""
    return hlc(0, 0)


def ticks(ts: Column) -> Column:
    """Ticks of a timestamp without time zone, whatever the session's zone; microseconds are the finest."""
    micros = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts.cast("timestamp_ntz"))
    return micros * F.lit(TICKS_PER_MICRO) + F.lit(EPOCH_TICKS)
