"""Exact deduplication with two Bloom passes.

Pass 1 counts, in a filter of bounded size, how often each cell is hit by the hash
of a normalised text; pass 2 looks each row up. Only rows whose cells were all hit
twice can have a partner, and only those are shuffled; the rest pass straight through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import SPACE, as_bytes, cut, salted_join

#: Cells of the filter: a power of two, about 32 for each row, within these bounds (512 KB as bits on every executor at most 64 MB).
CELLS_PER_ROW, LEAST_CELLS, MOST_CELLS = 32, 1 << 16, 1 << 29
SEGMENT = 1 << 16


def _digests(batches):
    for b in batches:
        text = b.column("text")
        shas = [hashlib.sha256(t.translate(None, SPACE)).digest() for t in as_bytes(text)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(shas, pa.binary()), pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64())], ["doc_id", "sha", "n_chars"]
        )


def _cells(shas: pa.Array, cells: int) -> np.ndarray:
    """Two cells for each hash."""
    raw = np.frombuffer(b"".join(shas.to_pylist()), "<u8").reshape(-1, 4)
    return np.stack([raw[:, 0] & np.uint64(cells - 1), raw[:, 1] & np.uint64(cells - 1)], 1).astype(np.int64)


def _hits(cells: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            hit = np.sort(_cells(b.column("sha"), cells).ravel())
            again = np.zeros(len(hit), bool)
            again[2:] = hit[2:] == hit[:-2]  # two hits say all that is asked
            hit = hit[~again]
            seg, first = np.unique(hit // SEGMENT, return_index=True)
            parts = [(p % SEGMENT).astype("<u2").tobytes() for p in np.split(hit, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(seg), pa.array(parts, pa.binary())], ["seg", "hits"])

    return run


def _repeated_cells(pdf):
    import pandas as pd

    n = np.bincount(np.frombuffer(b"".join(pdf["hits"]), "<u2"), minlength=SEGMENT)
    return pd.DataFrame({"seg": [pdf["seg"].iloc[0]], "bits": [np.packbits(n >= 2).tobytes()]})


def repeated_filter(digests: DataFrame, cells: int) -> bytes:
    """The bits of the cells that were hit twice or more: ``cells / 8`` bytes, whatever the number of rows."""
    hits = digests.select("sha").mapInArrow(_hits(cells), "seg long, hits binary")
    bits = bytearray(cells // 8)
    for r in hits.groupBy("seg").applyInPandas(_repeated_cells, "seg long, bits binary").toLocalIterator():
        bits[r.seg * SEGMENT // 8 : (r.seg + 1) * SEGMENT // 8] = r.bits
    return bytes(bits)


def exact_dedup(docs: DataFrame, cells_per_row: int = CELLS_PER_ROW, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; a null text
    counts as empty, so null, empty and blank texts form one group. Of a group the row with the
    most code points in its original text stays, then the smallest doc_id (a null id first); of
    rows that agree in both exactly one stays. Other columns are ignored; an empty table gives
    an empty result. Beyond ``most_cells`` the filter lets more unique rows through to the
    shuffle (a few dozen bytes each), never fewer repeated ones.
    """
    spark = docs.sparkSession
    digests = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests, "doc_id long, sha binary, n_chars long").withColumn("rid", F.monotonically_increasing_id()))
    rows = digests.count()
    cells = 1 << max(LEAST_CELLS.bit_length() - 1, min(most_cells.bit_length() - 1, (max(rows, 1) * cells_per_row).bit_length()))
    bits = spark.sparkContext.broadcast(repeated_filter(digests, cells))

    def look_up(batches):
        packed = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            at = _cells(b.column("sha"), cells)
            hit = (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            yield b.append_column("maybe", pa.array(hit.all(1)))

    looked = digests.mapInArrow(look_up, "doc_id long, sha binary, n_chars long, rid long, maybe boolean")
    maybe = looked.where("maybe").drop("maybe")
    groups = cut(maybe.groupBy("sha").agg(F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size")))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    shuffled = salted_join(maybe, groups, "sha", "group_size", rows, "rid").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), sha)
    straight = looked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return straight.unionByName(shuffled)
