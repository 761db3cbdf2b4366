"""Substring deduplication by Rabin-Karp hashes of every fixed-length window of words.

Windows are dealt by hash and counted; all but the first occurrence of a repeated window
go back to the document, where they merge into maximal removal intervals. Hashes travel
packed, one row for a range of hashes and some million words, not one row for each window. Of
windows that repeat among those million words only the first travels by its hash: the others are
known to go, so a window that a third of all documents share reaches its range once for each run of words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import as_bytes, doc_key, labels, mix, numbers, ranges_for, split_words, squeeze, stretch, tidy, word_hashes
from tidelog.llm.rolling import span_hashes, window_starts

WINDOW = 20
#: Words that a task hashes at a time, and bytes of text (some 6 for a word) whose windows one range holds.
AT_ONCE, RANGE_BYTES = 1_000_000, 12 << 20


def gathered(batches, size, at_once=AT_ONCE):
    """Runs of Arrow batches as tables of about ``at_once`` words; ``size`` is the column of texts."""
    held, n = [], 0
    for b in batches:
        step = 256 if at_once >= AT_ONCE else 1
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            held.append(part)
            n += part.column(size).nbytes // 6
            if n >= at_once:
                yield pa.Table.from_batches(held)
                held, n = [], 0
                tidy()
    if held:
        yield pa.Table.from_batches(held)
        held = []
    tidy()


def _one(column) -> pa.Array:
    return pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column


def _pack(ids, dks, doc, start) -> dict:
    """Columns (d, dk, k, s): documents in order, how many windows of each follow, and their starts."""
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)])
    who = doc[new]
    return {"d": [squeeze(ids[who])], "dk": [squeeze(dks[who])], "k": [squeeze(np.diff(np.concatenate([new, [len(doc)]])))], "s": [squeeze(start)]}


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d, dk, k, s = (np.concatenate([stretch(x) for x in pdf[c]]) for c in ("d", "dk", "k", "s"))
    return np.repeat(d, k), np.repeat(dk, k), s


def _home(d: np.ndarray, dk: np.ndarray, homes: int) -> np.ndarray:
    return (mix(d.view(np.uint64) ^ mix(dk.view(np.uint64))) % np.uint64(homes)).astype(np.int32)


def _parts(of: np.ndarray, n: int):
    """(value, indices) of each value below n that occurs, by a stable sort."""
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p] : edges[p + 1]]


def _deal(names: np.ndarray, window: int, at_once: int):
    """Packed rows (p, h, x, ...): the first of equal windows by range of their hash; the rest, with no hash, by home of their document. The first half of ``names`` are ranges, the rest homes."""
    ranges = len(names) // 2

    def run(batches):
        for t in gathered(batches, "text", at_once):
            t = t.sort_by([("id", "ascending"), ("dk", "ascending")])
            ids, dks = (t.column(c).to_numpy() for c in ("id", "dk"))
            one_of_each = np.concatenate([[True], (ids[1:] != ids[:-1]) | (dks[1:] != dks[:-1])])
            if not one_of_each.all():  # copies of one document share its fate
                t, ids, dks = t.filter(pa.array(one_of_each)), ids[one_of_each], dks[one_of_each]
            counts, words = split_words(_one(t.column("text")), lower=False)
            doc, at = window_starts(counts, window)
            if not len(doc):
                continue
            one, two = (mix(span_hashes(h, at, at + window)) for h in word_hashes(words, (1, 2)))
            extra, to, start = (two >> np.uint64(56)).astype(np.uint8), (two % np.uint64(ranges)).astype(np.int32), at - (np.cumsum(counts) - counts)[doc]
            known = np.zeros(len(doc), bool)
            known[later(one, extra, doc, start)] = True
            own = np.flatnonzero(~known)
            for p, i in _parts(to[own], ranges):
                i = own[i]
                yield pa.RecordBatch.from_pydict({"p": pa.array(names[p : p + 1]), "h": [one[i].tobytes()], "x": [extra[i].tobytes()]} | _pack(ids, dks, doc[i], start[i]))
            own = np.flatnonzero(known)
            for p, i in _parts(_home(ids, dks, ranges)[doc[own]], ranges):
                i = own[i]
                yield pa.RecordBatch.from_pydict({"p": pa.array(names[ranges + p : ranges + p + 1]), "h": [b""], "x": [b""]} | _pack(ids, dks, doc[i], start[i]))

    return run


def later(h: np.ndarray, extra: np.ndarray, d: np.ndarray, s: np.ndarray, *tie: np.ndarray) -> np.ndarray:
    """Indices of the windows whose hash (``h`` and 8 bits more) also occurs at a smaller (document, tie, start)."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    order = order[np.lexsort((s[order], *(t[order] for t in tie), d[order], extra[order], h[order]))]
    if not len(order):
        return order
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (extra[order][1:] != extra[order][:-1])])
    return order[~new]


PACKED = "d binary, dk binary, k binary, s binary"


def _count(names: np.ndarray, homes: np.ndarray):
    ranges, number = len(homes), numbers(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = number[int(pdf["p"].iloc[0])]
        if p >= ranges:
            return pdf[["d", "dk", "k", "s"]].assign(home=homes[p - ranges])
        tidy()
        h = np.frombuffer(b"".join(pdf["h"]), "<u8")
        extra = np.frombuffer(b"".join(pdf["x"]), np.uint8)
        d, dk, s = _unpack(pdf)
        del pdf
        at = later(h, extra, d, s, dk)
        d, dk, s = d[at], dk[at], s[at]
        order = np.lexsort((s, dk, d))
        d, dk, s = d[order], dk[order], s[order]
        doc = np.cumsum(np.concatenate([[False], (d[1:] != d[:-1]) | (dk[1:] != dk[:-1])])[: len(d)])
        _, first = np.unique(doc, return_index=True)
        out = [pd.DataFrame({"home": homes[home : home + 1]} | _pack(d[first], dk[first], doc[i], s[i])) for home, i in _parts(_home(d, dk, ranges), ranges)]
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("home", "d", "dk", "k", "s")})

    return run


def merge_windows(doc: np.ndarray, s: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals (document, start, end) of windows that overlap or touch."""
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] > s[:-1] + window)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], s[new], s[last] + window


def _merge(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, dk, s = _unpack(pdf)
        keys = pd.MultiIndex.from_arrays([d, dk])
        doc, known = pd.factorize(keys)
        doc, a, b = merge_windows(doc, s, window)
        who, first = np.unique(doc, return_index=True)
        known = known[who]
        return pd.DataFrame({"id": known.get_level_values(0), "dk": known.get_level_values(1), "starts": np.split(a, first[1:]), "ends": np.split(b, first[1:])})

    return run


def removal_intervals(keyed: DataFrame, size: int, window: int = WINDOW, at_once: int = AT_ONCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, dk, starts, ends): for each document of ``keyed(id, dk, text)`` with repeated windows, the word intervals to remove."""
    ranges = ranges_for(size, range_bytes)
    names, homes = labels(2 * ranges), labels(ranges)
    dealt = keyed.select("id", "dk", "text").mapInArrow(_deal(names, window, at_once), f"p int, h binary, x binary, {PACKED}")
    counted = dealt.repartition(2 * ranges, "p").groupBy("p").applyInPandas(_count(names, homes), f"home int, {PACKED}")
    return counted.repartition(ranges, "home").groupBy("home").applyInPandas(_merge(window), "id long, dk long, starts array<long>, ends array<long>")


def kept_words(words: list[bytes], starts, ends) -> list[bytes]:
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        out += words[at:a]
        at = b
    return out + words[at:]


def _rewrite(batches):
    for b in batches:
        clean, n, gone = [], [], []
        starts, ends = b.column("starts").to_pylist(), b.column("ends").to_pylist()
        for t, s, e in zip(as_bytes(b.column("text")), starts, ends, strict=True):
            words = t.split()
            kept = kept_words(words, s, e) if s else words
            n.append(len(words))
            gone.append(len(words) - len(kept))
            clean.append(b" ".join(kept))
        extra = {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(clean, pa.binary()).cast(pa.string()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in clean])}
        yield pa.RecordBatch.from_arrays([b.column(c) for c in b.schema.names if c not in ("starts", "ends")] + list(extra.values()), [c for c in b.schema.names if c not in ("starts", "ends")] + list(extra))


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True, at_once: int = AT_ONCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, [kept_text, removed,] n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words over it also starts earlier: in a smaller
    doc_id (a null id first) or earlier in the same document; windows are judged on the input.
    Words are runs of other characters than ``[\\x20\\x09-\\x0D]``, unchanged; kept words are
    joined by one space. A null or blank text has no words; texts of fewer words than a window
    stay. Rows with equal doc_id and equal text are copies of one document: the same positions go from
    each. Rows of one doc_id with different texts are different documents, in order of a hash of the text.
    Other columns are ignored; an empty table gives an empty result. Windows count as equal by 72 bits
    of hash and the range, which comes from other bits (some 5e-6 false matches are expected in 30 GB).
    """
    keyed, size, _ = doc_key(docs.select("doc_id", "text"))
    ids = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "id", "dk", "text")
    joined = ids.join(removal_intervals(keyed, size, window, at_once, range_bytes), ["id", "dk"], "left").select("doc_id", "text", "starts", "ends", F.transform(F.arrays_zip("starts", "ends"), lambda x: F.concat_ws(":", x["starts"].cast("string"), x["ends"].cast("string"))).alias("spans"))
    joined = joined.withColumn("removed", F.coalesce(F.array_join("spans", ","), F.lit(""))).drop("spans")
    if not with_text:
        return joined.drop("removed").mapInArrow(_digest_only, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return joined.mapInArrow(_rewrite, "doc_id long, text string, removed string, n_words long, n_removed long, kept_text string, kept_sha256 string").drop("text")


def _digest_only(batches):
    for b in _rewrite(batches):
        yield b.select(["doc_id", "n_words", "n_removed", "kept_sha256"])
