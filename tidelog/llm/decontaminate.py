"""Benchmark decontamination by template windows.

Words become templates: numbers, units and names turn into typed placeholders, other words
into their lower case without outer punctuation. Windows of the benchmark, as templates and word
by word, are hash-joined with those of the documents; a Bloom filter of the benchmark's hashes, of
bounded size, keeps all other windows of the documents out of the shuffle. Aligned hits form
runs, and a run counts as far as its placeholders are filled consistently, so the same
question with other parameters is found too. Hits bring hashes of their words along, so texts stay where they are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, doc_key, fresh, key_of, mix, ranges_for, small_or_merged, split_words, string_hashes
from tidelog.llm.rolling import span_hashes, window_starts
from tidelog.llm.substring_dedup import AT_ONCE, _one, gathered

#: Words of a window, words that stay literal in one that is matched as a template, and words of an aligned run from which an item counts as leaked (the whole item if shorter).
WINDOW, LEAST_LITERAL, LEAST_RUN = 8, 4, 13
#: Cells of the filter: a power of two, about 64 for each window, within these bounds (64 MB as bits at most); cells of one part of it.
CELLS_PER_WINDOW, LEAST_CELLS, MOST_CELLS, SEGMENT = 64, 1 << 22, 1 << 29, 1 << 16
#: Windows of the benchmark that are broadcast at most (some 200 bytes each), and hits that one task follows.
BROADCAST_WINDOWS, TASK_HITS = 200_000, 100_000

# Unit words that follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent % dollar dollars usd eur euro euros cent cents mph kmh km/h m/s hz khz mhz w kw v kwh degree degrees c f k".split()
)
# Words that open sentences and aren't names, though they have a capital there.
COMMON = frozenset(
    "the a an this that these those there here it its he she they we you i my your his her our their if when while after before because since although though as at by for from in into of on to with without within "
    "what which who whom whose where why how and or but nor so yet not no yes let lets given suppose assume consider find calculate compute determine solve write explain show prove answer choose select name list state "
    "is are was were be been do does did can could will would shall should may might must have has had one two three four five six seven eight nine ten each every all some many most both any other another then next now "
    "how's what's first second last only also during under over between through per than once until about".split()
)
PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”‘’¿¡"
NUMBER = r"^[+-]?[$€£]?[0-9][0-9.,:/]*%?$"
MEASURE_HEAD = r"^[+-]?[$€£]?[0-9][0-9.,]*"
MEASURE = MEASURE_HEAD + r"[A-Za-z/%]+$"
NAMED = r"^\p{Lu}[^\p{Lu}\p{Lt}]*\p{Ll}[^\p{Lu}\p{Lt}]*$"
PLAIN, NUM, UNIT, NAME, MIXED = range(5)
#: Sets hashes of exact windows apart from those of templates.
EXACT = 1 << 32


def kinds_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(what each word can be, its core in lower case): the same wherever a word stands, but that a unit follows a number."""
    core = pc.utf8_trim(words, characters=PUNCTUATION)
    low = pc.utf8_lower(core)
    is_ = lambda pattern: np.asarray(pc.match_substring_regex(core, pattern))
    one_of = lambda x, known: np.asarray(pc.is_in(x, pa.array(sorted(known), x.type)))
    unit, common = one_of(low, UNITS), one_of(low, COMMON)
    kind = np.where(is_(NAMED) & ~common, NAME, PLAIN)
    kind[unit] = UNIT
    mixed = np.flatnonzero(is_(MEASURE))
    tail = pc.replace_substring_regex(low.take(pa.array(mixed)), MEASURE_HEAD, "")
    kind[mixed[one_of(tail, UNITS)]] = MIXED
    kind[is_(NUMBER)] = NUM
    return kind.astype(np.int8), low


@lru_cache(1)
def _placeholders() -> np.ndarray:
    return string_hashes(pa.array(["\0plain", "\0number", "\0unit", "\0name", "\0measure"]), 7)


def templates(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words per row, template hashes, kinds, hashes of the words' cores in lower case)."""
    counts, words = split_words(text, lower=False)
    coded = pc.dictionary_encode(words)
    at = coded.indices.to_numpy()
    kinds, low = kinds_of(coded.dictionary.cast(pa.string()))
    kind = kinds[at]
    literal = string_hashes(low, 7)[at] if len(low) else np.zeros(0, np.uint64)
    after = np.concatenate([[False], kind[:-1] == NUM])[: len(kind)]
    after[(np.cumsum(counts) - counts)[counts > 0]] = False
    kind = np.where((kind == UNIT) & ~after, PLAIN, kind)
    return counts, np.where(kind == PLAIN, literal, _placeholders()[kind]), kind, literal


def _windows(counts, hashes, kind, literal, width):
    """(document, position, hash) of the windows as templates, if they have enough literal words, and word by word."""
    doc, at = window_starts(counts, width)
    plain = np.concatenate([[0], np.cumsum(kind == PLAIN)])
    enough = plain[at + width] - plain[at] >= min(LEAST_LITERAL, width)
    exact = mix(span_hashes(literal, at, at + width) + np.uint64(width + EXACT))
    template = mix(span_hashes(hashes, at[enough], at[enough] + width) + np.uint64(width))
    return np.concatenate([doc[enough], doc]), np.concatenate([at[enough], at]), np.concatenate([template, exact])


def _cells(h: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(cells - 1)).astype(np.int64), (mix(h ^ np.uint64(0x5BD1)) & np.uint64(cells - 1)).astype(np.int64)


FOUND = "h long, at int, width int, kinds binary, words binary"


def _found(counts, kind, literal, doc, at, h, width, keys: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows of windows with the kinds and hashes of their words; ``keys`` are columns by document."""
    span = at[:, None] + np.arange(width)
    words, kinds = literal[span].astype("<u8"), kind[span].astype(np.int8)
    cols = {k: pa.array(v[doc]) for k, v in keys.items()}
    cols |= {"h": pa.array(h.view(np.int64)), "at": pa.array((at - (np.cumsum(counts) - counts)[doc]).astype(np.int32)), "width": pa.array(np.full(len(at), width, np.int32))}
    cols |= {"kinds": pa.array([x.tobytes() for x in kinds], pa.binary()), "words": pa.array([x.tobytes() for x in words], pa.binary())}
    return pa.RecordBatch.from_pydict(cols)


def _item_windows(window: int):
    def run(batches):
        for t in gathered(batches, "text"):
            counts, hashes, kind, literal = templates(_one(t.column("text")))
            keys = {"item_id": t.column("item_id").to_numpy(), "ik": t.column("ik").to_numpy(), "n": counts}
            for width in sorted({min(window, int(c)) for c in counts if c}):
                doc, at, h = _windows(counts, hashes, kind, literal, width)
                own = np.minimum(counts[doc], window) == width
                if own.any():
                    yield _found(counts, kind, literal, doc[own], at[own], h[own], width, keys)

    return run


def _bits(cells: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(SEGMENT, bool)
        hit[pdf["cell"].to_numpy() % SEGMENT] = True
        return pd.DataFrame({"seg": [int(pdf["seg"].iloc[0])], "bits": [np.packbits(hit).tobytes()]})

    return run


def _cell_rows(cells: int):
    def run(batches):
        for b in batches:
            hit = np.unique(np.concatenate(_cells(b.column("h").to_numpy().view(np.uint64), cells)))
            yield pa.RecordBatch.from_pydict({"seg": pa.array((hit // SEGMENT).astype(np.int32)), "cell": pa.array(hit)})

    return run


def window_filter(windows: DataFrame, n: int) -> tuple[bytes, int]:
    """(bits, cells) of a Bloom filter of the hashes of n windows: ``cells / 8`` bytes, whatever n."""
    cells = 1 << max(LEAST_CELLS.bit_length() - 1, min(MOST_CELLS.bit_length() - 1, (max(n, 1) * CELLS_PER_WINDOW).bit_length()))
    bits = bytearray(cells // 8)
    rows = windows.select("h").mapInArrow(_cell_rows(cells), "seg int, cell long")
    for r in rows.groupBy("seg").applyInPandas(_bits(cells), "seg int, bits binary").toLocalIterator():
        bits[r.seg * SEGMENT // 8 : (r.seg + 1) * SEGMENT // 8] = r.bits
    return bytes(bits), cells


def _doc_windows(filter_, cells: int, widths: list[int], at_once: int):
    def run(batches):
        packed = np.frombuffer(filter_.value, np.uint8)
        for t in gathered(batches, "text", at_once):
            counts, hashes, kind, literal = templates(_one(t.column("text")))
            keys = {"id": t.column("id").to_numpy(), "dk": t.column("dk").to_numpy()}
            for width in widths:
                doc, at, h = _windows(counts, hashes, kind, literal, width)
                may = np.ones(len(h), bool)
                for cell in _cells(h, cells):
                    may[may] = (packed[cell[may] >> 3] >> (7 - (cell[may] & 7)).astype(np.uint8)) & 1 == 1
                if may.any():
                    yield _found(counts, kind, literal, doc[may], at[may], h[may], width, keys)

    return run


def consistent_runs(start: int, end: int, slots) -> list[tuple[int, int]]:
    """The longest parts of [start, end) that fill each slot value in one way; ``slots`` are (position, slot value, filling) in order."""
    filled: dict[tuple, tuple] = {}
    out = []
    for at, slot, word in slots:
        before, last = filled.get(slot, (word, -1))
        if before != word and last >= start:
            out.append((start, at))
            start = last + 1
        filled[slot] = word, at
    return [*out, (start, end)]


def _run(own: pd.DataFrame, least_run: int) -> list[tuple[int, int]]:
    """The consistent parts, long enough, of one run: hits of one document and item, in order, that overlap or touch and are aligned alike."""
    start, end = int(own["at"].iloc[0]), int(own["at"].iloc[-1] + own["width"].iloc[-1])
    least = min(int(own["n"].iloc[0]), least_run)
    if end - start < least:
        return []
    mine, theirs = {}, {}
    for at, kinds, words, item_kinds, item_words in own[["at", "kinds", "words", "item_kinds", "item_words"]].itertuples(index=False):
        for into, k, w in ((mine, kinds, words), (theirs, item_kinds, item_words)):
            into.update(zip(range(at, at + len(k)), zip(k, np.frombuffer(w, "<u8").tolist(), strict=True), strict=True))
    slots = []
    for p in range(start, end):
        kind, filling = mine[p]
        item_kind, slot = theirs[p]
        if item_kind != PLAIN or kind != PLAIN:
            slots.append((p, (item_kind if item_kind != PLAIN else kind, slot), filling))
    return [(u, v) for u, v in consistent_runs(start, end, slots) if v - u >= least]


def _leaks(least_run: int):
    """(id, dk, leaks) of the documents of one task, from their hits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["shift"] = pdf["at"] - pdf["pos"]
        by = ["id", "dk", "item_id", "ik", "shift"]
        pdf = pdf.drop_duplicates([*by, "at"]).sort_values([*by, "at"], kind="stable")
        key, at = pdf[by].to_numpy(), pdf["at"].to_numpy()
        new = np.concatenate([[True], (key[1:] != key[:-1]).any(1) | (at[1:] > at[:-1] + pdf["width"].to_numpy()[:-1])])
        edges = [*np.flatnonzero(new).tolist(), len(pdf)]
        # most runs are too short to matter
        first, last = np.array(edges[:-1]), np.array(edges[1:]) - 1
        long = at[last] + pdf["width"].to_numpy()[last] - at[first] >= np.minimum(pdf["n"].to_numpy()[first], least_run)
        found: dict[tuple[int, int], set] = {}
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            for u, v in _run(pdf.iloc[a : b + 1], least_run):
                found.setdefault((int(key[a, 0]), int(key[a, 1])), set()).add((int(key[a, 2]), u, v))
        return pd.DataFrame([(i, k, [{"item_id": x, "start": u, "end": v} for x, u, v in sorted(rows)]) for (i, k), rows in found.items()], columns=["id", "dk", "leaks"])

    return run


LEAKS_SQL = "array<struct<item_id:bigint,start:bigint,end:bigint>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_run: int = LEAST_RUN, at_once: int = AT_ONCE // 2) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)``, one row for each, with ``leaks`` (item_id, start, end in words), ``item_ids`` and ``contaminated``.

    A document is contaminated by an item of ``benchmark(item_id, text)`` when an aligned run of
    matching windows covers ``least_run`` words or the whole item, and fills the
    placeholders consistently on that length. Null and blank texts, on either side, match nothing, nor do items
    of a null id. Columns of ``docs`` with the names of results are replaced. Repeated rows share
    their leaks; with no benchmark nothing is contaminated. Texts are read once and are shuffled only where the list
    of contaminated documents is too long to broadcast.
    """
    spark = docs.sparkSession
    rows = docs.drop("leaks", "item_ids", "contaminated")
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("ik"), "text")
    windows = cut(items.mapInArrow(_item_windows(window), f"item_id long, ik long, n long, {FOUND}").dropDuplicates(["item_id", "ik", "h", "at"]))
    told = windows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each width up to the window's
    n = sum(r.n for r in told)
    keyed, _, two = doc_key(rows.select("doc_id", "text"))
    bits, cells = window_filter(windows, n)
    filter_ = spark.sparkContext.broadcast(bits)
    theirs = windows.select("h", "item_id", "ik", "n", F.col("at").alias("pos"), F.col("kinds").alias("item_kinds"), F.col("words").alias("item_words"))
    theirs = F.broadcast(theirs) if n <= BROADCAST_WINDOWS else theirs.hint("merge")
    mine = keyed.select("id", "dk", "text").mapInArrow(_doc_windows(filter_, cells, sorted(r.width for r in told), at_once), f"id long, dk long, {FOUND}")
    hits = cut(mine.join(theirs, "h").drop("h"))
    tasks = ranges_for(hits.count(), TASK_HITS)
    found = hits.withColumn("task", F.pmod(F.xxhash64("id", "dk"), F.lit(tasks))).groupBy("task").applyInPandas(_leaks(least_run), f"id long, dk long, leaks {LEAKS_SQL}")
    i, k = fresh(rows, "leak_id", "leak_dk")
    found = small_or_merged(cut(found).withColumnsRenamed({"id": i, "dk": k}))
    joined = rows.join(found, (key_of(two)[0] == F.col(i)) & (key_of(two)[1] == F.col(k)), "left").drop(i, k)
    joined = joined.withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAKS_SQL)))
    return joined.withColumn("item_ids", F.array_sort(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])))).withColumn("contaminated", F.size("leaks") > 0)
