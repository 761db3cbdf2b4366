"""Line deduplication by content-defined chunks of lines, in DataFrame functions alone.

A rolling hash over the hashes of neighbouring lines decides where a chunk ends, so an inserted
line moves only the boundaries beside it. Chunk hashes are counted over all documents; chunks
whose hash repeats are compared byte by byte, and all but the first of equal ones go. Chunks
whose edges differ hide what they share: with ``every_run`` an exact check follows, over those pairs
of neighbouring lines that no removed chunk covers. It counts and compares as for chunks, and finds each
line of each repeated run. Chunks of one line are then merged into a neighbour, so that every line is in one that is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, fresh, key_of, release, salted_join, small_or_merged, written

#: Lines that the rolling hash sees, one boundary for so many lines on average, and lines of a chunk that may be removed at least.
WINDOW, DIVISOR, LEAST_LINES = 2, 3, 2
LINE_MOD, BASE = 2**31 - 1, 31


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, dk, lines): rows that agree in the first two are copies of one document."""
    i, k = key_of(True)
    return docs.select(i.alias("id"), k.alias("dk"), _lines(F.col("text")).alias("lines"))


def chunk_arrays(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, merged: bool = False) -> DataFrame:
    """(id, dk, lines, ends) of ``docs(doc_id, text)``; ``ends`` holds the number of lines up to the end of each chunk.

    With ``merged`` no chunk of one line is cut off: of boundaries in a row the first counts, and none right after the first line or right before the last.
    """
    rolled = lambda i: sum((F.coalesce(F.get("hashes", i - 1 - k), F.lit(0).cast("long")) * BASE**k for k in range(window)), F.lit(0).cast("long"))
    falls = lambda i: rolled(i) % divisor == 0
    counts = (lambda i: falls(i) & ~falls(i - 1) & (i > 1) & (i != F.size("lines") - 1)) if merged else falls
    return (
        _keyed(docs)
        .withColumn("hashes", F.transform("lines", lambda x: F.pmod(F.xxhash64(x), F.lit(LINE_MOD))))
        .withColumn("ends", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == F.size("lines")) | counts(i)))
        .drop("hashes")
    )


def _first(no: Column) -> Column:
    """Lines before chunk ``no``."""
    return F.when(no > 0, F.get("ends", no - 1)).otherwise(0)


def _runs(rows: DataFrame, runs: Column, piece) -> DataFrame:
    """(id, dk, ...) of ``runs`` (start, n) of the lines of each of ``rows(id, dk, lines, ...)``, as ``piece(text, start, lines)`` has them."""
    # runs are made before they become rows, so that no row carries the whole text
    made = F.transform(runs, lambda x: piece(F.array_join(F.slice("lines", x["start"] + 1, x["n"]), "\n"), x["start"], x["n"]))
    # an outer explode: else Spark tests for empty arrays first, and works out all of the above for each use of it in that test
    return rows.select("id", "dk", made.alias("pieces")).select("id", "dk", F.explode_outer("pieces").alias("x")).where("x IS NOT NULL").select("id", "dk", "x.*")


def _hashed(text: Column, start: Column, n: Column) -> Column:
    return F.struct(start.alias("start"), n.alias("n"), F.xxhash64(text).alias("h"))


def _later(rows: DataFrame, hashed: DataFrame) -> DataFrame:
    """(id, dk, start, n) of the runs of ``hashed(id, dk, start, n, h)`` over ``rows(id, dk, lines)`` that go: an equal one stands earlier."""
    spark = rows.sparkSession
    since = written(spark)
    hashed = cut(hashed)
    total = hashed.count()
    again = cut(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    # only runs whose hash repeats are compared, byte by byte
    needed = cut(salted_join(hashed, again, "h", "rows", total, "dk").groupBy("id", "dk").agg(F.array_sort(F.collect_set(F.shiftleft(F.col("start").cast("long"), 32) + F.col("n"))).alias("runs")))
    some = rows.select("id", "dk", "lines").join(small_or_merged(needed), ["id", "dk"])
    runs = F.transform("runs", lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("start"), (x % 2**32).cast("int").alias("n")))
    told = lambda text, start, n: F.struct(start.alias("start"), n.alias("n"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("v"), text.alias("run"))
    texts = cut(_runs(some, runs, told))
    at = F.struct("id", "dk", "start")
    same = texts.groupBy("h", "v", "run").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("rows"))
    first = cut(same.groupBy("h", "v").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("texts")).where("rows > 1"))
    found = salted_join(texts.drop("run"), first.where("texts = 1"), ["h", "v"], "rows", total, "dk")
    apart = first.where("texts > 1").select("h", "v")
    if not apart.isEmpty():  # texts that differ though both of their hashes agree: the texts themselves are the key
        mixed = cut(texts.join(apart, ["h", "v"]))
        found = found.select("id", "dk", "start", "n", "first").unionByName(mixed.join(mixed.groupBy("run").agg(F.min(at).alias("first")), "run").select("id", "dk", "start", "n", "first"))
    out = cut(found.where(at > F.col("first")).select("id", "dk", "start", "n"))
    release(spark, since, out)
    return out


def removed_chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, merged: bool = False) -> DataFrame:
    """(id, dk, start, n) of the chunks of more than one line of ``docs(doc_id, text)`` that go: an equal one stands earlier."""
    rows = chunk_arrays(docs, window, divisor, merged)
    chunks = F.transform("ends", lambda end, no: F.struct(_first(no).alias("start"), (end - _first(no)).alias("n")))
    return _later(rows, _runs(rows, F.filter(chunks, lambda x: x["n"] >= LEAST_LINES), _hashed))


def removed_pairs(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, dk, start, n) of the pairs of neighbouring lines of ``docs(doc_id, text)``, none inside a chunk that is ``gone``, that stand earlier.

    Pairs go the way of chunks: hashes are counted, and those that repeat are compared byte by byte. What a removed
    chunk holds stands in the first such chunk too, so leaving it out hides no first place.
    """
    rows = _keyed(docs)
    size = F.greatest(F.size("lines") - 1, F.lit(0))
    pairs = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.struct(i.alias("start"), F.lit(2).alias("n"))))
    inside = gone.select("id", "dk", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 2)).alias("start"))
    return _later(rows, _runs(rows, pairs, _hashed).join(inside, ["id", "dk", "start"], "left_anti"))


def line_dedup(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, every_run: bool = False) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)``, one row for each, with ``clean_text``, ``n_lines``, ``n_removed`` (lines) and ``removed`` (runs of lines from 0, end exclusive).

    A chunk of several lines goes if an equal one stands earlier: in a smaller doc_id (a null id
    first) or earlier in the same document. Rows with equal doc_id and text count as one document and
    share its fate; of one doc_id different texts go by a hash of theirs. A null text stays null and
    has no lines removed; an empty text is one empty line. Lines end at ``\\n`` alone; lines that stay
    are unchanged and joined as they were. Columns of ``docs`` with the names of results are replaced.
    An empty table gives an empty result. With ``every_run`` a line goes also if it and a neighbour
    stand together earlier, in the same order, whatever the chunks. Texts are shuffled
    only where more documents are concerned than a broadcast takes.
    """
    texts = docs.select("doc_id", "text")
    gone = removed_chunks(texts, window, divisor, merged=every_run)
    if every_run:
        gone = gone.unionByName(removed_pairs(texts, gone))
    by_row = gone.groupBy("id", "dk").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))))).alias("gone"))
    rows = docs.drop("clean_text", "n_lines", "n_removed", "removed")
    i, k, g, w = fresh(rows, "span_id", "span_dk", "gone", "work")
    by_row = small_or_merged(cut(by_row.withColumnsRenamed({"id": i, "dk": k, "gone": g})))
    whole = rows.join(by_row, (key_of(True)[0] == F.col(i)) & (key_of(True)[1] == F.col(k)), "left").withColumn(w, _lines(F.col("text")))
    dropped = F.coalesce(F.col(g), F.array().cast("array<int>"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), dropped), lambda n: F.get(w, n))
    # where a run starts and where it ends
    edge = lambda step: F.filter(dropped, lambda n, at: ~F.coalesce(F.get(dropped, at + step) == n + step, F.lit(False)))
    spans = F.zip_with(edge(-1), edge(1), lambda a, b: F.concat_ws(":", a.cast("string"), (b + 1).cast("string")))
    clean = F.when(F.col("text").isNull(), F.lit(None)).when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(w)).cast("long")
    return whole.select(*rows.columns, clean.alias("clean_text"), n_lines.alias("n_lines"), F.size(dropped).cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed"))
