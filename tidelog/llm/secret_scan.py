"""Secret scan with multipart credential linking, in DataFrame functions alone.

Strong patterns always report. Access identifiers, endpoints and weak secrets are candidates
that report only where a complementary part lies within the same scope. Candidates become rows
(start, end) and a sweep in order of position joins each interval with the nearest one of the
other side, so no pairs are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The patterns of the base spans. A hit is taken by the pattern, then dropped if too short.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
LEAST_SECRET = 8

# Candidates of the linking. No part of a pattern can take what another part of it gave back, so a text is read in linear time.
IDENT = r"""(?i:user|username|login|client_?id|account)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@._-]{3,}+|\b(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}+"""
ENDPOINT = r"""\b[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]{3,}+"""
WEAK = r"""\b(?i:pass|pwd|pw|key|auth|bearer)["']?(?:\x20*+[:=]|\x20)\x20*+["']?(?=[A-Za-z+/_.-]*+[0-9])[A-Za-z0-9+/_.=-]{6,}+"""
#: A bare secret: a whole run of such characters, with a digit and a capital.
BARE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+"

#: Kinds in the order in which ties are listed, and the side of a credential each is.
KINDS = ("assign", "access", "hex", "endpoint", "ident", "weak")
BASE = 3
SECRET_SIDE, NAME_SIDE = ("assign", "hex", "weak"), ("access", "ident", "endpoint")
#: Code points between the parts of one credential at most.
SCOPE = 256


MARK, END = "\x01", "\x02"


def _hits(text: Column, no: int, pattern: str, guard: Column, group: int = 0) -> Column:
    """Hits of one pattern as (pattern's number, place, gap before it, length, length of its group, whether it may count).

    One pass marks the hits, so that plain splits tell their lengths and those of the gaps; the marks'
    characters in the text itself are changed first for one that all patterns treat alike.
    """
    marked = F.regexp_replace(F.translate(text, MARK + END, "\x03\x03"), F.lit(pattern), F.lit(f"{MARK}$0{END}" + (f"${group}{END}" if group else "")))
    parts = F.split(marked, MARK, -1)
    gap = lambda x: F.length(F.substring_index(x, END, -1))

    def row(x, i):
        hit = F.substring_index(x, END, 1)
        good = hit.rlike("[0-9]") & hit.rlike("[A-Z]") if pattern == BARE else F.lit(True)
        value = F.substring_index(F.substring_index(x, END, 2), END, -1) if group else hit
        return F.struct(F.lit(no).alias("pattern"), i.alias("no"), gap(F.get(parts, i)).alias("gap"), F.length(hit).alias("len"), F.length(value).alias("value_len"), good.alias("good"))

    return F.when(guard, F.transform(F.slice(parts, 2, F.size(parts) - 1), row)).otherwise(F.array().cast("array<struct<pattern:int,no:int,gap:int,len:int,value_len:int,good:boolean>>"))


def candidates(docs: DataFrame) -> DataFrame:
    """Rows (rid, doc_id, kind, bare, start, end) of all hits, a document without one as a row of nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    has = lambda where, *parts: reduce(lambda a, b: a | b, [where.contains(p) for p in parts])
    parts = F.concat(
        _hits(text, 0, ASSIGN, has(low, "passw", "secret", "token", "apikey", "api_key"), 2),
        _hits(text, 1, ACCESS, text.contains("AKIA")),
        _hits(text, 2, HEX, text.rlike("(?<![0-9a-f])[0-9a-f]{32}")),
        _hits(text, 3, ENDPOINT, text.contains("://")),
        _hits(text, 4, IDENT, has(low, "user", "login", "client", "account") | has(text, "ASIA", "AIDA", "AROA")),
        _hits(text, 5, WEAK, has(low, "pass", "pwd", "pw", "key", "auth", "bearer")),
        _hits(text, 6, BARE, text.rlike("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}")),
    )
    # numbered before the hits become rows, each of which would get a number else
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), parts.alias("parts"))
    rows = numbered.select("rid", "doc_id", F.explode_outer("parts").alias("p")).select("rid", "doc_id", "p.*")
    upto = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("rid", "pattern").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.repartition("rid").withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.col("len"))
    counts = F.col("pattern").isNull() | F.col("good") & ((F.col("pattern") != 0) | (F.col("value_len") >= LEAST_SECRET))
    # a document all of whose hits were dropped still needs its row
    kept = F.when(counts, F.least("pattern", F.lit(KINDS.index("weak"))))
    return rows.select("rid", "doc_id", kept.alias("kind"), (F.col("pattern") == 6).alias("bare"), F.when(counts, F.col("start")).alias("start"), F.when(counts, F.col("end")).alias("end"))


def link(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Adds ``linked``: whether a part of the other side lies within ``scope`` code points; and ``inside``: whether a base span overlaps, or a weak secret begins before a bare one and covers it."""
    forth = Window.partitionBy("rid").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    side = lambda names: F.col("kind").isin([KINDS.index(k) for k in names])
    which = {"s": side(SECRET_SIDE), "n": side(NAME_SIDE), "b": F.col("kind") < BASE, "w": side(["weak"]) & ~F.col("bare")}
    rows = rows.select("*", *[F.max(F.when(c, F.col("end"))).over(forth).alias(f"{k}_end") for k, c in which.items()])
    rows = rows.select("*", *[F.min(F.when(c, F.col("start"))).over(back).alias(f"{k}_start") for k, c in which.items() if k != "w"])
    near = lambda name: F.coalesce(F.col("start") - F.col(f"{name}_end") <= scope, F.lit(False)) | F.coalesce(F.col(f"{name}_start") - F.col("end") <= scope, F.lit(False))
    linked = F.when(side(SECRET_SIDE), near("n")).otherwise(near("s"))
    inside = F.coalesce(F.col("b_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("b_start") < F.col("end"), F.lit(False)) | F.col("bare") & F.coalesce(F.col("w_end") > F.col("start"), F.lit(False))
    return rows.withColumn("linked", linked).withColumn("inside", inside)


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Spans are ``kind:start:end`` over code points, end exclusive, by start and then kind. Base
    spans always report; an endpoint, identifier or weak secret reports when a complementary
    part lies within ``scope`` and no base span overlaps it. A null text counts as empty and has no spans; repeated
    rows are scanned each for itself; extra columns are ignored; an empty table gives an empty
    result. Whole texts are read, of any length, in time linear in it; secrets have no greatest length.
    """
    rows = link(candidates(docs), scope)
    base = F.col("kind") < BASE
    shown = base | F.coalesce(F.col("linked") & ~F.col("inside"), F.lit(False))
    of = lambda which: F.sort_array(F.collect_list(F.when(which, F.struct("start", "kind", "end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda k: F.count_if(F.col("kind") == KINDS.index(k)).alias(f"n_{k}")
    return (
        rows.groupBy("rid")
        .agg(F.first("doc_id").alias("doc_id"), n("assign"), n("access"), n("hex"), of(base).alias("b"), of(shown).alias("a"), F.count_if(shown & ~base).alias("n_linked"))
        .select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(said(F.col("b")), 256).alias("base_sha256"), said(F.col("a")).alias("spans"), "n_linked")
    )
