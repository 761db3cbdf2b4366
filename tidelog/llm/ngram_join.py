"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its distinct word shingles; equal word sequences form a class and
enter once. Shingles are dealt by hash, packed, and counted over all classes. A shingle of
one class cannot be shared, so a class with enough of those has no partner at all. The others
index an extended prefix, rarest shingles first: single rare shingles, and pairs of frequent
ones that fall into the same subclass. A prefix is long enough when more signatures must be
destroyed than the threshold allows shingles to differ, so linked sets share a signature.

Sets under one signature are verified against one leader first, the one with the smallest part
of its own; sets that links already connect need no more, and those that are still apart are
verified block by block. Only shared shingles can lie in an intersection, so those alone travel
for the verification. All links lie inside the components, where they are counted, block by block too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import NULL_ID, as_bytes, cut, doc_key, fresh, key_of, labels, mix, numbers, ranges_for, salted_join, small_or_merged, split_words, tidy, word_hashes
from tidelog.llm.components import components
from tidelog.llm.rolling import span_hashes, window_starts
from tidelog.llm.substring_dedup import AT_ONCE, _one, _parts, gathered

WORDS = 5
#: Jaccard similarity from which two sets link, in hundredths.
PERCENT = 75
#: Shingles of fewer than 2**RARE classes index alone; more frequent ones in pairs, from sets of 2**FIRST_LEVEL shingles on.
RARE, FIRST_LEVEL = 5, 4
#: Bytes of text whose shingles one range holds, signatures of one range, members in one row of a group.
RANGE_BYTES, RANGE_SIGNATURES, SEGMENT = 12 << 20, 1_000_000, 4096
#: Sets that are compared with as many others at a time; in how many of them a shingle is frequent, and columns of frequent shingles at a time.
BLOCK, OFTEN, COLUMNS = 2048, 32, 4096


def _sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class of each document, owner, shingle, shingle's second hash): distinct shingles by document and hash."""
    counts, words = split_words(_one(text), lower=True)
    doc, at = window_starts(counts, width)
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < width))  # too short for a shingle: the whole sequence is one
    start, end = np.concatenate([at, first[short]]), np.concatenate([at + width, (first + counts)[short]])
    doc = np.concatenate([doc, short])
    length = (end - start).astype(np.uint64)
    one, two = (mix(span_hashes(h, start, end) + length) for h in word_hashes(words, (3, 4)))
    order = np.lexsort((one, doc))
    doc, one, two = doc[order], one[order], two[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (one[1:] != one[:-1])]) if len(doc) else np.zeros(0, bool)
    ids = (hashlib.blake2b(b" ".join(t.lower().split()), digest_size=8).digest() for t in as_bytes(_one(text)))
    classes = np.frombuffer(b"".join(ids), "<i8").astype(np.int64)
    return classes, doc[new], one[new], two[new]


DEALT = "p int, cls binary, n binary, k binary, f binary, ids binary, dks binary"


def _deal(names: np.ndarray, width: int, at_once: int):
    """Packed rows of one pass over the texts: (p, cls, n, k, f), for each class its size, how many shingles follow, and their hashes;
    and lists of documents (cls, n, ids, dks). The first half of ``names`` are ranges, the rest places of lists."""
    ranges = len(names) // 2

    def run(batches):
        for t in gathered(batches, "text", at_once):
            classes, owner, one, two = _sets(t.column("text"), width)
            n = np.bincount(owner, minlength=len(classes)).astype("<i4")
            home = names[ranges + int(classes[0] % ranges)]
            yield pa.RecordBatch.from_pydict({"p": pa.array([home], pa.int32()), "cls": [classes.tobytes()], "n": [n.tobytes()], "k": [b""], "f": [b""], "ids": [t.column("id").to_numpy().tobytes()], "dks": [t.column("dk").to_numpy().tobytes()]})
            _, first = np.unique(classes, return_index=True)  # copies in one run travel once
            keep = np.isin(owner, first)
            owner, one, two = owner[keep], one[keep], two[keep]
            for p, own in _parts((two % np.uint64(ranges)).astype(np.int32), ranges):
                who, k = np.unique(owner[own], return_counts=True)
                yield pa.RecordBatch.from_pydict({"p": pa.array(names[p : p + 1]), "cls": [classes[who].tobytes()], "n": [n[who].tobytes()], "k": [k.astype("<i4").tobytes()], "f": [one[own].tobytes()], "ids": [b""], "dks": [b""]})

    return run


def _joined(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


SHARED = "home int, cls binary, n binary, k binary, f binary, log binary, ids binary, dks binary"


def _shared(names: np.ndarray):
    """Of one range: the shingles of two classes or more, with the log of their number, by home of the class; lists pass through."""
    ranges, number = len(names) // 2, numbers(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if number[int(pdf["p"].iloc[0])] >= ranges:
            return pdf.assign(home=pdf["p"], log=b"")[["home", "cls", "n", "k", "f", "log", "ids", "dks"]]
        tidy()
        cls, n, k, f = (_joined(pdf[c], kind) for c, kind in (("cls", "<i8"), ("n", "<i4"), ("k", "<i4"), ("f", "<u8")))
        del pdf
        row = np.repeat(np.arange(len(cls), dtype=np.int32), k)
        order = np.argsort(f, kind="stable")
        same = f[order][1:] == f[order][:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        order = order[np.lexsort((cls[row[order]], f[order]))]
        if len(order):  # a class that came from several tasks counts once
            order = order[np.concatenate([[True], (f[order][1:] != f[order][:-1]) | (cls[row[order]][1:] != cls[row[order]][:-1])])]
        _, at, df = np.unique(f[order], return_inverse=True, return_counts=True)
        log = np.frexp(df)[1].astype(np.uint8)[at]  # bits of the number
        order, log = order[df[at] >= 2], log[df[at] >= 2]
        c, f, n = cls[row[order]], f[order], n[row[order]]
        by = np.lexsort((f, c))
        c, f, n, log = c[by], f[by], n[by], log[by]
        out = []
        for home, own in _parts((mix(c.view(np.uint64)) % np.uint64(ranges)).astype(np.int32), ranges):
            who, at, k = np.unique(c[own], return_index=True, return_counts=True)
            out.append((int(names[home]), who.tobytes(), n[own][at].astype("<i4").tobytes(), k.astype("<i4").tobytes(), f[own].tobytes(), log[own].tobytes(), b"", b""))
        return pd.DataFrame(out, columns=["home", "cls", "n", "k", "f", "log", "ids", "dks"])

    return run


def overlap(n, percent: int):
    """Shingles that a set of n must share with any set it links to."""
    return -(-percent * n // 100)


def levels(n: int, percent: int) -> list[int]:
    """Size levels at which a set of n must index, so that linked sets have one in common."""
    own = n.bit_length() - 1
    return [own, own + 1] if 100 * n >= percent * 2 ** (own + 1) else [own]


def signatures(tokens: np.ndarray, log: np.ndarray, n: int, percent: int, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(signature hashes of a set of n shingles, shingles that are left from each on).

    ``tokens`` are the shingles shared with other classes, rarest first. For each level the prefix ends
    where signatures survive any change that the threshold allows to sets of any size. A pair of sets
    needs a shorter one: a signature links it only where, on both sides, as many shingles are left
    as the two must share.
    """
    unshared = n - len(tokens)  # these come first in the order and each covers one
    need = n - overlap(n, percent) + 1 - unshared
    if need <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = mix(tokens)
    n_rare = int(np.searchsorted(log, rare, "right"))
    first = hashed[: min(n_rare, need)]
    sigs, left = [first], [n - unshared - np.arange(len(first))]
    rest = need - n_rare
    if rest <= 0:
        return sigs[0], left[0]
    often, after = hashed[n_rare:], n - unshared - n_rare
    for level in levels(n, percent):
        if level < FIRST_LEVEL:  # too few for combinations
            sigs.append(often[:rest])
            left.append(after - np.arange(len(sigs[-1])))
            continue
        groups = max(1, 2**level // 16)
        sub = (often >> np.uint64(20)) % np.uint64(groups)
        # a subclass of m shingles in the prefix covers m - 1
        by = np.argsort(sub, kind="stable")
        covers = np.ones(len(sub), np.int64)
        covers[by[np.concatenate([[True], sub[by][1:] != sub[by][:-1]])]] = 0
        covered = np.cumsum(covers)
        end = int(np.searchsorted(covered, rest)) + 1
        by = by[by < end]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(sub[by])) + 1, [len(by)]])
        for a, b in zip(edges, edges[1:], strict=False):
            i, j = np.triu_indices(b - a, 1)
            x, y = by[a:b][i], by[a:b][j]
            low, high = np.minimum(often[x], often[y]), np.maximum(often[x], often[y])
            sigs.append(mix(low ^ (high * np.uint64(2 * level + 3))))
            last = np.maximum(x, y)
            left.append(after - (covered[last] - covers[last]))
    sigs, left = np.concatenate(sigs), np.concatenate(left)
    order = np.lexsort((-left, sigs))
    sigs, left = sigs[order], left[order]
    once = np.concatenate([[True], sigs[1:] != sigs[:-1]])
    return sigs[once], left[once]


SETS = "cls long, n long, tokens binary, sigs binary, left binary"
#: ``n`` of rows that list documents: tokens, sigs and left then hold their classes and sizes, ids and dks.
LIST = -1


def _index(names: np.ndarray, percent: int):
    """Of the classes of one home: (cls, n, tokens, sigs, left) where a partner is possible; and the lists."""
    number = numbers(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if number[int(pdf["home"].iloc[0])] >= len(names) // 2:
            both = [c + n for c, n in zip(pdf["cls"], pdf["n"], strict=True)]
            return pd.DataFrame({"cls": 0, "n": LIST, "tokens": both, "sigs": pdf["ids"].to_numpy(), "left": pdf["dks"].to_numpy()})
        tidy()
        cls, n, k, token, log = (_joined(pdf[c], kind) for c, kind in (("cls", "<i8"), ("n", "<i4"), ("k", "<i4"), ("f", "<u8"), ("log", np.uint8)))
        del pdf
        cls, n = np.repeat(cls, k), np.repeat(n, k)
        order = np.lexsort((token, log, cls))
        cls, n, token, log = cls[order], n[order], token[order], log[order]
        who, first = np.unique(cls, return_index=True)
        out = []
        for c, a, b in zip(who, first, [*first[1:], len(cls)], strict=True):
            size = int(n[a])
            sigs, left = signatures(token[a:b], log[a:b], size, percent)
            if len(sigs):
                out.append((int(c), size, np.sort(token[a:b]).tobytes(), sigs.tobytes(), left.astype("<i4").tobytes()))
        return pd.DataFrame(out, columns=["cls", "n", "tokens", "sigs", "left"])

    return run


def _listed(batches):
    """(id, dk, cls, n) of each document on the lists."""
    for b in batches:
        for both, ids, dks in zip(b.column("tokens").to_pylist(), b.column("sigs").to_pylist(), b.column("left").to_pylist(), strict=True):
            m = len(ids) // 8
            cols = np.frombuffer(ids, "<i8"), np.frombuffer(dks, "<i8"), np.frombuffer(both, "<i8", m), np.frombuffer(both, "<i4", m, 8 * m).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "dk", "cls", "n"])


def _deal_signatures(names: np.ndarray):
    """Packed rows (p, sig, cls, n, left, own): ``own`` counts a set's shingles that no other class has."""
    ranges = len(names)

    def run(batches):
        held = []

        def flush():
            sigs, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            for p, at in _parts((mix(sigs) % np.uint64(ranges)).astype(np.int32), ranges):
                cls, *small = (x[at] for x in rest)
                yield pa.RecordBatch.from_pydict({"p": pa.array(names[p : p + 1]), "sig": [sigs[at].tobytes()], "cls": [cls.tobytes()]} | {k: [x.astype("<i4").tobytes()] for k, x in zip(("n", "left", "own"), small, strict=True)})

        size = 0
        for b in batches:
            for r in b.to_pylist():
                sigs, left = np.frombuffer(r["sigs"], "<u8"), np.frombuffer(r["left"], "<i4")
                same = lambda v: np.full(len(sigs), v, np.int64)
                held.append((sigs, same(r["cls"]), same(r["n"]), left, same(r["n"] - r["m"])))
                size += len(sigs)
                if size >= 500_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def may_link(n, m, left, percent: int):
    """Whether sets of n and m shingles can still share enough when ``left`` are left."""
    return (100 + percent) * left >= percent * (n + m)


GROUPS = "key long, part int, a long, na long, ma long, members array<long>, sizes array<long>, shared array<long>"


def _groups(percent: int):
    """Sets of classes under one signature, each different one once, in order of priority: (key, part, leader, its size and shared shingles, members, sizes, shared)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, cls = _joined(pdf["sig"], "<u8"), _joined(pdf["cls"], "<i8")
        n, left, own = (_joined(pdf[k], "<i4").astype(np.int64) for k in ("n", "left", "own"))
        del pdf
        for _ in range(3):  # who cannot link with the smallest set that is large enough has no partner here
            order = np.lexsort((n, sig))
            sig, cls, n, left, own = (x[order] for x in (sig, cls, n, left, own))
            _, rank, count = np.unique(sig, return_inverse=True, return_counts=True)
            place = (rank.astype(np.int64) << 32) + n
            smallest = n[np.searchsorted(place, (rank.astype(np.int64) << 32) + overlap(n, percent))]
            stays = may_link(n, smallest, left, percent) & (count[rank] >= 2)
            sig, cls, n, left, own = (x[stays] for x in (sig, cls, n, left, own))
        # sets with the smallest part of their own come first: the original leads its edited copies
        order = np.lexsort((mix(cls.view(np.uint64)), own * 1024 // np.maximum(n, 1), sig))
        sig, cls, n, own = sig[order], cls[order], n[order], own[order]
        at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)])
        size = np.diff(np.concatenate([at, [len(sig)]]))
        sums = np.add.reduceat(mix(cls.view(np.uint64) + np.uint64(0x51)), at) if len(at) else np.zeros(0, np.uint64)
        two, shared = size >= 2, n - own
        _, once = np.unique(sums[two], return_index=True)  # groups of equal members share this sum
        out = []
        for a, s, key in zip(at[two][once].tolist(), size[two][once].tolist(), sums[two][once].view(np.int64).tolist(), strict=True):
            for part, x in enumerate(range(a, a + s, SEGMENT)):
                own_rows = slice(x, min(x + SEGMENT, a + s))
                out.append((key, part, int(cls[a]), int(n[a]), int(shared[a]), cls[own_rows], n[own_rows], shared[own_rows]))
        return pd.DataFrame(out, columns=["key", "part", "a", "na", "ma", "members", "sizes", "shared"])

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            hit = []
            for x, y, m, n in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("na").to_pylist(), b.column("nb").to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                hit.append(100 * both >= percent * (m + n - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(hit, pa.bool_())], ["a", "b", "hit"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left, right = (sets.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(t)) for k, t in (("a", "x"), ("b", "y")))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y")
    return cut(found.mapInArrow(_verify(percent), "a long, b long, hit boolean").where("hit").select("a", "b"))


def link_classes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the classes that links connect, over ``sets(cls, n, tokens, sigs, left)``."""
    signed = sets.select("cls", "n", "sigs", "left", (F.octet_length("tokens") / 8).cast("int").alias("m"))
    names = labels(ranges_for(sets.agg(F.sum(F.octet_length("sigs") / 8).cast("long")).first()[0] or 0, RANGE_SIGNATURES))
    dealt = signed.mapInArrow(_deal_signatures(names), "p int, sig binary, cls binary, n binary, left binary, own binary")
    groups = cut(dealt.repartition(len(names), "p").groupBy("p").applyInPandas(_groups(percent), GROUPS).dropDuplicates(["key", "part"]))
    # no more than the shingles that other classes have can be in both sets
    near = may_link(F.col("na"), F.col("nb"), F.least("ma", "mb"), percent)
    members = groups.select("key", "a", "na", "ma", F.explode(F.arrays_zip("members", "sizes", "shared")).alias("x"))
    members = members.select("key", "a", "na", "ma", F.col("x.members").alias("b"), F.col("x.sizes").alias("nb"), F.col("x.shared").alias("mb"))
    # the first member leads; the order of priority is the same in all groups, so leaders coincide
    links = verify(cut(members.where((F.col("a") != F.col("b")) & near).select("a", "b").distinct()), sets, percent)
    roots = cut(components(links))
    # groups that links don't connect yet; their rows hold many members each, so none is a hot key
    known = roots.select(F.col("node").alias("b"), "root")
    told = members.join(known, "b", "left").groupBy("key").agg(F.min(F.coalesce("root", "b")).alias("lo"), F.max(F.coalesce("root", "b")).alias("hi"), F.count(F.lit(1)).alias("m"))
    apart = cut(told.where("lo < hi").select("key", "m"))
    rest = groups.join(apart, "key").select("key", "m", F.explode("members").alias("cls"))
    rest = rest.join(known.withColumnRenamed("b", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    more = cut(in_blocks(rest.withColumn("size", F.lit(1).cast("long")), sets, _connect(percent), "a long, b long").distinct())
    if more.isEmpty():
        return roots
    # what is connected already comes as stars
    return components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def in_blocks(rows: DataFrame, sets: DataFrame, compare, schema: str) -> DataFrame:
    """What ``compare`` says of all pairs of sets under one key, over ``rows(key, m, cls, root, size)`` with m rows of a key.

    Members are dealt to blocks of about ``BLOCK``, and each pair of blocks is a task's work: shingles
    travel once for each block of their key, and no pair is written. Keys of few members share tasks.
    """
    rows = cut(rows)
    tasks = ranges_for(rows.count(), 4 * BLOCK)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("task", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "root", "size")
    return met.join(sets.select("cls", "n", "tokens"), "cls").groupBy("task", "i", "j").applyInPandas(_each_key(compare), schema)


def _each_key(compare):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        out = []
        for _, own in pdf.groupby("key", sort=False):
            left, right = own[own["block"] == i], own[own["block"] == j]
            if len(left) and len(right):
                out.append(compare(left, right, i == j))
        return pd.concat(out) if out else pd.DataFrame()

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another; each set has distinct numbers.

    Frequent numbers count as products of 0-1 matrices, the rest pair by pair.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(left) or not len(right):
        return out
    x, y = (np.repeat(np.arange(len(s), dtype=np.int64), [len(t) for t in s]) for s in (left, right))
    tokens, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    p, q = at[: len(x)], at[len(x) :]
    nx, ny = np.bincount(p, minlength=len(tokens)), np.bincount(q, minlength=len(tokens))
    often = np.flatnonzero((nx * ny > OFTEN * np.maximum(nx, ny)) & (nx > 0) & (ny > 0))
    for k in range(0, len(often), COLUMNS):
        place = np.full(len(tokens), -1)
        place[often[k : k + COLUMNS]] = np.arange(len(often[k : k + COLUMNS]))
        made = []
        for of, t, n in ((x, p, len(left)), (y, q, len(right))):
            m = np.zeros((n, len(often[k : k + COLUMNS])), np.float32)
            m[of[place[t] >= 0], place[t][place[t] >= 0]] = 1
            made.append(m)
        out += made[0] @ made[1].T
    seldom = (nx > 0) & (ny > 0)
    seldom[often] = False
    i, j = np.flatnonzero(seldom[p]), np.flatnonzero(seldom[q])
    j = j[np.argsort(q[j], kind="stable")]
    first = np.searchsorted(q[j], p[i])
    n = ny[p[i]]
    other = j[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    out += np.bincount(np.repeat(x[i], n) * len(right) + y[other], minlength=out.size).reshape(out.shape)
    return out


def _hits(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> np.ndarray:
    both = overlaps(*[[np.frombuffer(t, "<u8") for t in x["tokens"]] for x in (left, right)]).astype(np.int64)
    n, m = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None]
    hit = 100 * both >= percent * (n + m - both)
    return hit & (left["cls"].to_numpy()[:, None] != right["cls"].to_numpy()[None])


def _connect(percent: int):
    """Links (a, b) that connect what is still apart: of many between two connected parts, one."""

    def run(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        hit = _hits(left, right, percent)
        _, root = np.unique(np.concatenate([left["root"], right["root"]]), return_inverse=True)
        a, b, out = left["cls"].to_numpy(), right["cls"].to_numpy(), []
        while True:
            x, y = root[: len(left)], root[len(left) :]
            i, j = np.nonzero(hit & (x[:, None] != y[None]))
            if not len(i):
                return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])
            # each part gives one of its links and takes the least number of the two
            _, once = np.unique(x[i], return_index=True)
            i, j = i[once], j[once]
            out.append(np.stack([a[i], b[j]], 1))
            for p, q in zip(i.tolist(), (len(left) + j).tolist(), strict=True):
                root[root == max(root[p], root[q])] = min(root[p], root[q])

    return run


def _count(percent: int):
    """(cls, links): for each set the documents of the sets it links to."""

    def run(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        hit = _hits(left, right, percent)
        out = [pd.DataFrame({"cls": left["cls"].to_numpy(), "links": hit @ right["size"].to_numpy()})]
        if not same:
            out.append(pd.DataFrame({"cls": right["cls"].to_numpy(), "links": hit.T @ left["size"].to_numpy()}))
        return pd.concat(out)

    return run


def _components(docs: DataFrame, width: int, percent: int, at_once: int, range_bytes: int, links: bool) -> tuple[DataFrame, DataFrame, bool]:
    """(documents (id, dk, cls, n); classes with words (cls, size, class_id, root, component_id[, links]); whether dk is in use)."""
    keyed, size, two = doc_key(docs.select("doc_id", "text"))
    names = labels(2 * ranges_for(size, range_bytes))
    dealt = keyed.select("id", "dk", "text").mapInArrow(_deal(names, width, at_once), DEALT)
    shared = dealt.repartition(len(names), "p").groupBy("p").applyInPandas(_shared(names), SHARED)
    made = cut(shared.repartition(len(names), "home").groupBy("home").applyInPandas(_index(names, percent), SETS))
    sets = made.where(F.col("n") >= 0)
    listed = cut(made.where(F.col("n") == LIST).select("tokens", "sigs", "left").mapInArrow(_listed, "id long, dk long, cls long, n long"))
    roots = link_classes(sets, percent)
    known = F.when(F.col("id") != NULL_ID, F.col("id"))
    classes = cut(listed.where("n > 0").groupBy("cls").agg(F.min(known).alias("class_id"), F.count(F.lit(1)).alias("size")))
    named = cut(classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    lowest = named.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = cut(named.join(lowest, "root"))
    if links:
        inside = named.where("m > 1").select(F.col("root").alias("key"), "m", "cls", "root", "size")
        counted = in_blocks(inside, sets, _count(percent), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))
        named = cut(named.join(counted, "cls", "left"))
    return listed, named, two


def ngram_join(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, at_once: int = AT_ONCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id, class_id, n_links.

    A-Z are lowered; words are runs of other characters than ``[\\x20\\x09-\\x0D]``. A document's set
    holds its distinct shingles of ``width`` words, or its whole sequence if it has fewer. Two
    documents link when 100 * intersection >= percent * union; a component takes the smallest doc_id
    that links reach. ``class_id`` is the smallest doc_id with the same words, ``n_links`` the number
    of other rows that a row links to. A null or blank text has an empty
    set and is linked with nothing: it is its own component, even where several rows carry that
    doc_id. A null doc_id never names a component unless all its members are null. Repeated rows
    each get a row. Extra columns are ignored; an empty table gives an empty result. Shingles are
    64-bit hashes, at every size and in every session.
    """
    listed, named, _ = _components(docs, width, percent, at_once, range_bytes, True)
    doc_id = F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id")
    links = (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    full = listed.where("n > 0").join(named, "cls").select(doc_id, F.col("n").alias("n_shingles"), "component_id", "class_id", links)
    return full.unionByName(listed.where("n = 0").select(doc_id, F.col("n").alias("n_shingles"), doc_id.alias("component_id"), doc_id.alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, at_once: int = AT_ONCE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` without all but one of each component; all columns stay.

    The row with the smallest doc_id stays (a null id last, and of one doc_id the text with the
    smallest hash); of rows that agree in doc_id and text any one. Rows with a null or blank text are
    linked with nothing and stay, repeated ones too. Whole documents are shuffled only where the list of
    those that go is too long to broadcast.
    """
    listed, named, two = _components(docs, width, percent, at_once, range_bytes, False)
    of = listed.where("n > 0").join(named.select("cls", "root"), "cls")
    place = F.struct((F.col("id") == NULL_ID).alias("z"), "id", "dk")
    best = cut(of.groupBy("root").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("m")))
    rows = of.groupBy("root", "id", "dk").agg(F.count(F.lit(1)).alias("n"))
    told = cut(salted_join(rows, best, "root", "m", listed.count(), "id").select("id", "dk", "n", (place == F.col("best")).alias("stays")))
    gone = told.where("NOT stays").select("id", "dk")
    again = told.where("stays AND n > 1").select("id", "dk")
    i, k = fresh(docs, "gone_id", "gone_dk")
    on = lambda: (key_of(two)[0] == F.col(i)) & (key_of(two)[1] == F.col(k))
    kept = docs.join(small_or_merged(gone.withColumnsRenamed({"id": i, "dk": k})), on(), "left_anti")
    if again.isEmpty():
        return kept
    again = small_or_merged(again.withColumnsRenamed({"id": i, "dk": k}))
    return kept.join(again, on(), "left_anti").unionByName(kept.join(again, on()).dropDuplicates([i, k]).select(*docs.columns))
