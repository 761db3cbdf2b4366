"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or not at all on each document. Counts of the
vote patterns of all documents, a bounded table, feed an expectation-maximisation that
estimates each labeller's accuracies and the posterior of each pattern. Posterior labels of a
bounded sample train a linear scorer on hashed word shapes, which then scores every document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, mix, split_words
from tidelog.llm.rolling import span_hashes
from tidelog.llm.substring_dedup import AT_ONCE, _one, gathered

#: Hashed features, documents that train the scorer at most (the ones with the smallest hashes of their ids), and features of one of them (the heaviest).
FEATURES, SAMPLE, MOST_FEATURES = 1 << 13, 20_000, 1024
ABSTAIN, GOOD, BAD = 0, 1, 2
#: Words from which shares mean something.
LEAST_WORDS = 20

# Classes of bytes: upper and lower case letters, digits and symbols; the first byte of a longer character counts as a lower case letter.
_REST, _UPPER, _LOWER, _DIGIT, _SYMBOL = range(5)
_CLASS = np.full(256, _LOWER, np.uint8)
_CLASS[:128] = _SYMBOL
_CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("a") : ord("z") + 1], _CLASS[ord("0") : ord("9") + 1] = _UPPER, _LOWER, _DIGIT
_CLASS[0x80:0xC0] = _REST


def _is(*chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_QUOTES, _STOPS, _TAIL = _is(*"\"')]"), _is(*".!?"), _is(*".,;:")


def describe(words: pa.Array) -> dict[str, np.ndarray]:
    """For each word: letters, letters or digits, symbols, whether it is in upper case, ends a sentence, is short; length and hashed shape.

    A shape has a sign for each run of letters of one case, of digits, or of one symbol.
    """
    if not len(words):
        return {k: np.zeros(0, np.int64) for k in ("plain", "symbols", "upper", "ends", "short", "length", "shape")}
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    kind = _CLASS[raw].copy()
    wide = np.flatnonzero(raw[:-1] == 0xC3)
    kind[wide[raw[wide + 1] <= 0x9E]] = _UPPER  # accented capitals of Latin 1
    each = lambda x: np.add.reduceat(x.astype(np.int64), start)  # noqa: E731  no word is empty
    upper, symbols, digits, points = each(kind == _UPPER), each(kind == _SYMBOL), each(kind == _DIGIT), each(kind != _REST)
    letters = points - symbols - digits

    def back(over, times):
        """Last byte of each word before up to so many of some characters."""
        at = end - 1
        for _ in range(times):
            at = at - (over[raw[at]] & (at > start))
        return at

    whole = kind != _REST
    sign = np.where(kind == _SYMBOL, raw.astype(np.uint64) + np.uint64(10), kind.astype(np.uint64))[whole]
    of = np.repeat(np.arange(len(words)), end - start)[whole]
    new = np.concatenate([[True], (sign[1:] != sign[:-1]) | (of[1:] != of[:-1])])
    sign, of = sign[new], of[new]
    n = np.bincount(of, minlength=len(words))
    last = np.cumsum(n)
    tail = end - 1 - back(_TAIL, 2)
    return {
        "plain": letters + digits,
        "symbols": symbols,
        "upper": (letters > 1) & (upper == letters),
        "ends": _STOPS[raw[back(_QUOTES, 2)]],
        "short": (letters > 0) & (letters <= 3) & (points - tail == letters),
        "length": np.minimum(points, 64),
        "shape": (mix(span_hashes(mix(sign), last - n, last)) % np.uint64(FEATURES)).astype(np.int64),
    }


def statistics(text: pa.Array) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """(shares by document, document of each word, hashed shape of each word)."""
    counts, words = split_words(text, lower=False)
    coded = pc.dictionary_encode(words)
    at = coded.indices.to_numpy()
    known = describe(coded.dictionary)
    plain, symbols, upper, ends, short, length, shape = (known[k][at] for k in ("plain", "symbols", "upper", "ends", "short", "length", "shape"))
    doc = np.repeat(np.arange(len(counts)), counts)
    n = np.maximum(counts, 1)
    share = lambda x: np.bincount(doc, x, len(counts)) / n
    again = np.zeros(len(at), bool)
    again[1:] = (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])
    size = max(1, len(coded.dictionary))
    distinct = np.bincount(np.unique(doc.astype(np.int64) * size + at) // size, minlength=len(counts))
    out = {
        "n": counts,
        "noisy": share(symbols >= 2),
        "lone": share((plain == 0) & (symbols > 0)),
        "upper": share(upper),
        "again": share(again),
        "ends": share(ends),
        "short": share(short),
        "length": share(length),
        "distinct": distinct / n**0.8,
    }
    return pd.DataFrame(out), doc, shape


def votes(s: pd.DataFrame) -> np.ndarray:
    """A row of votes for each document; texts of few words get votes on what few words can show, and blank ones none."""
    enough, some = s["n"] >= LEAST_WORDS, s["n"] > 0

    def vote(good, bad, when=True):
        return np.where(when & some & bad, BAD, np.where(when & some & good, GOOD, ABSTAIN))

    return np.stack(
        [
            vote(s["noisy"] < 0.05, s["noisy"] > 0.2),
            vote(s["lone"] < 0.03, s["lone"] > 0.15),
            vote(s["upper"] < 0.1, s["upper"] > 0.3),
            vote(s["again"] < 0.03, s["again"] > 0.2),
            vote(s["ends"].between(0.02, 0.3), (s["ends"] < 0.005) | (s["ends"] > 0.6), enough),
            vote(s["short"] > 0.15, s["short"] < 0.08, enough),
            vote(s["length"].between(3, 8), (s["length"] < 2) | (s["length"] > 15), enough),
            vote(s["distinct"] > 0.7, s["distinct"] < 0.25, enough),
        ],
        1,
    )


BINNED = ("noisy", "lone", "upper", "again", "ends", "short", "distinct")


def features(s: pd.DataFrame, doc: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of unit length, as (document, feature, value): roots of the shares of word shapes, and binned shares."""
    key, n = np.unique(doc.astype(np.int64) * FEATURES + shape, return_counts=True)
    d, f = key // FEATURES, key % FEATURES
    v = np.sqrt(n / np.maximum(s["n"].to_numpy()[d], 1))
    all_docs = np.arange(len(s))
    for name in BINNED:
        bins = np.searchsorted([0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6], s[name])
        own = np.array([zlib.crc32(f"{name}:{i}".encode()) % FEATURES for i in range(10)])
        d, f, v = np.concatenate([d, all_docs]), np.concatenate([f, own[bins]]), np.concatenate([v, np.full(len(s), 0.5)])
    norm = np.sqrt(np.bincount(d, v * v, len(s)))
    return d, f, v / norm[d]


def _vote(threshold: int):
    """(doc_id, pattern, feats, values): features only of documents whose hash lies below the threshold."""

    def run(batches):
        for t in gathered(batches, "text", AT_ONCE // 2):
            s, doc, shape = statistics(_one(t.column("text")))
            pattern = votes(s) @ (3 ** np.arange(8))
            chosen = (t.column("h").to_numpy() < threshold) & (pattern > 0)
            feats, values = [None] * len(s), [None] * len(s)
            own = np.flatnonzero(chosen)
            if len(own):
                of = np.full(len(s), -1)
                of[own] = np.arange(len(own))
                d, f, v = features(s.iloc[own].reset_index(drop=True), of[doc][chosen[doc]], shape[chosen[doc]])
                order = np.lexsort((-v, d))
                d, f, v = d[order], f[order], v[order]
                edges = np.searchsorted(d, np.arange(len(own) + 1))
                for i, a, b in zip(own, edges, edges[1:], strict=False):
                    b = min(b, a + MOST_FEATURES)
                    feats[i], values[i] = f[a:b].astype("<i4").tobytes(), (v[a:b] / np.sqrt((v[a:b] ** 2).sum())).astype("<f4").tobytes()
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(pattern.astype(np.int32)), "h": pa.array(t.column("h").to_numpy()), "feats": pa.array(feats, pa.binary()), "vals": pa.array(values, pa.binary())})

    return run


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, P(vote | class) as labeller x class x vote, prior of good).

    ``patterns`` holds a row of votes for each different pattern. Class 0 is bad and class 1 good, as it
    starts from the belief that a vote against is likely right: a document is mostly bad in one way
    alone, and a labeller that cries wolf is found out. Smoothing keeps each chance above 0.
    Not to vote says nothing: short texts abstain for want of words, whatever their class.
    """
    bad = (patterns == BAD).sum(1)
    q = np.where(bad == 0, 0.95, 0.3 / np.maximum(bad, 1))
    total = max(counts.sum(), 1)
    chances = np.ones((patterns.shape[1], 2, 3))
    prior = 0.5
    for _ in range(rounds):
        w = np.stack([counts * (1 - q), counts * q], 1)
        prior = float(np.clip(w[:, 1].sum() / total, 0.01, 0.99))
        for j in range(patterns.shape[1]):
            seen = np.stack([w[patterns[:, j] == v].sum(0) for v in (GOOD, BAD)], 1) + 0.5
            chances[j, :, GOOD:] = seen / seen.sum(1, keepdims=True)
        log = np.log([1 - prior, prior]) + sum(np.log(chances[j][:, patterns[:, j]]).T for j in range(patterns.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - q).max(initial=0) < 1e-9:
            return new, chances, prior
        q = new
    return q, chances, prior


def train(feats: list[bytes], values: list[bytes], target: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer (the last is the intercept) by accelerated gradient descent; both classes weigh the same."""
    weights = np.zeros(FEATURES + 1)
    if not len(target):
        return weights
    row = np.repeat(np.arange(len(target)), [len(f) // 4 for f in feats])
    f, v = np.frombuffer(b"".join(feats), "<i4"), np.frombuffer(b"".join(values), "<f4").astype(np.float64)
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    cost = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
    cost /= cost.sum()
    ahead, step = weights.copy(), 4.0
    for k in range(rounds):
        z = np.bincount(row, v * ahead[f], len(target)) + ahead[-1]
        error = cost * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        grad = np.concatenate([np.bincount(f, v * error[row], FEATURES), [error.sum()]]) + ridge * ahead
        new = ahead - step * grad
        ahead = new + k / (k + 3) * (new - weights)
        weights = new
    return weights


def _score(weights):
    def run(batches):
        w = weights.value
        for t in gathered(batches, "text", AT_ONCE // 2):
            s, doc, shape = statistics(_one(t.column("text")))
            d, f, v = features(s, doc, shape)
            z = np.bincount(d, v * w[f], len(s)) + w[-1]
            score = np.where(s["n"] > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
            t = t.append_column("quality_score", pa.array(score)).append_column("quality_votes", pa.array((votes(s) @ (3 ** np.arange(8))).astype(np.int32)))
            yield from t.combine_chunks().to_batches()

    return run


def classify_quality(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)``, one row for each, with ``quality_score`` (0 to 1), ``weak_posterior`` and ``keep``.

    ``keep`` is whether the score reaches ``least``. A null or blank text scores 0 and goes; it gets no
    vote, so its posterior is the prior, and it trains nothing. Votes of all other rows set the
    labellers' accuracies; ``sample`` bounds the rows that train the scorer, chosen by a hash of the
    id, and ``MOST_FEATURES`` the features of each, so that the driver holds some 160 MB at most. Repeated rows each get a row. Columns of ``docs`` with the names of results
    are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = ("quality_score", "quality_votes", "weak_posterior", "keep")
    rows = docs.drop(*own)
    keyed = rows.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 40)).alias("h"), "text")
    n = rows.count()
    threshold = min(1 << 40, (1 << 40) * sample * 11 // 10 // max(n, 1))
    voted = cut(keyed.mapInArrow(_vote(threshold), "pattern int, h long, feats binary, vals binary"))
    counted = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most 3**8 rows
    counted = counted[counted["pattern"] > 0]  # a document without a vote says nothing of the labellers
    patterns = counted["pattern"].to_numpy()[:, None] // 3 ** np.arange(8) % 3
    posterior, _, prior = expectation_maximisation(patterns, counted["n"].to_numpy(np.float64))
    by_pattern = np.full(3**8, prior)
    by_pattern[counted["pattern"].to_numpy(np.int64)] = posterior
    chosen = voted.where(F.col("feats").isNotNull()).orderBy("h").limit(sample).toPandas()
    weights = spark.sparkContext.broadcast(train(list(chosen["feats"]), list(chosen["vals"]), by_pattern[chosen["pattern"].to_numpy(np.int64)]))
    table = spark.createDataFrame([(i, float(p)) for i, p in enumerate(by_pattern.tolist())], "quality_votes int, weak_posterior double")
    schema = rows.withColumn("quality_score", F.lit(0.0)).withColumn("quality_votes", F.lit(0)).schema
    scored = rows.mapInArrow(_score(weights), schema).join(F.broadcast(table), "quality_votes")  # 3**8 rows
    return scored.select(*rows.columns, "quality_score", "weak_posterior", (F.col("quality_score") >= least).alias("keep"))
