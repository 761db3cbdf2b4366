"""Language identification with hyperdimensional profiles.

Each letter has a random vector of signs. An n-gram's vector binds its letters' vectors,
permuted by their place, by elementwise product; a text bundles its n-grams' vectors by sum.
A language's prototype bundles all its training texts, and a text goes to the prototype with
the highest cosine. As bundling is linear, a text's products with the prototypes are sums of
its n-grams' products, which are computed once for each different n-gram.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions, letters per n-gram (3 are packed into one code), and symbols: 0 no letter, a to z, and hashed others.
DIMENSIONS, SYMBOLS = 2048, 128
CODES = SYMBOLS**3
#: Codes of one language travel in so many ranges.
SLICES = 32
AT_ONCE = 1 << 20
UNKNOWN = "und"


def _symbol(c: str) -> int:
    if not c.isalpha():
        return 0
    c = c.lower()[0]
    return ord(c) - 96 if "a" <= c <= "z" else 27 + zlib.crc32(c.encode()) % (SYMBOLS - 27)


@lru_cache(1)
def _table() -> np.ndarray:
    """Symbol of each code point of the basic plane."""
    return np.array([0 if 0xD800 <= i < 0xE000 else _symbol(chr(i)) for i in range(1 << 16)], np.uint8)


def _symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    out = _table()[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    for i in far:
        out[i] = _symbol(chr(points[i]))
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of each letter with its neighbours; a neighbour that isn't a letter is 0."""
    parts = [_symbols(t) for t in texts]
    flat = np.zeros(sum(len(p) for p in parts) + len(parts) + 1, np.int32)
    owner, at = np.zeros(len(flat), np.int32), 1
    for i, p in enumerate(parts):
        flat[at : at + len(p)] = p
        owner[at : at + len(p)] = i
        at += len(p) + 1
    mid = np.flatnonzero(flat)
    return owner[mid], (flat[mid - 1] * SYMBOLS + flat[mid]) * SYMBOLS + flat[mid + 1]


def is_held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def _pieces(texts: list[str | None]):
    """Indices of texts, in runs of about a million characters."""
    held, n = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        n += len(t or "")
        if n >= AT_ONCE:
            yield held
            held, n = [], 0
    if held:
        yield held


def _count(batches):
    """Counts of n-grams by language over a task's training texts."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(lang: str, codes: np.ndarray, n: np.ndarray) -> None:
        parts = held.setdefault(lang, [])
        parts.append((codes, n))
        if len(parts) > 8:  # memory follows the different n-grams, not the possible ones
            parts[:] = [_sum(parts)]

    for b in batches:
        for run in _pieces(texts := b.column("text").to_pylist()):
            ids, langs = b.column("doc_id").to_pylist(), b.column("lang").to_pylist()
            use = [i for i in run if texts[i] and langs[i] is not None and not is_held_out(ids[i])]
            owner, codes = trigrams([texts[i] for i in use])
            of = np.array([langs[i] for i in use], object)
            for lang in set(of.tolist()):
                add(lang, *np.unique(codes[(of == lang)[owner]], return_counts=True))
    for lang, parts in held.items():
        seen, n = _sum(parts)
        for k in range(SLICES):
            own = seen % SLICES == k
            if own.any():
                yield pa.RecordBatch.from_pydict({"lang": [lang], "slice": pa.array([k], pa.int32()), "codes": [seen[own].astype("<i4").tobytes()], "counts": [n[own].astype("<i8").tobytes()]})


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    out = np.zeros(len(codes), np.int64)
    np.add.at(out, at, np.concatenate([n for _, n in parts]))
    return codes, out


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    codes = np.concatenate([np.frombuffer(x, "<i4") for x in pdf["codes"]])
    counts = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["counts"]])
    own, at = np.unique(codes, return_inverse=True)
    return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "codes": [own.astype("<i4").tobytes()], "counts": [np.bincount(at, counts).astype("<i8").tobytes()]})


@lru_cache(4)
def letters(seed: int, dimensions: int) -> np.ndarray:
    """A random vector of signs for each symbol."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))


def gram_vectors(codes: np.ndarray, seed: int, dimensions: int) -> np.ndarray:
    """Vectors of n-grams: letters' vectors, rolled by their place, bound by product."""
    v = letters(seed, dimensions)
    a, b, c = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]


def learn(docs: DataFrame, seed: int = 5, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """(languages in order, their prototypes of length 1) from all training rows of ``docs(doc_id, text, lang)``.

    The driver gets the counts of each language's different n-grams: at most ``CODES`` numbers each.
    """
    rows = docs.select("doc_id", "text", "lang").mapInArrow(_count, "lang string, slice int, codes binary, counts binary")
    sums: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang", "slice").applyInPandas(_add, "lang string, codes binary, counts binary").toLocalIterator():
        codes, counts = np.frombuffer(r.codes, "<i4"), np.frombuffer(r.counts, "<i8").astype(np.float64)
        out = sums.setdefault(r.lang, np.zeros(dimensions))
        for i in range(0, len(codes), 4096):
            out += counts[i : i + 4096] @ gram_vectors(codes[i : i + 4096], seed, dimensions)
    langs = sorted(sums)
    made = np.array([sums[x] / np.linalg.norm(sums[x]) for x in langs]).reshape(len(langs), dimensions)
    if len(langs) > 1:  # what all languages share tells nothing
        made = made - made.mean(0)
        made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
    return langs, made.astype(np.float32)


def _predict(langs: list[str], made: np.ndarray, seed: int):
    def run(batches):
        place, dots = np.full(CODES, -1, np.int32), np.zeros((0, len(langs)), np.float32)  # products of the n-grams seen so far
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for run in _pieces(texts):
                owner, codes = trigrams([texts[i] or "" for i in run])
                if not len(codes) or not langs:
                    continue
                new = np.unique(codes)
                new = new[place[new] < 0]
                place[new] = len(dots) + np.arange(len(new))
                dots = np.concatenate([dots, *[gram_vectors(new[i : i + 4096], seed, made.shape[1]).astype(np.float32) @ made.T for i in range(0, len(new), 4096)]])
                at = place[codes]
                sums = np.stack([np.bincount(owner, dots[at, k], len(run)) for k in range(len(langs))], 1)
                has = np.bincount(owner, minlength=len(run)) > 0
                for j, i in enumerate(run):
                    if has[j]:
                        k = int(sums[j].argmax())
                        best[i], score[i] = langs[k], _margin(sums[j], k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([is_held_out(i) for i in ids]), pa.array(best), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _margin(sums: np.ndarray, k: int) -> float:
    """How far the best cosine lies above the second, from 0 to 1, among cosines scaled to length 1; a text's own length cancels out."""
    if len(sums) < 2:
        return 1.0
    return float(np.clip((sums[k] - np.partition(sums, -2)[-2]) / max(1e-12, np.sqrt(2) * np.linalg.norm(sums)), 0, 1))


def identify_language(docs: DataFrame, seed: int = 5, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, lang, ...)``: doc_id, held_out, lang_pred, score.

    Prototypes come from rows with text and lang whose crc32(doc_id as text) mod 4 is not 2; a
    prediction sees the text alone. A text that is null or without a letter, and any text
    where nothing could be learned, is ``und`` with score 0. Of equal cosines the first language
    by name wins. Whole texts are read. Repeated rows each get a row; extra columns are ignored;
    an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    langs, made = learn(rows, seed, dimensions)
    return rows.select("doc_id", "text").mapInArrow(_predict(langs, made, seed), "doc_id long, held_out boolean, lang_pred string, score double")
