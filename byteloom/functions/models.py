"""Bigram models of (language, encoding), trained from text tables, and cosine scores under them.

Character pairs of each language are counted over all texts with one map-side aggregation; the PAIRS
commonest a language are kept (the size of the model, not a sample). A pair's bytes under an encoding give
that encoding's byte bigrams, so one pass over the text serves every encoding of the registry.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from byteloom.functions import charset as C
from byteloom.functions.registry import REGISTRY

PAIRS, FLUSH = 1 << 13, 1 << 18
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0xA0)
#: Bytes that are scored, and bytes that languages are told from.
SCORE_BYTES, LANGUAGE_BYTES = 16_384, 2048
# Rare languages, and the lead that they need in thin texts.
RARE, THIN_WITHIN = ("gd", "cy", "ga", "br"), 0.03


@dataclass
class Models:
    """One row of weights (0 to 255 a byte bigram) for each of keys, their norms, and the bigrams' own weights."""

    keys: list[tuple[str, str]]
    weights: np.ndarray
    norms: np.ndarray
    idf: np.ndarray

    def __post_init__(self) -> None:
        self.rows: dict[str, np.ndarray] = {}
        for encoding in {e for _, e in self.keys}:
            self.rows[encoding] = np.array([k for k, (_, e) in enumerate(self.keys) if e == encoding])

    def best(self, data: bytes, encodings: list[str]) -> dict[str, tuple[float, str]]:
        """encoding -> its best language's cosine and that language, the earlier model on ties, where above 0."""
        seen, values = profile(data, self.idf)
        length = float(np.sqrt((values * values).sum()))
        known = [e for e in encodings if e in self.rows]
        if length == 0 or not known:
            return {}
        rows = np.concatenate([self.rows[e] for e in known])
        dots = self.weights[np.ix_(rows, seen)].astype(np.int64) @ values
        scores, out, at = dots / (self.norms[rows] * length), {}, 0
        for e in known:
            n = len(self.rows[e])
            k = at + int(scores[at : at + n].argmax())
            if scores[k] > 0:
                out[e] = (float(scores[k]), self.keys[rows[k]][0])
            at += n
        return out

    def languages(self, encoding: str) -> frozenset[str]:
        """The languages that have a model under an encoding."""
        return frozenset(self.keys[k][0] for k in self.rows.get(encoding, ()))

    def rows_of(self, encoding: str, languages: frozenset[str] | None = None) -> np.ndarray:
        """Rows of an encoding's models, of the languages given or of all."""
        return np.array([k for k in self.rows.get(encoding, ()) if languages is None or self.keys[k][0] in languages], int)

    def cosines(self, seen: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        length = float(np.sqrt((values.astype(np.float64) ** 2).sum()))
        if not length or not len(rows):
            return np.zeros(len(rows))
        return self.weights[np.ix_(rows, seen)].astype(np.int64) @ values / (self.norms[rows] * length)

    def nearest(self, seen: np.ndarray, values: np.ndarray, encoding: str, languages: frozenset[str] | None = None) -> float:
        """The best cosine of an encoding's models with a profile, 0 without any."""
        return float(self.cosines(seen, values, self.rows_of(encoding, languages)).max(initial=0.0))

    def language(self, data: bytes, encoding: str, thin: bool = False) -> str | None:
        """The nearest model's language; in thin texts a rare one must lead the nearest common one by THIN_WITHIN."""
        rows = self.rows_of(encoding)
        scores = self.cosines(*profile(data, self.idf), rows)
        if not len(rows) or scores.max() <= 0:
            return None
        named = [self.keys[k][0] for k in rows]
        best = int(scores.argmax())
        if thin and named[best] in RARE:
            common = [k for k in range(len(rows)) if named[k] not in (*RARE, "zxx") and scores[k] > 0]
            rival = max(common, key=lambda k: scores[k], default=best)
            if scores[best] - scores[rival] < THIN_WITHIN:
                return named[rival]
        return named[best]


def bigrams(data: bytes) -> np.ndarray:
    """Counts of adjacent pairs but for a blank that repeats."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    counts = np.bincount(b[:-1] * 256 + b[1:], minlength=65536) if len(b) > 1 else np.zeros(65536, np.int64)
    counts[[x * 257 for x in BLANKS]] = 0
    return counts


def profile(data: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = bigrams(data)
    seen = np.flatnonzero(counts)
    return seen, counts[seen].astype(np.int64) * idf[seen]


def bigram_counts(df: DataFrame, content: str = "content") -> DataFrame:
    """(pair, n): adjacent byte pairs (four hexadecimal digits) of all values, but for a blank that repeats.

    Each task adds up one table of 65536 counts, so the shuffle holds at most that many rows a task. Nulls count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            for value in batch.column(0):
                data = value.as_py()
                for k in range(0, len(data or b"") - 1, 1 << 20):
                    total += bigrams(data[k : k + (1 << 20) + 1])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([f"{k:04X}" for k in seen], pa.string()), pa.array(total[seen], pa.int64())], ["pair", "n"])

    return df.select(content).mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, text: str = "text", lang: str = "lang", pairs: int = PAIRS) -> DataFrame:
    """(lang, pair, n): the commonest character pairs of each language over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[str]] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, p, n) for k, c in found.items() for p, n in c.items()]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "pair", "n"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(name, Counter()).update(map("".join, zip(value, value[1:], strict=False)))
                if sum(map(len, found.values())) > FLUSH:
                    yield out()
                    found.clear()
        yield out()

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "lang string, pair string, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "pair"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= pairs).drop("rank")


def _encoded(text: str, encoding: str) -> bytes | None:
    try:
        return text.encode(C.PYTHON_NAMES.get(encoding, encoding))
    except UnicodeEncodeError:
        return None


def _row(pairs: list[tuple[str, int]], encoding: str) -> np.ndarray:
    """Byte bigrams of one encoding: those across the two characters and those inside the first."""
    row = np.zeros(65536)
    for pair, n in pairs:
        a, b = _encoded(pair[0], encoding), _encoded(pair[1], encoding)
        if a and b:
            joined = a + b[:1]
            for k in range(len(joined) - 1):
                row[joined[k] * 256 + joined[k + 1]] += n
    row[[x * 257 for x in BLANKS]] = 0
    return row


def build(pairs: dict[str, list[tuple[str, int]]]) -> Models:
    """Models of every language of pairs under utf-8 and the encodings that the registry lists for it."""
    keys, rows = [], []
    for lang in sorted(pairs):
        for e in REGISTRY:
            if (e.name == "utf-8" or lang in e.languages) and e.name not in ("hz",) and not e.name.startswith("iso2022"):
                keys.append((lang, e.name))
                rows.append(_row(pairs[lang], e.name))
    if not rows:
        return Models([], np.zeros((0, 65536), np.uint8), np.zeros(0), np.ones(65536, np.int64))
    table = np.stack(rows)
    # Pairs that few models share and pairs with a high byte tell most.
    spread = (table > 0).sum(axis=0)
    high = (np.arange(65536) % 256 >= 0x80) | (np.arange(65536) >= 0x8000)
    idf = np.where(spread > 0, 1 + np.log2(len(keys) / np.maximum(spread, 1)), 1.0) * np.where(high, 4, 1)
    idf = np.clip(np.round(idf * 4), 1, 255).astype(np.int64)
    scaled = np.sqrt(table / table.max(axis=1, keepdims=True)) * 255
    weights = np.where(table > 0, np.clip(np.round(scaled), 1, 255), 0).astype(np.uint8)
    return Models(keys, weights, np.sqrt((weights.astype(np.float64) ** 2).sum(axis=1)), idf)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", pairs: int = PAIRS) -> Models:
    """Models from a table of texts with their languages; at most pairs rows a language reach the driver."""
    found: dict[str, list[tuple[str, int]]] = {}
    for r in count_pairs(docs, text, lang, pairs).collect():
        found.setdefault(r["lang"], []).append((r["pair"], r["n"]))
    return build(found)
