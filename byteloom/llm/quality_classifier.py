"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation
over the counts of vote patterns, taken over all documents, estimates how accurate each labeller is.
The posterior labels of a bounded sample (the SAMPLE distinct texts of smallest hash, or all if there are fewer)
train a hashed linear scorer in numpy, and the scorer rates every document: its features are words,
word shapes and bucketed statistics, hashed to a fixed number of weights.

Defined results: null and empty texts have no words, get a score from their statistics alone and stay only if the scorer
says so; repeated rows get equal scores; an empty table gives an empty result; a text of any length is
read whole; other columns are ignored by quality_scores and kept by filter_documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.llm import vote_em
from byteloom.llm.common import DOC, materialize, packed, tune, utf8

#: Distinct texts that the scorer is trained on.
SAMPLE = 4096
#: Weights of words, of word shapes, of statistics.
WORD_BITS, SHAPE_BITS, STAT_BITS = 11, 9, 8
DIMS = (1 << WORD_BITS) + (1 << SHAPE_BITS) + (1 << STAT_BITS)
CACHE_SIZE = 1 << 18
#: Ordinary words that every text is taken to have besides its own.
PSEUDO = 20

SPACE = b" \t\n\x0b\x0c\r"
UPPER, DIGITS, STOPS = bytes(range(65, 91)), b"0123456789", b".,;:?"
SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"
CLASSES = bytes(ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("a") if 97 <= b <= 122 or b >= 128 else b for b in range(256))
RUNS = re.compile(rb"(.)\1+", re.S)


def statistics(content: bytes, words: list[bytes]) -> dict[str, float]:
    """Shares between 0 and 1, or a few times that.

    Each is taken as if PSEUDO ordinary words came on top, so that a text of a few words isn't judged by
    the one capital or full stop that it has.
    """
    n = len(words) + PSEUDO
    chars = len(content.translate(None, SPACE)) + 5 * PSEUDO
    off = lambda drop: len(content) - len(content.translate(None, drop))
    lines = [x for x in content.split(b"\n") if x.strip()]
    return {
        "symbols": off(SYMBOLS) / n,
        "symbol_chars": off(SYMBOLS) / chars,
        "upper": (off(UPPER) + 0.15 * PSEUDO) / chars,
        "bangs": content.count(b"!") / n,
        "digits": off(DIGITS) / chars,
        "stops": (off(STOPS) + 0.1 * PSEUDO) / n,
        "length": chars / n / 10,
        "runs": sum(a == b for a, b in pairwise(words)) / n,
        "distinct": len(set(words)) / n**0.85 if len(words) >= 100 else 1.0,
        "dup_lines": 1 - len(set(lines)) / len(lines) if len(lines) > 5 else 0.0,
    }


def votes(s: dict[str, float], n_words: int, n_lines: int) -> tuple[int, ...]:
    bad_if = lambda x: -1 if x else 0
    calm = s["symbols"] < 0.1 and s["bangs"] < 0.1 and s["upper"] < 0.2 and s["digits"] < 0.15 and s["runs"] < 0.1 and s["dup_lines"] < 0.4
    return (
        bad_if(s["symbols"] > 0.25),
        bad_if(s["symbol_chars"] > 0.04),
        bad_if(s["upper"] > 0.4),
        bad_if(s["bangs"] > 0.3),
        bad_if(s["runs"] > 0.2),
        bad_if(n_words > 100 and s["distinct"] < 0.4),
        bad_if(n_lines > 5 and s["dup_lines"] > 0.5),
        bad_if(s["digits"] > 0.4),
        bad_if(n_words == 0 or s["length"] > 1.5 or s["length"] < 0.2),
        1 if n_words and calm else 0,
        1 if 0.02 <= s["stops"] <= 0.5 else -1 if n_words > 80 and s["stops"] == 0 else 0,
    )


VOTERS = 11


def word_index(word: bytes) -> int:
    return zlib.crc32(word.lower()) & ((1 << WORD_BITS) - 1)


def shape_index(word: bytes) -> int:
    return (1 << WORD_BITS) + (zlib.crc32(RUNS.sub(rb"\1", word.translate(CLASSES))) & ((1 << SHAPE_BITS) - 1))


def stat_indices(s: dict[str, float]) -> list[int]:
    """One index a statistic: its name with its bucket."""
    base = (1 << WORD_BITS) + (1 << SHAPE_BITS)
    return [base + (zlib.crc32(f"{k}:{min(9, int(10 * v))}".encode()) & ((1 << STAT_BITS) - 1)) for k, v in s.items()]


def features(content: bytes) -> tuple[np.ndarray, np.ndarray, tuple[int, ...]]:
    """(indices, values, votes) of one text."""
    words = content.split()
    s = statistics(content, words)
    found: Counter[int] = Counter()
    for w, k in Counter(words).items():
        found[word_index(w)] += k
        found[shape_index(w)] += k
    n = len(words) + PSEUDO
    idx = np.fromiter(found, np.int32, len(found))
    val = np.fromiter(found.values(), np.float32, len(found)) / n
    stats = stat_indices(s)
    return np.concatenate([idx, np.array(stats, np.int32)]), np.concatenate([val, np.full(len(stats), 0.25, np.float32)]), votes(s, len(words), content.count(b"\n") + 1)


def code(pattern: tuple[int, ...]) -> int:
    out = 0
    for v in pattern:
        out = 3 * out + v + 1
    return out


def decode(number: int) -> tuple[int, ...]:
    out = []
    for _ in range(VOTERS):
        out.append(number % 3 - 1)
        number //= 3
    return tuple(reversed(out))


class Weights(dict):
    """word -> what it adds to the score; remembers a bounded number of words."""

    def __init__(self, w: np.ndarray) -> None:
        super().__init__()
        self.w = w.astype(np.float64)

    def __missing__(self, word: bytes) -> float:
        x = float(self.w[word_index(word)] + self.w[shape_index(word)])
        if len(word) <= 64:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = x
        return x

    def score(self, content: bytes, bias: float) -> tuple[float, tuple[int, ...]]:
        words = content.split()
        s = statistics(content, words)
        total = sum(map(self.__getitem__, words)) / (len(words) + PSEUDO)
        z = bias + total + 0.25 * float(self.w[stat_indices(s)].sum())
        return 1 / (1 + np.exp(-max(-500.0, min(500.0, z)))), votes(s, len(words), content.count(b"\n") + 1)


def train(rows: list[tuple[bytes, bytes, float]], rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam over the whole sample. rows: indices, values, label."""
    x = np.zeros((len(rows), DIMS), np.float32)
    y = np.array([r[2] for r in rows], np.float32)
    for i, (idx, val, _) in enumerate(rows):
        np.add.at(x[i], np.frombuffer(idx, np.int32), np.frombuffer(val, np.float32))
    w, b = np.zeros(DIMS, np.float32), 0.0
    if not len(rows):
        return w, b
    good = float(y.mean())
    balance = np.where(y > 0.5, 0.5 / max(good, 0.02), 0.5 / max(1 - good, 0.02)).astype(np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - y) * balance / len(rows)
        g, gb = x.T @ e + decay * w, float(e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / ((vb / c2) ** 0.5 + 1e-8)
    return w, b


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[vote_em.VoteModel, np.ndarray, float]:
    """Labeller accuracies from all documents, and the scorer from a sample of them; texts with equal features and votes count once."""
    spark = docs.sparkSession
    tune(spark)
    # By distinct texts, not rows: in a table of many copies a share of the rows may hold no text at all.
    h = F.xxhash64(text_col, F.lit("sample"))
    least = docs.select(h.alias("h")).distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    pick = F.when(h <= F.lit(least), h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        sent: set[int] = set()
        for batch in batches:
            out = []
            for content, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chosen is not None and chosen not in sent:
                    sent.add(chosen)
                    idx, val, v = features(content)
                    out.append((code(v), idx.tobytes(), val.tobytes()))
                else:
                    words = content.split()
                    v = votes(statistics(content, words), len(words), content.count(b"\n") + 1)
                seen[code(v)] += 1
            yield _rows([(p, 0, i, x) for p, i, x in out])
        yield _rows([(p, k, None, None) for p, k in seen.items()])

    table = materialize(docs.select(utf8(text_col).alias("c"), pick.alias("p")).mapInArrow(run, "pattern int, n long, idx binary, val binary"), "votes")
    patterns = {decode(r["pattern"]): r["n"] for r in table.where("idx is null").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    model = vote_em.fit(patterns, VOTERS)
    # Copies hash alike, so each chosen text counts once: a task sends it once, and the tasks' copies are alike.
    chosen = table.where("idx is not null").distinct().orderBy("pattern", "idx", "val").limit(4 * sample).collect()
    w, b = train([(bytes(r["idx"]), bytes(r["val"]), model.posterior(decode(r["pattern"]))) for r in chosen])
    return model, w, b


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["pattern", "n", "idx", "val"])


def rated(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns with __score and __label, the scorer's and the labellers' probability of being good."""
    spark = docs.sparkSession
    model, w, b = fit(docs, text_col)
    shared = spark.sparkContext.broadcast((model, w, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w, b = shared.value
        own = Weights(w)
        for batch in batches:
            n = batch.num_columns - 1
            got = [own.score(x, b) for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([float(s) for s, _ in got], pa.float64()), pa.array([model.posterior(v) for _, v in got], pa.float64())], [*batch.schema.names[:n], "__score", "__label"])

    out = docs.select(*keep).schema.add("__score", "double").add("__label", "double")
    return docs.select(*keep, utf8(text_col).alias("__content")).mapInArrow(run, out)


def kept() -> Column:
    return F.col("__score") >= 0.5


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the scorer's probability, the weak label and the verdict."""
    return rated(docs, [id_col], text_col).select(id_col, F.col("__score").alias("score"), F.col("__label").alias("weak_label"), kept().alias("kept"))


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the scorer rates good, with all their columns."""
    return rated(packed(docs), [DOC], f"{DOC}.{text_col}").where(kept()).select(f"{DOC}.*")
