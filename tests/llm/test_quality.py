"""Verdicts of the quality rules and scores of the classifier against plain code, document by document."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from byteloom.llm import quality_classifier as Q
from byteloom.llm import quality_rules

SF = "/root/testdata/sf0.001/documents.parquet"
ODD = [None, "", " \n ", "ONE", "!!! " * 60, "word " * 300, "same line here\n" * 40, "1234 567 " * 80, "x" * 5000, "# $ % & " * 50, "A calm text, with stops. " * 30]


def plain_em(votes):
    """Posterior of every row, votes counted row by row."""
    votes = np.array(votes)
    up, down = (votes > 0).sum(1), (votes < 0).sum(1)
    post = (1 + 2 * up) / (2 + 2 * up + 4 * down)
    for _ in range(60):
        prior = min(0.95, max(0.05, (post.sum() + 2) / (len(votes) + 4)))
        odds = np.log(prior / (1 - prior)) * np.ones(len(votes))
        weights = []
        for column in votes.T:
            share = {}
            for y, p in ((1, post), (-1, 1 - post)):
                cell = {v: (2 if v == y else 1 if v == 0 else 0.5) + p[column == v].sum() for v in (-1, 0, 1)}
                share[y] = {v: c / sum(cell.values()) for v, c in cell.items()}
            w = {v: math.log(share[1][v] / share[-1][v]) for v in (-1, 0, 1)}
            w[-1], w[1] = min(0.0, w[-1]), max(0.0, w[1])
            weights.append(w)
            odds += np.vectorize(w.get)(column)
        new = 1 / (1 + np.exp(-odds))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-9:
            break
    return post, prior, weights


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(SF).select("doc_id", "text").collect()]
    return rows + [(10**6 + k, t) for k, t in enumerate(ODD)] + rows[:20]


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    n = lambda chars: sum(c in chars for c in text)
    return dict(words=len(words), chars=sum(map(len, words)), symbols=n("#*$%&|<>"), dups=len(lines) - len(set(lines)), repeats=len(inside), lines=len(lines), upper=n("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), bangs=n("!"), digits=n("0123456789"), stops=n(".,;:?"))


def rule_votes(c):
    w, ch = max(c["words"], 1), max(c["chars"], 1)
    symbols, bangs, upper, digits, repeats, stops = c["symbols"] / w, c["bangs"] / w, c["upper"] / ch, c["digits"] / ch, c["repeats"] / w, c["stops"] / w
    bad = [symbols > 0.25, c["symbols"] / ch > 0.04, upper > 0.4, bangs > 0.3, repeats > 0.3, c["dups"] / max(c["lines"], 1) > 0.5 and c["dups"] > 1, digits > 0.25, not 2 <= c["chars"] / w <= 12]
    calm = symbols < 0.1 and bangs < 0.1 and upper < 0.2 and digits < 0.1 and repeats < 0.25
    return [-int(b) for b in bad] + [int(calm), -1 if stops == 0 and w > 80 else int(0.02 <= stops <= 0.5)]


def test_rules_against_plain_code(spark, texts):
    counts = [rule_counts(t or "") for _, t in texts]
    failed = [c["words"] < 50 or 100 * c["repeats"] > 50 * c["words"] for c in counts]
    votes = [rule_votes(c) for c in counts]
    _, prior, weights = plain_em([v for v, f in zip(votes, failed, strict=True) if not f])
    want = []
    for (doc, _), c, f, v in zip(texts, counts, failed, votes, strict=True):
        odds = math.log(prior / (1 - prior)) + sum(w[x] for w, x in zip(weights, v, strict=True))
        want.append((doc, c["words"], c["chars"], c["symbols"], c["dups"], c["repeats"], f, not f and odds >= 0, 1 / (1 + math.exp(-odds))))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good").collect()]
    got, want = sorted(got), sorted(want)
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert np.allclose([r[-1] for r in got], [r[-1] for r in want], atol=1e-7)
    assert {r[7] for r in got if not r[6]} == {True, False}


def statistic_values(data):
    words = data.split()
    n, chars = len(words) + 20, len(re.sub(rb"[ \t\n\x0b\x0c\r]", b"", data)) + 100
    count = lambda pattern: len(re.findall(pattern, data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols = count(rb"[#*$%&|<>{}\[\]\\^~=_@]")
    return {
        "symbols": symbols / n, "symbol_chars": symbols / chars, "upper": (count(rb"[A-Z]") + 3) / chars, "bangs": count(rb"!") / n, "digits": count(rb"[0-9]") / chars,
        "stops": (count(rb"[.,;:?]") + 2) / n, "length": chars / n / 10, "runs": sum(words[k] == words[k + 1] for k in range(len(words) - 1)) / n,
        "distinct": len(set(words)) / n**0.85 if len(words) >= 100 else 1.0, "dup_lines": 1 - len(set(lines)) / len(lines) if len(lines) > 5 else 0.0,
    }


def row_of(data):
    """The dense features of one text: shares of words and of their shapes, buckets of statistics."""
    row, words = np.zeros(Q.DIMS), data.split()
    for w in words:
        shape = re.sub(rb"[0-9]", b"0", re.sub(rb"[A-Z]", b"A", w))
        shape = bytes(97 if 97 <= c <= 122 or c >= 128 else c for c in shape)
        shape = re.sub(rb"(.)\1+", rb"\1", shape, flags=re.S)
        row[crc32(w.lower()) % 2048] += 1 / (len(words) + 20)
        row[2048 + crc32(shape) % 512] += 1 / (len(words) + 20)
    for k, v in statistic_values(data).items():
        row[2560 + crc32(f"{k}:{min(9, int(10 * v))}".encode()) % 256] += 0.25
    return row


def test_classifier_against_plain_code(spark, texts):
    contents = [(t or "").encode() for _, t in texts]
    votes = [Q.votes(statistic_values(c), len(c.split()), c.count(b"\n") + 1) for c in contents]
    label = plain_em(votes)[0]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {}
    for r in Q.quality_scores(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    # A logistic fit of our own on every distinct text, in float64; those without words have equal features and count once.
    seen = {c.strip(): k for k, c in enumerate(contents)}
    x, y = np.stack([row_of(contents[k]) for k in seen.values()]), label[list(seen.values())]
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 0.02), 0.5 / max(1 - y.mean(), 0.02)) / len(y)
    params, m, v = np.zeros(Q.DIMS + 1), 0.0, 0.0
    x1 = np.hstack([x, np.ones((len(x), 1))])
    decay = np.r_[np.full(Q.DIMS, 1e-4), 0]
    for t in range(1, 301):
        g = x1.T @ ((1 / (1 + np.exp(-x1 @ params)) - y) * weight) + decay * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    for (doc, _), c, want in zip(texts, contents, label, strict=True):
        score = 1 / (1 + math.exp(-(np.r_[row_of(c), 1] @ params)))
        for r in got[doc]:
            assert r["weak_label"] == pytest.approx(want, abs=1e-6)
            assert r["score"] == pytest.approx(score, abs=0.01)
    assert {r["kept"] for rs in got.values() for r in rs} == {True, False}


def test_classifier_against_labels(spark):
    """The labels are never trained on: those of sf0.01 are all held out."""
    folder = "/root/testdata/sf0.01"
    scores = Q.quality_scores(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = scores.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert len(rows) > 100
    for quality in (0, 1):
        own = [r["kept"] == bool(quality) for r in rows if r["quality"] == quality]
        assert sum(own) / len(own) > 0.95, (quality, sum(own), len(own))
