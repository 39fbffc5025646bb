"""The quicker forms of the language model's steps give what the plain ones give."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from byteloom.llm import attention_lm, lm_score
from byteloom.llm import queries as q


def test_exponents_of_rows_far_apart():
    z = np.random.default_rng(1).standard_normal((6, attention_lm.CLASSES)).astype(np.float32)
    z[2] -= 500
    z[4] += 300
    want = np.exp((z - z.max(axis=1, keepdims=True)).astype(np.float64))
    e, total = attention_lm.exponents(z.copy())
    assert (e / total[:, None]) == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=1e-5)
    # A row that doesn't matter doesn't slow the others, and gives no division by zero.
    z[4] -= 300
    e, total = attention_lm.exponents(z.copy(), np.arange(6) == 2)
    assert (total > 0).all() and not e[2].any()


def test_neighbours_against_plain_sums():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 50, 400)
    seen = np.bincount(rows, minlength=attention_lm.INPUTS)
    project = np.random.default_rng(5).standard_normal((attention_lm.INPUTS, attention_lm.CONTEXT)).astype(np.float32)
    project *= (1 / np.sqrt(seen + 1)).astype(np.float32)[:, None]
    want = np.zeros((attention_lm.INPUTS, 2 * attention_lm.CONTEXT))
    for a, b in zip(rows, rows[1:]):
        want[a, : attention_lm.CONTEXT] += project[b]
        want[b, attention_lm.CONTEXT :] += project[a]
    assert attention_lm.contexts(rows, seen) == pytest.approx(want, abs=1e-9)


def test_adam_against_the_formula():
    rng = np.random.default_rng(3)
    p = attention_lm.initial()
    want = {k: v.astype(np.float64) for k, v in p.items()}
    m, s = ({k: np.zeros_like(v) for k, v in want.items()} for _ in range(2))
    adam = attention_lm.Adam(p)
    for t in range(1, 70):
        g = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in p.items()}
        adam.step(g, 1e-2)
        for k, d in g.items():
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.99 * s[k] + 0.01 * d.astype(np.float64) ** 2
            want[k] -= 1e-2 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
    assert all(np.abs(p[k] - want[k]).max() < 1e-4 for k in p)


def test_scores_against_training_formula():
    """What scoring looks up, with Wo and b2 in it, gives what training computes."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 900, n) for n in (0, 3, 24, 40, 90)]
    vocab = attention_lm.vocabulary(np.ones(1000), 999, np.concatenate(texts))
    p = {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in attention_lm.initial().items()}
    inputs, targets, lengths = attention_lm.joined(vocab, texts)
    at, absent, text = attention_lm.windows(lengths)
    h = attention_lm.hidden(p, vocab.inputs[inputs][at], absent)
    assert h[1] is not None
    told = attention_lm.projected(p)
    assert told["places"].shape == (attention_lm.T, 4 * attention_lm.D)
    assert told["rows"][:, 2 * attention_lm.D : 3 * attention_lm.D] == pytest.approx(p["E"] @ p["Wv"] @ p["Wo"])
    z = h[0] @ p["U"] + p["c"]
    z -= z.max(axis=1, keepdims=True)
    y = vocab.classes[targets][at[:, attention_lm.KEEP :]].ravel()
    lp = (z[np.arange(len(z)), y] - np.log(np.exp(z).sum(axis=1))).reshape(len(at), -1)
    lp[absent[:, attention_lm.KEEP :]] = 0
    want = np.bincount(text, lp.sum(axis=1)) / np.log(10) + np.add.reduceat(vocab.logp[targets], np.cumsum(lengths) - lengths)
    assert attention_lm.score(p, vocab, texts) == pytest.approx(want, rel=1e-9)


def test_distinct_words():
    texts = [b" A b\x0b a ", b"", b"c\xc3\xa9 b\x1cb\x85"]
    words, at, sizes = lm_score.distinct_words(texts)
    assert sizes.tolist() == [3, 0, 2]
    assert [words.to_pylist()[k] for k in at] == [b"a", b"b", b"a", b"c\xc3\xa9", b"b\x1cb\x85"]


@pytest.fixture
def own():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return lm_score.Subwords(q.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_words_spelt_together_as_alone(own):
    odd = ["a", "don't", "'s", "7", "é", "中文", "x\xa0", "\xa0y", "\xa0", "　z ", "\x1c", "\x85b", "..", "\x00", "zq" * 300]
    words = [(a + b).encode() for a in odd for b in odd] * 5
    calls, encode = [], own.encode
    own.encode = lambda text: (calls.append(text), encode(text))[1]
    want = [np.array(encode(" " + w.decode()), "<u2").tobytes() for w in words]
    assert own.spell(words) == want
    assert own.many(words) == want and own.many(words) == want
    calls.clear()
    plain = [f"w{k}".encode() for k in range(3 * lm_score.TOGETHER)]
    assert own.spell(plain) == [np.array(encode(" " + w.decode()), "<u2").tobytes() for w in plain]
    assert len(calls) == 3


def test_words_found_again_in_ids(own):
    texts = [b" A b\x0b a ", b"", b"c\xc3\xa9 b\x1cb\x85 \xc2\xa0 \xc2\xa0b unheardofword", b" \n", b"a"]
    words, at, sizes = lm_score.distinct_words(texts)
    spelt = own.texts(words.to_pylist(), at, sizes)
    assert [x for x in spelt if not x] == [b"", b""]
    # A slice: the values don't begin where the buffer does.
    again, where, n = lm_score.distinct_spelt(pa.array([b"ab", *spelt], pa.binary())[1:], own.starts)
    assert n.tolist() == sizes.tolist() and len(again) == len(words)
    ids = own.spell(words.to_pylist())
    assert [again.to_pylist()[k] for k in where] == [ids[k] for k in at]
    assert lm_score.distinct_spelt(pa.array([], pa.binary()), own.starts)[2].tolist() == []
    assert lm_score.distinct_spelt(pa.array([b""], pa.binary()), own.starts)[2].tolist() == [0]


@pytest.mark.parametrize("flush", [1, 7, 500_000])
def test_word_counts_whatever_a_task_holds(spark, monkeypatch, flush):
    monkeypatch.setattr(lm_score, "FLUSH", flush)
    texts = [" ".join(f"w{k * j % 41}" for j in range(k % 13)) for k in range(1500)] + ["", "A a\x0bB"]
    rows = lm_score._rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "doc_id", "text").select("content", "held")
    every, train = Counter(), Counter()
    for k, t in enumerate(texts):
        every.update(t.lower().split())
        if zlib.crc32(str(k).encode()) % 7 != 2:
            train.update(t.lower().split())
    assert {r["word"]: (r["c"], r["n"]) for r in lm_score.word_counts(rows).collect()} == {w: (train[w], n) for w, n in every.items()}


def test_documents_are_encoded_once(spark, monkeypatch):
    """Scoring reads the ids that training read, those of held-out documents too."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(attention_lm, "LEAST", 1)
    seen, scored = [], lm_score._scored
    monkeypatch.setattr(lm_score, "_scored", lambda rows, *more: (seen.append((rows.columns, rows.count())), scored(rows, *more))[1])
    docs = spark.range(70).selectExpr("id AS doc_id", "concat('text number ', id) AS text").repartition(3)
    assert lm_score.lm_scores(docs, q.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 70
    assert "ids" in seen[0][0] and "content" not in seen[0][0] and seen[0][1] == 70
