"""Every pair of ids within a word counts, however many are broadcast."""

import math
import zlib
from collections import Counter

import pytest

from byteloom.llm import attention_lm, lm_score
from byteloom.llm import queries as q

PARTS = ("anti", "kilo", "zorb", "quax", "ment", "ology", "wyrm", "fjord", "xylo", "ish")
TEXTS = [" ".join(PARTS[k * j % 10] + PARTS[(k // 7 + j * j) % 10] + PARTS[j % 9] for j in range(2, 2 + k % 9)) for k in range(300)]


def documents(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)


@pytest.fixture
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return q.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("most", [0, 5, 1 << 19])
def test_shares_of_words_against_plain_counts(spark, tokenizer, most):
    rows = lm_score._rows(documents(spark), "doc_id", "text")
    own = lm_score.subwords(*tokenizer)
    words = lm_score.spelt(lm_score.word_counts(rows.select("content", "held")), *tokenizer)
    counts, pairs = lm_score.subword_counts(words, own.size)
    vocab = attention_lm.vocabulary(counts, own.size - 1, own.text(" ".join(TEXTS).encode().split()), own.starts)
    plain, total, single = Counter(), Counter(), Counter()
    for k, t in enumerate(TEXTS):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for w in t.split():
                ids = own.text([w.encode()]).tolist()
                single.update(ids)
                for a, b in zip(ids, ids[1:]):
                    plain[a, b] += 1
                    total[a, vocab.classes[b]] += 1
    assert len(plain) > 20 and {i: int(n) for i, n in enumerate(counts) if n} == single
    got = {r["word"]: r["share"] for r in lm_score.word_shares(words, pairs, vocab, most).collect()}
    assert set(got) == {w for t in TEXTS for w in t.split()}
    for w, share in got.items():
        ids = own.text([w.encode()]).tolist()
        want = vocab.logp[ids[0]] + sum(math.log10((plain[a, b] + 2 * 10 ** vocab.logp[b]) / (total[a, vocab.classes[b]] + 2)) for a, b in zip(ids, ids[1:]))
        assert share == pytest.approx(want, abs=1e-6)


def test_scores_do_not_depend_on_what_is_broadcast(spark, tokenizer, monkeypatch):
    docs = documents(spark)
    monkeypatch.setattr(attention_lm, "LEAST", 1)
    want = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(docs, *tokenizer).collect()}
    monkeypatch.setattr(lm_score, "PAIRS", 5)
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(docs, *tokenizer, heavy=7).collect()}
    assert len(got) == len(TEXTS)
    assert got == pytest.approx(want, rel=1e-6)
