"""The corpus operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from byteloom.llm import attention_lm, components, decontaminate, html_extract, license_rules, mixing, quality_classifier, quality_rules, simhash_dedup, vote_em, warc
from byteloom.llm import queries as q

RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdeéß") for _ in range(RNG.randint(2, 7))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"


def prose(n):
    return " ".join(RNG.choice(VOCAB) + ("." if k % 9 == 8 else "") for k in range(n))


@cache
def corpus():
    base = [prose(RNG.randint(60, 200)) for _ in range(40)]
    texts = [None, "", " \n ", "one", "two words", *base, *base[:6], *(b + " tail" for b in base[:4]), "same line\n" * 60, "WOW!! " * 90, prose(6000), "Under the MIT License. Apache License, Version 2.0 cc-by-nc", "x<|endoftext|>y 中文"]
    rows = [(i, t, None if i % 5 else "en", None if i % 11 == 0 else f"s{i % 3}", None, 1.0, True) for i, t in enumerate(texts)]
    return [*rows, rows[9], (None, prose(80), None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_rules(spark, docs):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(corpus())
    texts = {r[0]: r[1] for r in corpus()}
    for r in got:
        t, w = texts[r["doc_id"]] or "", words(texts[r["doc_id"]])
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.filter_documents(docs).columns == docs.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality_rules.quality_rules(none).count() == 0
    assert simhash_dedup.simhash_dedup(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert quality_classifier.quality_scores(none).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_text(pages).count() == 0
    assert warc.round_trip(pages).count() == 0


def test_em_finds_bad_voters():
    votes = Counter()
    rng = random.Random(1)
    for _ in range(4000):
        good = rng.random() < 0.8
        votes[tuple((1 if good else -1) * (1 if rng.random() < p else -1) for p in (0.95, 0.9, 0.55))] += 1
    m = vote_em.fit(votes, 3)
    assert m.accuracy[0] > m.accuracy[1] > m.accuracy[2]
    assert m.posterior((1, 1, -1)) > 0.5 > m.posterior((-1, -1, 1))


def test_simhash(spark, docs):
    got = {r["doc_id"]: r for r in simhash_dedup.simhash_dedup(docs).collect()}
    prints = {}
    for i, t, *_ in corpus():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    comp = {i: {i} for i in prints}
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and comp[a] is not comp[b]:
                both = comp[a] | comp[b]
                for x in both:
                    comp[x] = both
    for i, f in prints.items():
        assert got[i]["fingerprint"] == format(f, "016x")
        assert got[i]["component_id"] == min((x for x in comp[i] if x is not None), default=None)


def test_vantage_trees_lose_no_pair():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = x[:800].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 800, dtype=np.uint64)
    fps = np.unique(np.concatenate([x, near]))
    found = simhash_dedup.Forest(len(fps))
    for side in (0, 1):
        tree = simhash_dedup.fit_tree(simhash_dedup.half_of(fps, side), 5, 16)
        for _, which, own in tree.route(simhash_dedup.half_of(fps, side), np.ones(len(fps), bool)):
            simhash_dedup.shard_links(fps[which], own, side, found, which)
    brute = simhash_dedup.Forest(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3) + i + 1:
            brute.join(i, int(j))
    assert [found.find(i) for i in range(len(fps))] == [brute.find(i) for i in range(len(fps))]


def brute_components(fps):
    brute = simhash_dedup.Forest(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3) + i + 1:
            brute.join(i, int(j))
    return [brute.find(i) for i in range(len(fps))]


@pytest.mark.parametrize("side", [0, 1])
def test_one_half_in_common_is_split_by_the_other(side, monkeypatch):
    rng = np.random.default_rng(5)
    half = rng.integers(0, 1 << 32, 6000, dtype=np.uint64) << np.uint64(32 * (1 - side))
    half[:500] ^= np.uint64(1) << np.uint64(32 * side)
    near = half[:1500].copy()
    for _ in range(2):
        near ^= np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)
    fps = np.unique(np.concatenate([half, near, np.uint64(12345) << np.arange(40, dtype=np.uint64)]))
    want = brute_components(fps)
    found = simhash_dedup.Forest(len(fps))
    simhash_dedup.shard_links(fps, np.ones(len(fps), bool), side, found)
    simhash_dedup.shard_links(fps, np.ones(len(fps), bool), 1 - side, found)
    assert [found.find(i) for i in range(len(fps))] == want
    dealer, found = simhash_dedup.Dealer(fps, len(fps)), simhash_dedup.Forest(len(fps))
    assert dealer.below
    compared = 0
    for _, which_side, which, own in dealer.deal(fps):
        compared += int(own.sum()) * len(which)
        simhash_dedup.shard_links(fps[which], own, which_side, found, which)
    assert [found.find(i) for i in range(len(fps))] == want
    assert compared < len(fps) ** 2


def test_large_shards_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK", 200)
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    fps = np.unique(np.concatenate([fps, fps[:300] ^ np.uint64(5)]))
    edges = simhash_dedup.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    found = simhash_dedup.Forest(len(fps))
    for r in edges:
        found.join(at[r["a"]], at[r["b"]])
    assert [found.find(i) for i in range(len(fps))] == brute_components(fps)


def test_rows_are_kept_by_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BITMAPS", 2)
    rows = spark.range(0, 1000, 1, 7).select(F.monotonically_increasing_id().alias("__row"), "id")
    kept = rows.where("id % 3 = 1 or id > 900").select(F.col("__row").alias("row"))
    got = simhash_dedup.keep_rows(rows, kept)
    assert got.columns == ["__row", "id"]
    assert sorted(r["id"] for r in got.collect()) == [k for k in range(1000) if k % 3 == 1 or k > 900]
    assert simhash_dedup.keep_rows(rows, kept.limit(0)).count() == 0


def test_a_path_of_links_is_followed_to_its_end(spark):
    n = 300
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (5, None), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_decontaminate(spark, docs):
    texts = corpus()
    w = words(texts[12][1])
    items = [(1, " ".join(w[5:30])), (2, prose(30)), (3, None), (4, " ".join(w[3:6])), (1, " ".join(w[5:30]))]
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    norm = lambda t: decontaminate.words((t or "").encode())
    want = []
    for i, t, *_ in texts:
        for k, x in items:
            n = norm(x)
            s = set(decontaminate.shingles(n, min(5, len(n)))) if n else set()
            own = set(decontaminate.shingles(norm(t), min(5, len(n)))) if n else set()
            if s and len(s & own) >= math.ceil(0.8 * len(s) - 1e-9):
                want.append((i, k))
    assert got == sorted(want, key=str) and got


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert all(r["taken"] <= 2 * r["size"] for r in rows)


def test_license():
    r = license_rules.scan(b"Under the MIT License, under the mit-license. Apache License, Version 2.0; CC BY-NC 4.0")
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (4, 0, 13, "apache-2,cc-by-nc,mit")
    assert license_rules.scan(b"")["labels"] == ""
    assert "gpl-3" in license_rules.scan(b"Licensed under the GNU General Public License, version 3.")["labels"]


def test_html():
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p><b>x  y<br><p>z&nbsp;&eacute;</p><div class="ad">buy</div></article><div class="comments"><p>nice</p></div><footer>f</footer></body></html>'
    assert html_extract.extract(page, None) == "A & B\nx y\nz é"
    assert html_extract.extract(None, None) == ""


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    big, other, huge = "<p>" + "é" * 900 + "</p>", "<b>" + "x" * 1200, "long \r\n\r\n" * 300_000
    rows = [(1, "http://a b", big), (2, None, big), (3, "http://c", "short"), (4, "http://d", "short"), (5, "http://e", None), (6, "u", "x\r\n\r\nWARC/1.1\r\n" * 90), (None, "n", big), (None, "n", other), (None, "m", other), (7, "h", huge), (8, "i", huge), (8, "i", huge), (9, "", "")]
    out = [tuple(r)[:5] for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    firsts = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 1000:
            firsts[b] = max(i, firsts.get(b, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = firsts.get(b)
        again = first is not None and first != i
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, out)) == sorted(map(str, want))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"no archive at all\n"))


def slow_score(p, vocab, ids, shares):
    """By the formula, token by token in float64: log10 probability of one text."""
    p = {k: v.astype(np.float64) for k, v in p.items()}
    inputs, targets = [vocab.end, *ids], [*ids, vocab.end]
    total = shares
    for t in range(len(targets)):
        first = t // attention_lm.STEP * attention_lm.STEP - attention_lm.KEEP
        seen = [k for k in range(max(first, 0), t + 1)]
        h = np.array([p["E"][vocab.inputs[inputs[k]]] + p["P"][k - first] for k in seen])
        s = (h[-1] @ p["Wq"]) @ (h @ p["Wk"]).T / math.sqrt(attention_lm.D)
        a = np.exp(s - s.max())
        h1 = h[-1] + (a / a.sum()) @ (h @ p["Wv"]) @ p["Wo"]
        h2 = h1 + np.maximum(h1 @ p["W1"] + p["b1"], 0) @ p["W2"] + p["b2"]
        z = h2 @ p["U"] + p["c"]
        total += (z[vocab.classes[targets[t]]] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10)
    return total


def test_attention_against_the_formula():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 900, n) for n in (0, 1, 23, 24, 25, 100)]
    starts = np.arange(1000) % 3 == 0
    vocab = attention_lm.vocabulary(np.ones(1000), 999, np.concatenate(texts), starts)
    assert vocab.classes[starts].max() < attention_lm.CLASSES // 2 <= vocab.classes[~starts].min()
    p = attention_lm.train(vocab, texts, steps=30)
    fast = attention_lm.score(p, vocab, texts)
    for text, got in zip(texts, fast, strict=True):
        assert got == pytest.approx(slow_score(p, vocab, text.tolist(), vocab.logp[[*text, 999]].sum()), rel=1e-5)


def test_shares_of_a_class_add_up():
    rng = np.random.default_rng(1)
    starts = np.arange(1000) % 3 == 0
    vocab = attention_lm.vocabulary(rng.integers(1, 50, 1000).astype(float), 999, rng.integers(0, 1000, 5000), starts)
    go_on = np.flatnonzero(~starts)
    keys = np.unique(rng.integers(0, 20, 500) * 1000 + rng.choice(go_on, 500))
    pairs = attention_lm.Pairs(vocab, keys, rng.integers(1, 9, len(keys)))
    for before in (0, 5, 19, 900):
        share = 10 ** pairs.shares(np.full(len(go_on), before), go_on)
        total = np.bincount(vocab.classes[go_on], weights=share, minlength=attention_lm.CLASSES)
        assert np.allclose(total[np.unique(vocab.classes[go_on])], 1)
    share = np.bincount(vocab.classes[starts], weights=10 ** vocab.logp[starts], minlength=attention_lm.CLASSES)
    assert np.allclose(share[np.unique(vocab.classes[starts])], 1)


def test_token_counts_and_base_scores(spark, docs):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    from byteloom.llm import lm_score, token_counts

    lib = Tokenizer.from_file(q.tokenizer_path())
    texts = {r[0]: r[1] or "" for r in corpus()}
    for r in token_counts.token_counts(docs, q.tokenizer_path()).collect():
        assert r["n_tokens"] == len(lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in texts}
    c = Counter()
    for i, t, *_ in corpus():
        if not held[i]:
            c.update([*words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), 0])
    n, v = sum(c.values()), len(c)
    got = lm_score.lm_scores(docs, q.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, heavy=20).collect()
    assert len(got) == len(corpus())
    for r in got:
        w = [*words(re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]])), 0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
    base = {tuple(r) for r in lm_score.base_scores(docs, heavy=20).collect()}
    assert {r[:6][:5] for r in base} == {tuple(r)[:5] for r in got}


def test_classifier(spark, docs):
    got = {r["doc_id"]: r for r in quality_classifier.quality_scores(docs).collect()}
    assert len(got) == len(corpus()) - 1
    assert all(0 <= r["score"] <= 1 for r in got.values())
