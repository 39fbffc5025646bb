"""Mixing: targets and multipliers against plain Python, taken words against targets, repeated and null ids, ties."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from byteloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes):
    """By the definition: the excess of full sources is shared out again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


def corpus(n=400, seed=1, sources=("a", "b", None, "é", "z", "Ω")):
    rng = random.Random(seed)
    return [(k, " ".join(["w"] * max(1, int(rng.lognormvariate(3, 1)))), rng.choices(sources, [9, 1, 2, 4, 1, 1][: len(sources)])[0]) for k in range(n)]


def by_source(rows, out):
    size, taken, wanted, most = Counter(), Counter(), {}, defaultdict(int)
    source = {r[0]: r[2] for r in rows}
    for r in out:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        wanted[s] = r["target"]
        most[s] = max(most[s], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    return size, taken, wanted, most


@pytest.fixture(scope="module")
def mixed(spark):
    rows = corpus()
    return rows, mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()


def test_targets_and_taken(mixed):
    rows, out = mixed
    size, taken, wanted, _ = by_source(rows, out)
    want = plain_targets(size)
    for s in size:
        assert wanted[s] == pytest.approx(want[s], rel=1e-12)
        assert abs(taken[s] - wanted[s]) <= max(3, 0.01 * wanted[s]), s
    assert {r["source_size"] for r in out} == set(size.values())


def test_rates_are_tilted_and_solve_the_dual(mixed):
    rows, out = mixed
    source = {r[0]: r[2] for r in rows}
    for s in set(source.values()):
        own = [r for r in out if source[r["doc_id"]] == s]
        total, target = sum(r["size"] for r in own), own[0]["target"]
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(target, rel=1e-8)
        scale = total / len(own)
        if target < 2 * total:
            # Bisection finds the same multiplier.
            low, high = -1e4, 1e4
            for _ in range(200):
                mid = (low + high) / 2
                got = sum(r["size"] * (math.exp(mid * r["size"] / scale) if mid * r["size"] / scale < math.log(2) else 2) for r in own)
                low, high = (mid, high) if got < target else (low, mid)
            assert len({round(r["rate"], 6) for r in own}) > 5
            for r in own:
                assert r["rate"] == pytest.approx(min(2, math.exp(min(1, low * r["size"] / scale))), rel=1e-6)


@pytest.mark.parametrize("change", ["null ids", "rows twice", "one row"])
def test_equal_ids_and_rows(spark, change):
    rows = corpus(300, 2, ("a", "b", "c"))
    if change == "one row":
        rows = [(1, "a b c d", s) for s in "abc" for _ in range(100)]
    by = {"null ids": lambda r: (None, *r[1:]), "one id": lambda r: (7, *r[1:])}.get(change)
    rows = [by(r) for r in rows] if by else rows * 2 if change == "rows twice" else rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, "text")
    kept = mixing.apply_mix(df).collect()
    size, taken = Counter(), Counter()
    for r in rows:
        size[r[2]] += len(r[1].split())
    for r in kept:
        taken[r["source"]] += r["mix_taken"]
        assert r["mix_taken"] == r["mix_copies"] * len(re.findall(r"\S+", r["text"])) and r["mix_copies"] in (1, 2)
    want = plain_targets(size)
    for s in size:
        assert abs(taken[s] - want[s]) <= max(4, 0.01 * want[s]), (change, s)
    if change == "one row":
        out = sorted(map(str, mixing.mix(df).collect()))
        assert len(out) == len(rows) and out == sorted(map(str, mixing.mix(df).collect()))


def test_no_tokens_and_no_rows(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.apply_mix(spark.createDataFrame([], SCHEMA)).collect() == []
    out = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], SCHEMA)).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in out] == [(0, 0, 0.0, 0)] * 2


def test_many_sources_by_place(spark):
    rows = [(k, "w " * (k % 7 + 1), f"s{k:04d}") for k in range(700)]
    out = mixing.source_targets(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain_targets({r[2]: len(r[1].split()) for r in rows})
    for r in out:
        assert r["target"] == pytest.approx(want[f"s{r['doc_id']:04d}"], rel=1e-12)
