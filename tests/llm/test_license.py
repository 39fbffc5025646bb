"""License scans: linear time, overlaps against brute force, every rule's keywords, the base columns against SQL's meaning."""

import random
import re
import time

import pytest

from byteloom.llm import license_rules
from byteloom.llm.license_signatures import SIGNATURES

RULES = license_rules.build_rules()


def test_hundreds_of_rules_by_hand():
    assert len(SIGNATURES) > 250 and len({s[3] for s in SIGNATURES}) > 250


def drawn(tree, rng):
    """A text that the parsed pattern matches."""
    out = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "ANY":
            out.append(rng.choice("abc "))
        elif name == "IN":
            kind, value = rng.choice(arg)
            out.append(chr(value if str(kind) == "LITERAL" else rng.randint(*value)))
        elif name == "BRANCH":
            out.append(drawn(rng.choice(arg[1]), rng))
        elif name == "SUBPATTERN":
            out.append(drawn(arg[3], rng))
        else:
            least, most, inner = arg
            out += [drawn(inner, rng) for _ in range(rng.randint(least, min(most, least + 3)))]
    return "".join(out)


@pytest.mark.parametrize("signature", SIGNATURES, ids=lambda s: f"{s[0]}-{s[1]}")
def test_a_match_holds_a_keyword(signature):
    rng = random.Random(3)
    for _ in range(30):
        text = drawn(re._parser.parse(signature[3]), rng)
        assert re.fullmatch(signature[3], text)
        assert any(k in f" {text} " for k in signature[2].split("|")), text


def test_overlaps_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        found = [(a, a + rng.randint(1, 6), rng.choice(RULES[::9])) for a in (rng.randint(0, 12) for _ in range(rng.randint(0, 14)))]
        best = sorted(set(range(len(found))), key=lambda i: (-found[i][2].priority, found[i][0] - found[i][1], found[i][2].label, i))
        want = [i for n, i in enumerate(best) if not any(found[j][0] <= found[i][0] and found[i][1] <= found[j][1] for j in best[:n])]
        key = lambda d: (d[0], d[1], d[2].label, d[2].pattern.pattern)
        assert sorted(license_rules.suppress(list(found)), key=key) == sorted((found[i] for i in want), key=key)


def test_many_places_take_linear_time():
    license_rules.scan(b"warm")
    began = time.time()
    r = license_rules.scan(b"under the mit license " * 100_000)
    assert time.time() - began < 20
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (400_000, 100_000, 0, 399_996, "mit")


def test_base_against_plain_words():
    rng = random.Random(2)
    parts = "under the mit license apache license version 2 cc by nc cc by nc-sa UNDER THE MIT license, é".split()
    for _ in range(200):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places, labels = [], set()
        for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = license_rules.scan(text.encode())
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


@pytest.mark.parametrize(("text", "label"), [("Licensed under EPL2.0", "epl-2"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"), ("CC BY-SA 4.0", "cc-by-sa"), ("the GNU Lesser General Public License, version 2.1", "lgpl-2.1"), ("https://www.apache.org/licenses/LICENSE-2.0", "apache-2")])
def test_labels(text, label):
    assert license_rules.scan(text.encode())["labels"].split(",") == [label]


def test_no_rows(spark):
    assert license_rules.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
