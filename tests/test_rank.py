"""Byte evidence against plain walks, and each rank correction on rankings made for it."""

import random
import unicodedata

import numpy as np
import pytest

from byteloom.functions import evidence as E
from byteloom.functions import models as M
from byteloom.functions import ranking as K
from byteloom.functions import registry as R

TEXTS = {
    "en": "The quick brown fox jumps over the lazy dog while the café serves its naïve guests another round of tea.",
    "fr": "Les élèves étaient très fatigués après une journée passée à étudier les sciences, où ça va très bien déjà.",
    "tr": "Şişli'de yağmurlu bir gün geçiren çocuklar ılık çay içip güneşin doğuşunu izlediler, sonra eve döndüler.",
    "ru": "Съешь же ещё этих мягких французских булок да выпей чаю, а потом иди домой и ложись спать спокойно.",
}


@pytest.fixture(scope="module")
def models():
    """Models from counted pairs, without Spark."""
    pairs = {}
    for lang, text in TEXTS.items():
        counts = {}
        for a, b in zip(text, text[1:], strict=False):
            counts[a + b] = counts.get(a + b, 0) + 1
        pairs[lang] = sorted(counts.items())
    return M.build(pairs)


def weight(encoding, byte, left, right):
    c = E.characters(encoding)
    kind = lambda b: "Cn" if c[b] is None else unicodedata.category(c[b])
    own = kind(byte)
    if own[0] == "L" and ((kind(left)[0] != "L" and kind(right)[0] != "L") or (own == "Ll" and kind(right) == "Lu")):
        return own, E.STRAY_LETTER
    return own, E.WEIGHTS[own]


def plain_vote(data, a, b, odd):
    sums, telling, seen = {a: 0, b: 0}, {a: [], b: []}, {}
    for k, byte in enumerate(data):
        if byte not in odd or seen.setdefault(byte, 0) >= 256:
            continue
        seen[byte] += 1
        around = (data[k - 1] if k else 0, data[k + 1] if k + 1 < len(data) else 0)
        (ka, wa), (kb, wb) = weight(a, byte, *around), weight(b, byte, *around)
        for mine, theirs, wm, wt, name in ((ka, kb, wa, wb, a), (kb, ka, wb, wa, b)):
            if wm > wt and not (mine[0] == "L" and theirs[0] == "P"):
                sums[name] += wm - wt
                if theirs[0] == "L" and wt == 2:
                    telling[name].append(wm - wt)
    if sums[a] == sums[b]:
        return None, False
    won = max(sums, key=sums.get)
    return won, sum(telling[won]) >= 8 and len(telling[won]) >= 2


def test_votes_against_a_plain_walk():
    rng, decisive = random.Random(4), 0
    for _ in range(200):
        data = bytes(rng.choice(b"abcABC \x80\x85\x92\xa4\xbe\xc0\xe9\xf0\xfe") for _ in range(rng.choice([0, 1, 30, 9000])))
        for a, b in (("cp1252", "iso8859-15"), ("koi8-r", "koi8-u"), ("cp850", "cp437"), ("iso8859-1", "iso8859-14"), ("cp1252", "cp932")):
            odd = E.differing(a, b)
            got = E.Evidence(data).vote(a, b, odd)
            assert got == plain_vote(data, a, b, odd)
            assert E.Evidence(data).vote(b, a, odd) == got
            decisive += got[1]
    assert decisive > 50


def test_differing_bytes():
    assert E.differing("cp1252", "cp1252") == E.differing("cp932", "gb18030") == E.confusable_bytes("cp932", "cp1252") == frozenset()
    assert E.differing("iso8859-1", "iso8859-15") == {0xA4, 0xA6, 0xA8, 0xB4, 0xB8, 0xBC, 0xBD, 0xBE}
    # Low bytes count between mainframe encodings.
    assert {0x4A, 0x5A} <= E.confusable_bytes("cp500", "cp1140")


def test_rescore_against_a_plain_profile(models):
    data = TEXTS["tr"].encode("cp1254")
    a, b = "cp1254", "iso8859-1"
    odd = E.confusable_bytes(a, b)

    def best(encoding, languages):
        values = np.zeros(65536)
        for x, y in zip(data, data[1:], strict=False):
            if x in odd or y in odd:
                values[x * 256 + y] += models.idf[x * 256 + y]
        rows = [k for k, (lang, e) in enumerate(models.keys) if e == encoding and (languages is None or lang in languages)]
        return max((models.weights[k] @ values / models.norms[k] / np.sqrt(values @ values) for k in rows), default=0.0)

    seen = E.Evidence(data, models)
    for languages in (None, frozenset({"en"}), frozenset({"tr"})):
        x, y = best(a, languages), best(b, languages)
        assert seen.rescore(a, b, odd, languages, languages) == (a if x > y else b if y > x else None)
    assert seen.rescore(a, b, odd, None, None) == "cp1254"
    assert E.Evidence(b"plain", models).rescore(a, b, odd, None, None) is None and E.Evidence(data).rescore(a, b, odd, None, None) is None


def test_comparable(models):
    seen = E.Evidence(b"x", models)
    assert seen.comparable("cp1252", "iso8859-1", frozenset()) is None
    assert seen.comparable("cp1252", "iso8859-1", frozenset({"ru"})) is None
    assert {"en", "fr"} <= seen.comparable("cp1252", "iso8859-1", frozenset({"fr"}))
    assert E.Evidence(b"x").comparable("cp1252", "iso8859-1", frozenset({"fr"})) is None


def test_settle(models, monkeypatch):
    seen = E.Evidence(b"x", models)
    answers = {}
    monkeypatch.setattr(E.Evidence, "vote", lambda self, a, b, odd: answers["vote"])
    monkeypatch.setattr(E.Evidence, "rescore", lambda self, *a: answers["models"])
    near, far = ("iso8859-1", "iso8859-15"), ("cp1252", "koi8-r")
    assert len(E.confusable_bytes(*far)) >= E.UNLIKE > len(E.confusable_bytes(*near))
    for vote, told, wanted in (
        ((near[0], True), near[1], (near[0], near[0])),
        ((near[0], False), near[1], (near[1], None)),
        ((near[0], False), None, (near[0], None)),
        ((near[0], False), near[0], (near[0], near[0])),
        ((None, False), near[1], (near[1], None)),
    ):
        answers.update(vote=vote, models=told)
        assert (seen.settle(*near, frozenset()), seen.settle(*near, frozenset(), strict=True)) == wanted
    for vote, told, wanted in (((far[0], True), far[1], None), ((far[0], True), far[0], far[0]), ((far[0], True), None, None)):
        answers.update(vote=vote, models=told)
        assert seen.settle(*far, frozenset()) == wanted
    assert seen.settle("cp932", "cp949", frozenset()) is None


def names(step, data, ranked, models=None, cut=False):
    out = step(E.Evidence(data, models), [(*r, None) for r in ranked], cut)
    assert out[0][1] == max(r[1] for r in out) and sorted(r[0] for r in out) == sorted(r[0] for r in ranked)
    return [r[0] for r in out]


def test_dead_heats(models):
    sjis = "日本語".encode("cp932")
    assert names(K.superset_on_dead_heat, sjis, [("shift_jis_2004", 0.5, "ja"), ("cp932", 0.49995, "ja")])[0] == "cp932"
    assert names(K.superset_on_dead_heat, sjis, [("shift_jis_2004", 0.5, "ja"), ("cp932", 0.4997, "ja")])[0] == "shift_jis_2004"
    assert names(K.superset_on_dead_heat, b"\x81", [("shift_jis_2004", 0.5, "ja"), ("cp949", 0.5, "ko")])[0] == "shift_jis_2004"
    old, new = "iso8859-1", "cp1252"
    assert R.BY_NAME[new].era < R.BY_NAME[old].era
    # No model knows the bytes: the commoner wins. The models favour neither or the first: it stays.
    assert names(K.prevalent_on_dead_heat, b"\x99\x98", [(old, 0.5, "en"), (new, 0.5, "en")])[0] == new
    known = TEXTS["fr"].encode(old)
    assert names(K.prevalent_on_dead_heat, known, [(old, 0.5, "fr"), (new, 0.5, "fr")], models)[0] == old
    assert names(K.prevalent_on_dead_heat, known, [(old, 0.5, "fr"), (new, 0.4, "fr")])[0] == old


def test_rare_language():
    ranked = [("iso8859-14", 0.14, "gd"), ("cp1252", 0.13, "ga"), ("iso8859-1", 0.125, "en")]
    assert names(K.rare_language, b"x", ranked)[0] == "iso8859-1"
    assert names(K.rare_language, b"x", [("iso8859-14", 0.15, "gd"), ("iso8859-1", 0.14, "en")])[0] == "iso8859-14"
    assert names(K.rare_language, b"x", [("iso8859-14", 0.14, "gd"), ("iso8859-1", 0.11, "en")])[0] == "iso8859-14"


def test_confusable_walk(monkeypatch):
    beats = set()
    monkeypatch.setattr(E.Evidence, "settle", lambda self, a, b, langs, strict=False: b if (a, b, strict) in beats else a)
    a, b, c, d = [("cp1252", 0.16, "en"), ("iso8859-1", 0.12, "en"), ("iso8859-15", 0.1, "en"), ("cp1254", 0.07, "en")]
    beats.update({("cp1252", "iso8859-15", True), ("iso8859-15", "cp1254", True)})
    # Half of .16 is .08: the fourth is out of reach.
    assert names(K.confusable, b"", [a, b, c, d]) == ["iso8859-15", "cp1252", "iso8859-1", "cp1254"]
    # A sure first: nothing beyond the second and the band.
    assert names(K.confusable, b"", [("cp1252", 0.2, "en"), b, c])[0] == "cp1252"
    assert names(K.confusable, b"", [("cp1252", 0.16, "zxx"), b, c])[0] == "cp1252"
    # The second counts at any distance.
    beats.add(("cp1252", "iso8859-1", False))
    assert names(K.confusable, b"", [("cp1252", 0.9, "en"), b, c]) == ["iso8859-1", "cp1252", "iso8859-15"]


def test_niche_latin(models):
    ranked = [("cp1254", 0.5, "tr"), ("iso8859-15", 0.3, "en"), ("cp1252", 0.3, "en"), ("koi8-r", 0.2, "ru")]
    out = K.niche_latin(E.Evidence(b"caf\xe9"), [(*r, None) for r in ranked], False)
    assert [(r[0], r[1]) for r in out] == [("cp1252", 0.5), ("iso8859-15", 0.3), ("koi8-r", 0.2), ("cp1254", 0.2)]
    # A byte of its own, and clearly ahead.
    assert names(K.niche_latin, b"da\xf0", ranked)[0] == "cp1254"
    close = [("cp1254", 0.302, "tr"), *ranked[1:]]
    assert names(K.niche_latin, TEXTS["tr"].encode("cp1254"), close, models)[0] == "cp1254"
    assert names(K.niche_latin, b"x", [("cp1254", 0.5, "tr"), ("koi8-r", 0.2, "ru")])[0] == "cp1254"


def test_koi8_and_mac(monkeypatch):
    ranked = [("koi8-r", 0.5, "ru"), ("cp1251", 0.4, "ru"), ("koi8-t", 0.3, "tg")]
    assert names(K.koi8_t, b"\xc1\x8a", ranked)[0] == "koi8-t" and names(K.koi8_t, b"\xc1", ranked)[0] == "koi8-r"
    ranked = [("cp1252", 0.5, "fr"), ("mac-roman", 0.497, "fr")]
    assert names(K.mac_line_ends, b"a\rb\rc\r", ranked)[0] == "mac-roman"
    assert names(K.mac_line_ends, b"a\rb\rc", ranked)[0] == "cp1252" and names(K.mac_line_ends, b"a\rb\rc\r\n", ranked)[0] == "cp1252"
    assert names(K.mac_line_ends, b"a\rb\rc\r", [("cp1252", 0.5, "fr"), ("mac-roman", 0.49, "fr")])[0] == "cp1252"
    monkeypatch.setattr(E.Evidence, "settle", lambda self, a, b, langs, strict=False: a)
    assert names(K.mac_line_ends, b"a\rb\rc\r", ranked)[0] == "cp1252"


def test_decodable_on_tie():
    ranked = [("cp932", 0.5, "ja"), ("big5hkscs", 0.4, "zh"), ("cp1252", 0.3, "fr")]
    assert names(K.decodable_on_tie, b"caf\xe9", ranked)[0] == "cp1252"
    assert names(K.decodable_on_tie, b"caf\xe9", ranked, cut=True)[0] == "cp932"
    assert names(K.decodable_on_tie, b"\xe9", ranked)[0] == "cp932"
    assert names(K.decodable_on_tie, "語a".encode("cp932") + b"\xe9", ranked)[0] == "cp932"
    # Decodes as its superset, not under the name that is shown.
    assert not K.decodes_under_both_names("①".encode("shift_jis_2004"), "shift_jis_2004")
    assert K.decodes_under_both_names("語".encode("shift_jis_2004"), "shift_jis_2004")


def test_scoring_floor():
    assert K.scoring_floor(0.5, 0.4) == pytest.approx(0.37) and K.scoring_floor(0.1, 0.09) == pytest.approx(0.05)


def test_thin_rare_languages():
    pairs = {"en": [("ab", 10), ("bc", 9), ("cd", 4)], "gd": [("ab", 10), ("bc", 10), ("cd", 4)], "fr": [("xy", 3)]}
    models = M.build(pairs)
    data = b"ab bc bc cd"
    assert models.language(data, "utf-8") == "gd" and models.language(data, "utf-8", thin=True) == "en"
    assert models.language(b"", "utf-8") is None and models.language(b"ab", "koi8-t") is None
    detector = K.Detector(None, models)
    assert detector.language(data, "cp1252", "gd") == "en" and detector.language(data * 20, "cp1252", "gd") == "gd"
    assert detector.language(data, "koi8-t") == R.BY_NAME["koi8-t"].languages[0]
