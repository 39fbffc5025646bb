"""The whole cascade for one value, and the corrections of a statistical ranking.

A result is (encoding, confidence, language, mime_type). Models are this engine's own, so statistical
confidences are its own too; deterministic results follow fixed rules.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import takewhile

from byteloom.functions import charset as C
from byteloom.functions import registry as R
from byteloom.functions.evidence import ART, Evidence, differing
from byteloom.functions.models import LANGUAGE_BYTES, RARE, SCORE_BYTES, Models

Result = tuple[str | None, float, str | None, str | None]
NONE: Result = (None, 0.0, None, None)
# Confidences and margins.
SURE, FALLBACK, BAND, DEAD_HEAT, MINIMUM = 0.95, 0.10, 0.005, 1e-4, 0.20
STRUCTURAL, FULL_COVERAGE = 0.85, 0.95
#: A model's cosine from which on encodings without models are not guessed at.
TOLD = 0.15
RARE_BELOW, RARE_WITHIN, THIN, CR_LINES = 0.15, 0.02, 128, 3
# A first below LOW is unsure; the walk then goes down to this share of it.
LOW, LOW_SHARE = 0.2, 0.5
COMMON_LATIN = ("iso8859-1", "iso8859-15", "cp1252")
# Niche encodings of Latin script and the bytes that are their own.
NICHE_LATIN = {
    "iso8859-10": frozenset(bytes.fromhex(
        "A1 A2 A3 A4 A5 A6 A8 A9 AA AB AC AE AF B1 B2 B3 B4 B5 B6 B8 B9 BA BB BC BD BE BF C0 C7 C8 CA CC D1 D2 D7 D9 E0 E7 E8 EA EC F1 F2 F7 F9 FF"
    )),
    "iso8859-14": frozenset(bytes.fromhex("A1 A2 A4 A5 A6 A8 AA AB AC AF B0 B1 B2 B3 B4 B5 B7 B8 B9 BA BB BC BD BE BF D0 D7 DE F0 F7 FE")),
    "cp1254": frozenset(bytes.fromhex("D0 DD DE F0 FD FE")),
    "hp-roman8": frozenset(bytes.fromhex("C0 C1 C2 C3 C4 C5 C6 C7 C8 C9 CA CB CC CD CE CF D1 D4 D5 D6 D9 DD DE")),
}
KOI8_T = bytes([0x80, 0x81, 0x83, 0x8A, 0x8C, 0x8D, 0x8E, 0x90, 0xA1, 0xA2, 0xA5, 0xB5])
ESCAPES = (
    ((b"\x1b$(O", b"\x1b$(P", b"\x1b$(Q"), "iso2022_jp_2004", "ja"),
    ((b"\x1b(I",), "iso2022_jp_ext", "ja"),
    ((b"\x1b$B", b"\x1b$@", b"\x1b(J", b"\x1b$(D"), "iso2022_jp_2", "ja"),
    ((b"\x1b$)C",), "iso2022_kr", "ko"),
)
# Lead bytes of the commonest characters of multibyte encodings; used where no model is at hand.
COMMON_LEADS = {
    "cp932": ((0x81, 0x83), (0x88, 0x97)), "shift_jis_2004": ((0x81, 0x83), (0x88, 0x97)), "euc_jis_2004": ((0xA1, 0xA1), (0xA4, 0xA5), (0xB0, 0xCF)),
    "euc_kr": ((0xA1, 0xA1), (0xB0, 0xC8)), "cp949": ((0xA1, 0xA1), (0xB0, 0xC8)), "gb18030": ((0xA1, 0xA1), (0xA3, 0xA3), (0xB0, 0xD7)), "big5hkscs": ((0xA1, 0xA1), (0xA4, 0xC6)), "johab": ((0x88, 0xD3),),
}


@dataclass(frozen=True)
class Options:
    encoding_era: int = int(R.Era.ALL)
    max_bytes: int = 200_000
    prefer_superset: bool = False
    compat_names: bool = True
    include_encodings: tuple[str, ...] | None = None
    exclude_encodings: tuple[str, ...] | None = None
    no_match_encoding: str = "cp1252"
    empty_input_encoding: str = "utf-8"
    ignore_threshold: bool = False

    def checked(self) -> Options:
        """Names resolved; unknown names, empty filters and a window below one byte are errors."""
        if self.max_bytes < 1:
            raise ValueError("max_bytes must be a positive integer")
        listed = lambda names: None if names is None else tuple(sorted(R.filtered(names) or ()))
        return replace(self, include_encodings=listed(self.include_encodings), exclude_encodings=listed(self.exclude_encodings), no_match_encoding=R.validate(self.no_match_encoding), empty_input_encoding=R.validate(self.empty_input_encoding))


def promote(ranked: list[Result], i: int) -> list[Result]:
    """Result i first, with the confidence of the old first."""
    encoding, _, language, mime = ranked[i]
    return [(encoding, ranked[0][1], language, mime), *ranked[:i], *ranked[i + 1 :]]


def _era(encoding: str | None) -> int:
    return R.BY_NAME[encoding].era if encoding in R.BY_NAME else int(R.Era.ALL)


def _within(ranked: list[Result], band: float) -> list[int]:
    """Places behind the first, up to the first one whose confidence is further off than band."""
    return list(takewhile(lambda i: ranked[0][1] - ranked[i][1] <= band, range(1, len(ranked))))


def _spoken(*results: Result) -> frozenset[str]:
    return frozenset(r[2] for r in results if r[2])


def superset_on_dead_heat(seen: Evidence, ranked: list[Result], cut: bool) -> list[Result]:
    wanted = {"shift_jis_2004": "cp932", "euc_kr": "cp949"}.get(ranked[0][0])
    return next((promote(ranked, i) for i in _within(ranked, DEAD_HEAT) if ranked[i][0] == wanted and C.decodes(seen.data, wanted)), ranked)


def prevalent_on_dead_heat(seen: Evidence, ranked: list[Result], cut: bool) -> list[Result]:
    """The commonest era wins, but where models know the first's high bytes it must also read the differing bytes better."""
    top = ranked[0]
    rivals = [i for i in _within(ranked, DEAD_HEAT) if _era(ranked[i][0]) < _era(top[0])]
    if not rivals:
        return ranked
    i = min(rivals, key=lambda k: (_era(ranked[k][0]), k))
    if seen.known(top[0], top[2]):
        rival = ranked[i]
        shared = seen.comparable(top[0], rival[0], _spoken(top, rival))
        if seen.arbitrate(top[0], rival[0], differing(top[0], rival[0]), shared, shared) != rival[0]:
            return ranked
    return promote(ranked, i)


def rare_language(seen: Evidence, ranked: list[Result], cut: bool) -> list[Result]:
    if ranked[0][2] not in RARE or ranked[0][1] >= RARE_BELOW:
        return ranked
    return next((promote(ranked, i) for i in _within(ranked, RARE_WITHIN) if ranked[i][2] and ranked[i][2] not in RARE), ranked)


def confusable(seen: Evidence, ranked: list[Result], cut: bool) -> list[Result]:
    """Walks down the ranking with a champion. The second, and any within the band, wins at once if it beats the champion.

    Below an unsure first (LOW), the walk goes on to half its confidence; there models and vote must agree, and the last to win stays.
    """
    best, lead = 0, ranked[0][1]
    if ranked[0][2] == ART:
        return ranked
    for i, rival in enumerate(ranked[1:], 1):
        near = i == 1 or lead - rival[1] <= BAND
        if not near and (lead >= LOW or rival[1] < lead * LOW_SHARE):
            break
        champion = ranked[best]
        if seen.settle(champion[0], rival[0], _spoken(champion, rival), strict=not near) == rival[0]:
            best = i
            if near:
                break
    return promote(ranked, best) if best else ranked


def niche_latin(seen: Evidence, ranked: list[Result], cut: bool) -> list[Result]:
    """A niche encoding goes last unless a byte of its own is seen and it is clearly ahead or reads those bytes better."""
    top = ranked[0]
    rivals = [i for i in range(1, len(ranked)) if ranked[i][0] in COMMON_LATIN]
    if top[0] not in NICHE_LATIN or not rivals:
        return ranked
    lead = max(ranked[i][1] for i in rivals)
    i = min((k for k in rivals if lead - ranked[k][1] <= DEAD_HEAT), key=lambda k: (_era(ranked[k][0]), k))
    own, rival = NICHE_LATIN[top[0]], ranked[i]
    if own & set(seen.data):
        speaks = lambda r: _spoken(r) or None
        if top[1] - rival[1] > BAND or seen.arbitrate(top[0], rival[0], own, speaks(top), speaks(rival)) == top[0]:
            return ranked
    others = [r for k, r in enumerate(ranked) if k not in (0, i)]
    last = (top[0], min(top[1], others[-1][1] if others else top[1]), *top[2:])
    return [promote(ranked, i)[0], *others, last]


def koi8_t(seen: Evidence, ranked: list[Result], cut: bool) -> list[Result]:
    if ranked[0][0] != "koi8-r" or len(seen.data.translate(None, KOI8_T)) == len(seen.data):
        return ranked
    return next((promote(ranked, i) for i, r in enumerate(ranked) if r[0] == "koi8-t"), ranked)


def mac_line_ends(seen: Evidence, ranked: list[Result], cut: bool) -> list[Result]:
    """Lines that end in bare carriage returns speak for a Mac encoding near the first, unless the bytes speak for the first."""
    mac, top = int(R.Era.LEGACY_MAC), ranked[0]
    if _era(top[0]) == mac or top[2] == ART or b"\n" in seen.data or seen.data.count(b"\r") < CR_LINES:
        return ranked
    i = next((k for k in _within(ranked, BAND) if _era(ranked[k][0]) == mac), None)
    if i is None or seen.settle(top[0], ranked[i][0], _spoken(top, ranked[i])) == top[0]:
        return ranked
    return promote(ranked, i)


def cut_after_ascii(data: bytes, encoding: str) -> bool:
    """Whether a value reads as plain text and then the beginning of one character."""
    if C.decodes(data, encoding, whole=True) or not C.decodes(data, encoding):
        return False
    whole = next((data[:-k] for k in range(1, 8) if C.decodes(data[:-k], encoding, whole=True)), b"")
    text = whole.decode(C.PYTHON_NAMES.get(encoding, encoding), "ignore")
    return bool(text) and text.isascii()


def decodes_under_both_names(data: bytes, encoding: str) -> bool:
    """Whether a value decodes whole under an encoding and under the one that its displayed name stands for."""
    if not C.decodes(data, encoding, whole=True):
        return False
    try:
        data.decode(R.DISPLAY.get(encoding, "latin-1"))
    except UnicodeDecodeError:
        return False
    except LookupError:
        return True
    return True


def decodable_on_tie(seen: Evidence, ranked: list[Result], cut: bool) -> list[Result]:
    """Where the first would leave a cut character after plain text, the first that decodes whole."""
    if cut or not any(b >= 0x80 for b in seen.data[-4:]) or not cut_after_ascii(seen.data, ranked[0][0]):
        return ranked
    return next((promote(ranked, i) for i in range(1, len(ranked)) if decodes_under_both_names(seen.data, ranked[i][0])), ranked)


CORRECTIONS: tuple[Callable[[Evidence, list[Result], bool], list[Result]], ...] = (superset_on_dead_heat, prevalent_on_dead_heat, rare_language, confusable, niche_latin, koi8_t, mac_line_ends, decodable_on_tie)


def corrected(seen: Evidence, ranked: list[Result], cut: bool) -> list[Result]:
    """A ranking after all corrections, in their order; one result alone stays as it is."""
    for step in CORRECTIONS if len(ranked) > 1 else ():
        ranked = step(seen, ranked, cut)
    return ranked


def scoring_floor(first: float, second: float) -> float:
    """The confidence below which no correction can lift a result, given the first two."""
    floor = second - (RARE_WITHIN + 2 * BAND)
    return min(floor, first * LOW_SHARE) if first < LOW else floor


def common_leads(data: bytes, encoding: str) -> tuple[float, float]:
    """Mean log density of a multibyte text's lead bytes, and the share that is common."""
    whole = [x[0] for x in C._SCANNERS[encoding].findall(data) if x]
    width = sum(b - a + 1 for a, b in COMMON_LEADS[encoding])
    share = sum(any(a <= x <= b for a, b in COMMON_LEADS[encoding]) for x in whole) / max(1, len(whole))
    return share * math.log(0.95 / width) + (1 - share) * math.log(0.05 / 128), share


class Detector:
    """Ranks the encodings of one value; holds the options and, if given, the models."""

    def __init__(self, options: Options | None = None, models: Models | None = None) -> None:
        self.options = (options or Options()).checked()
        self.models = models
        chosen = R.candidates(self.options.encoding_era, self.options.include_encodings, self.options.exclude_encodings)
        self.candidates = {e.name: e for e in chosen}
        self.allowed = frozenset(self.candidates)

    def _fallback(self, name: str) -> list[Result]:
        return [(name, FALLBACK, None, None)] if name in self.allowed else [NONE]

    def certain(self, data: bytes) -> list[Result] | None:
        """What byte patterns and declarations tell for sure, else none."""
        if not data:
            return self._fallback(self.options.empty_input_encoding)
        mark = next((e for s, e in BOMS if data.startswith(s) and (e != "utf-32" or len(data) % 4 == 0)), "utf-7" if C.utf7_marked(data) else None)
        if mark in self.allowed:
            return [(mark, 1.0, None, None)]
        wide = C.utf1632(data) if b"\0" in data[: C.SAMPLE] else None
        if wide in self.allowed:
            return [(wide, SURE, None, None)]
        escaped = self._escaped(data)
        if escaped and escaped[0] in self.allowed:
            return [(escaped[0], SURE, escaped[1], None)]
        return None

    def _escaped(self, data: bytes) -> tuple[str, str | None] | None:
        if b"\x1b" in data:
            for marks, name, language in ESCAPES:
                if any(m in data for m in marks):
                    shifted = name == "iso2022_jp_2" and b"\x0e" in data and b"\x0f" in data
                    return ("iso2022_jp_ext" if shifted else name), language
        if b"~{" in data and C.has_hz(data):
            return "hz", "zh"
        if b"+" in data and data.isascii() and C.has_utf7(data):
            return "utf-7", None
        return None

    def text(self, data: bytes, cut: bool) -> list[Result]:
        """The stages after the file signatures."""
        valid, utf8 = C.utf8_scan(data)
        plain = C.ascii_confidence(data)
        if utf8 is None and plain is None and C.is_binary(data):
            return [(None, SURE, None, "application/octet-stream")]
        marked = C.markup(data)
        if marked and marked[0] in self.allowed:
            if utf8 is not None and marked[0] != "utf-8" and "utf-8" in self.allowed:
                return [("utf-8", utf8, None, marked[1])]
            return [(C.promoted(data, marked[0], self.allowed), SURE, None, marked[1])]
        if plain is not None and "ascii" in self.allowed:
            return [("ascii", plain, None, None)]
        if utf8 is not None and "utf-8" in self.allowed:
            return [("utf-8", utf8, None, None)]
        return self.statistical(data, valid, cut)

    def statistical(self, data: bytes, utf8_valid: bool, cut: bool) -> list[Result]:
        evidence = data[: C.EVIDENCE]
        valid = [e for e in self.candidates.values() if C.decodes(evidence, e.name) and (utf8_valid or e.name != "utf-8")]
        gates = {e.name: C.plausible_multibyte(evidence, e.name) for e in valid if e.is_multibyte}
        valid = [e for e in valid if not e.is_multibyte or gates[e.name]]
        head = evidence[:SCORE_BYTES]
        found = self.models.best(head, [e.name for e in valid]) if self.models else {}
        ranked: list[Result] = [(e.name, *found[e.name], None) for e in valid if e.name in found]
        strong = [name for name, g in gates.items() if g and g[0] >= STRUCTURAL]
        told = max((r[1] for r in ranked), default=0.0) >= TOLD
        if strong:
            ranked = [(e, c * (1 + gates[e][1]) if gates.get(e) and gates[e][1] >= FULL_COVERAGE else c, lang, m) for e, c, lang, m in ranked]
            ranked += [] if told else self._unmodelled(head, [n for n in strong if n not in found])
        ranked.sort(key=lambda r: -r[1])
        if not ranked:
            return self._fallback(self.options.no_match_encoding)
        ranked = corrected(Evidence(evidence, self.models), ranked, cut)
        if len(data) > len(evidence):
            whole = next((r for r in ranked if C.decodes(data, r[0])), None)
            return [whole] if whole else self._fallback(self.options.no_match_encoding)
        return ranked

    def _unmodelled(self, data: bytes, names: list[str]) -> list[Result]:
        """Multibyte encodings without a model, by how common their lead bytes are; most high bytes must stand in runs."""
        high = len(data.translate(None, bytes(range(0x80))))
        runs = sum(len(x) for x in C.re.findall(rb"[\x80-\xff]{2,}", data))
        scored = {n: common_leads(data, n) for n in names}
        if not scored or runs < 0.6 * high:
            return []
        best = max(s[0] for s in scored.values())
        only = lambda n: R.BY_NAME[n].languages[0]
        return [(n, round(0.9 * share * math.exp(density - best), 6), only(n), None) for n, (density, share) in scored.items()]

    def language(self, data: bytes, encoding: str, given: str | None = None) -> str | None:
        """The only language of an encoding, else the nearest model's under it, else that of the text as UTF-8.

        A language that is given stays, but in values below THIN bytes a rare one is looked at again.
        """
        head = data[:LANGUAGE_BYTES]
        thin = 0 < len(head) < THIN
        again = thin and given in RARE
        if given and not again:
            return given
        listed = R.BY_NAME[encoding].languages if encoding in R.BY_NAME else ()
        found = listed[0] if len(listed) == 1 and not again else None
        if self.models and head:
            found = found or self.models.language(head, encoding, thin)
            if found is None or (thin and found in RARE):
                text = head.decode(C.PYTHON_NAMES.get(encoding, encoding), "ignore")
                read = self.models.language(text.encode("utf-8", "ignore"), "utf-8", thin)
                if found is None or (read and read not in RARE):
                    found = read
        return given if found is None or (again and found in RARE) else found

    def finish(self, data: bytes, ranked: list[Result]) -> list[Result]:
        """Languages (zxx: none), default types, and confidences held to 1."""
        out = []
        for encoding, confidence, language, mime in ranked:
            language = self.language(data, encoding, language) if encoding else language
            out.append((encoding, min(1.0, confidence), None if language == "zxx" else language, mime or ("text/plain" if encoding else "application/octet-stream")))
        return out

    def names(self, data: bytes, result: Result) -> Result:
        encoding = result[0]
        if self.options.prefer_superset and encoding in R.SUPERSETS and C.decodes(data, R.SUPERSETS[encoding]):
            encoding = R.SUPERSETS[encoding]
        if self.options.compat_names:
            encoding = R.DISPLAY.get(encoding, encoding)
        return (encoding, *result[1:])

    def above_threshold(self, ranked: list[Result]) -> list[Result]:
        kept = ranked if self.options.ignore_threshold else [r for r in ranked if r[1] > MINIMUM] or ranked
        return sorted(kept, key=lambda r: -r[1])


# Byte order marks and their encodings, in the order in which they are tried.
BOMS = ((b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xfe\xff", "utf-16"), (b"\xff\xfe", "utf-16"))
