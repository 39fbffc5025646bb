"""What the bytes that two encodings read differently say about one value.

A vote weighs every such byte by the kind of character that it would be and by its neighbours; models compare
the two encodings on nothing but the bigrams that hold such a byte.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

from byteloom.functions import charset as C
from byteloom.functions import registry as R
from byteloom.functions.models import SCORE_BYTES, Models

# Weight of a character by its category, and of a letter where none is expected.
WEIGHTS = {
    "Lu": 10, "Ll": 10, "Lt": 10, "Lm": 9, "Lo": 9, "Nd": 8, "Nl": 7, "No": 7,
    "Pc": 6, "Pd": 6, "Ps": 6, "Pe": 6, "Pi": 6, "Pf": 6, "Po": 6,
    "Sc": 5, "Sm": 5, "Sk": 4, "So": 4, "Zs": 3, "Zl": 3, "Zp": 3,
    "Cf": 2, "Cc": 1, "Co": 1, "Cs": 0, "Cn": 0, "Mn": 5, "Mc": 5, "Me": 5,
}
STRAY_LETTER = 2
# Occurrences of a byte that count, what makes a vote decisive, differing bytes that make encodings unlike.
VOTES, DECISIVE, DECISIVE_PLACES, UNLIKE = 256, 8, 2, 52
#: The language of text that is none.
ART = "zxx"


@cache
def characters(encoding: str) -> tuple[str | None, ...]:
    """Each byte's character under a single-byte encoding, none where it has none; multibyte encodings have none at all."""
    entry = R.BY_NAME.get(encoding)
    if entry is None or entry.is_multibyte or encoding.startswith("utf"):
        return (None,) * 256
    read = [bytes([b]).decode(C.PYTHON_NAMES.get(encoding, encoding), "replace") for b in range(256)]
    return tuple(None if c == "�" else c for c in read)


@cache
def differing(a: str, b: str) -> frozenset[int]:
    """The high bytes that two encodings read differently."""
    x, y = characters(a), characters(b)
    return frozenset(k for k in range(0x80, 256) if x[k] != y[k])


@cache
def confusable_bytes(a: str, b: str) -> frozenset[int]:
    """All bytes that two single-byte encodings read differently; none where either is multibyte."""
    x, y = characters(a), characters(b)
    return frozenset(k for k in range(256) if x[k] != y[k]) if any(x) and any(y) else frozenset()


@dataclass(frozen=True)
class Reading:
    """For each byte under an encoding: its weight, and whether it is a letter, punctuation, a capital or a small letter."""

    weight: np.ndarray
    letter: np.ndarray
    punctuation: np.ndarray
    capital: np.ndarray
    small: np.ndarray


@cache
def reading(encoding: str) -> Reading:
    kinds = ["Cn" if c is None else unicodedata.category(c) for c in characters(encoding)]
    flags = [np.array([k in wanted or k[0] in wanted for k in kinds]) for wanted in (("L",), ("P",), ("Lu",), ("Ll",))]
    return Reading(np.array([WEIGHTS[k] for k in kinds]), *flags)


def _weights(r: Reading, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A letter is out of place between two bytes that are none, and a small one before a capital."""
    stray = ~(r.letter[before] | r.letter[after]) | (r.small[at] & r.capital[after])
    return np.where(r.letter[at] & stray, STRAY_LETTER, r.weight[at])


class Evidence:
    """One value, and the models if there are any; answers which of two encodings its bytes favour."""

    def __init__(self, data: bytes, models: Models | None = None) -> None:
        self.data, self.models = data, models
        self.seen = np.frombuffer(data, np.uint8).astype(np.int64)

    def _is_odd(self, odd: frozenset[int]) -> np.ndarray:
        member = np.zeros(256, bool)
        member[list(odd)] = True
        return member[self.seen]

    def vote(self, a: str, b: str, odd: frozenset[int]) -> tuple[str | None, bool]:
        """(the encoding with more weight at the first VOTES places of each byte of odd, whether that is decisive).

        A letter does not gain over punctuation. Decisive: letters out of place under the other one cost it DECISIVE
        or more, at DECISIVE_PLACES or more. None on ties.
        """
        places = np.flatnonzero(self._is_odd(odd))
        order = np.argsort(self.seen[places], kind="stable")
        values = self.seen[places][order]
        nth = np.arange(len(values)) - np.searchsorted(values, values)
        places = places[order][nth < VOTES]
        padded = np.concatenate([[0], self.seen, [0]])
        at, before, after = padded[places + 1], padded[places], padded[places + 2]
        x, y = reading(a), reading(b)
        wx, wy = _weights(x, at, before, after), _weights(y, at, before, after)
        gap = wx - wy
        gap[(gap > 0) & x.letter[at] & y.punctuation[at]] = 0
        gap[(gap < 0) & y.letter[at] & x.punctuation[at]] = 0
        total = int(gap.sum())
        if total == 0:
            return None, False
        gain, lost, weight = (gap, y, wy) if total > 0 else (-gap, x, wx)
        telling = gain[(gain > 0) & lost.letter[at] & (weight == STRAY_LETTER)]
        return (a if total > 0 else b), bool(telling.sum() >= DECISIVE and len(telling) >= DECISIVE_PLACES)

    def rescore(self, a: str, b: str, odd: frozenset[int], langs_a: frozenset[str] | None, langs_b: frozenset[str] | None) -> str | None:
        """The encoding whose models (of the languages given, else of all) are nearer on the bigrams that hold a byte of odd."""
        if self.models is None or len(self.seen) < 2:
            return None
        is_odd = self._is_odd(odd)
        pairs = (self.seen[:-1] * 256 + self.seen[1:])[is_odd[:-1] | is_odd[1:]]
        if not len(pairs):
            return None
        found, counts = np.unique(pairs, return_counts=True)
        values = counts * self.models.idf[found]
        x, y = self.models.nearest(found, values, a, langs_a), self.models.nearest(found, values, b, langs_b)
        return a if x > y else b if y > x else None

    def comparable(self, a: str, b: str, languages: frozenset[str]) -> frozenset[str] | None:
        """The languages modelled under both encodings, if all of languages are among them; else none, which means no restriction."""
        if not languages or self.models is None:
            return None
        x, y = self.models.languages(a), self.models.languages(b)
        if not languages <= x & y:
            return None
        return x & y | ({ART} & (x | y))

    def arbitrate(self, a: str, b: str, odd: frozenset[int], langs_a: frozenset[str] | None, langs_b: frozenset[str] | None) -> str | None:
        """Models on the bytes of odd; the vote where they say nothing."""
        return self.rescore(a, b, odd, langs_a, langs_b) or self.vote(a, b, odd)[0]

    def settle(self, a: str, b: str, languages: frozenset[str], strict: bool = False) -> str | None:
        """The winner of two single-byte encodings: a decisive vote, else models, else the vote.

        Unlike encodings (UNLIKE differing bytes or more), and strict calls without a decisive vote, need models and vote to agree.
        """
        odd = confusable_bytes(a, b)
        if not odd:
            return None
        voted, decisive = self.vote(a, b, odd)
        unlike = len(odd) >= UNLIKE
        if decisive and not unlike:
            return voted
        shared = self.comparable(a, b, languages)
        scored = self.rescore(a, b, odd, shared, shared)
        if unlike or strict:
            return scored if scored == voted else None
        return scored or voted

    def known(self, encoding: str, language: str | None) -> bool:
        """Whether a bigram with a high byte, in the scored part, is in a model of the encoding (of that language, if given)."""
        if self.models is None:
            return False
        b = self.seen[:SCORE_BYTES]
        pairs = np.unique((b[:-1] * 256 + b[1:])[(b[:-1] >= 0x80) | (b[1:] >= 0x80)])
        rows = self.models.rows_of(encoding, None if language is None else frozenset({language}))
        return bool(len(rows) and len(pairs) and self.models.weights[np.ix_(rows, pairs)].any())
