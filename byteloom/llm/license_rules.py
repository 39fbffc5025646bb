"""License detection with ordered signature rules.

A text is reduced to its lower-case words joined by single spaces. An Aho-Corasick automaton over the
rules' keywords picks the few rules worth trying, and their regular expressions run over the whole text.
Overlapping detections are resolved by priority: a detection goes if the interval of a better one
contains it, better meaning a higher priority, then greater length, then the label that sorts first.
That is decided by one sweep over the sorted intervals for each priority, so a text with any number of
detections takes time in proportion to its length. The rules are written by hand, one line each: texts
of licenses, identifiers, addresses, statements and bare names.

Defined results: null and empty texts have no words, no label and score 0; rows are independent, so
repeated rows get equal results; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from byteloom.llm.common import tune, utf8
from byteloom.llm.license_signatures import SIGNATURES

#: Base phrases and their labels.
BASE = {b"under the mit license": "mit", b"apache license version 2": "apache-2", b"cc by nc": "cc-by-nc"}

#: Bytes that end a word become spaces, A-Z become a-z, all others stay (all of UTF-8's other bytes belong to words).
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))

#: Kind of a signature -> its priority and the weight of a detection in the score.
KINDS = {"id": (99, 0.98), "header": (92, 0.95), "text": (88, 0.95), "address": (85, 0.9), "part": (80, 0.8), "grant": (75, 0.9), "mention": (60, 0.7), "name": (50, 0.5), "weak": (40, 0.3)}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern[str]
    keys: tuple[str, ...]
    priority: int
    weight: float


def build_rules() -> list[Rule]:
    """All rules, highest priority first."""
    rules = [Rule(label, re.compile(rf"(?<= )(?:{pattern})(?= )"), tuple(keys.split("|")), *KINDS[kind]) for label, kind, keys, pattern in SIGNATURES]
    return sorted(rules, key=lambda r: -r.priority)


class Scanner:
    """One worker's compiled rules and keyword automaton."""

    def __init__(self) -> None:
        self.rules = build_rules()
        by_key: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k in r.keys:
                by_key.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, ids in by_key.items():
            self.automaton.add_word(k, tuple(ids))
        self.automaton.make_automaton()

    def detect(self, words: str) -> list[tuple[int, int, Rule]]:
        """Detections (start, end, rule) in words, which must begin and end with a space."""
        tried = set()
        for _, ids in self.automaton.iter(words):
            tried.update(ids)
        found = [(m.start(), m.end(), self.rules[i]) for i in sorted(tried) for m in self.rules[i].pattern.finditer(words)]
        return suppress(found)


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Keep the detections that no better one contains, in order of place.

    Containment is transitive, so it need not be asked whether the better one was itself kept.
    """
    if len(found) < 2:
        return found
    # Starts rise, ends fall, better ones first: whatever contains a detection and is better comes before it.
    found = sorted(found, key=lambda d: (d[0], -d[1], -d[2].priority, d[2].label))
    start, end = np.array([d[0] for d in found]), np.array([d[1] for d in found])
    priority = np.array([d[2].priority for d in found])
    kept = np.ones(len(found), bool)
    for level in np.unique(priority):
        # The farthest end among those of this priority at least that stand before.
        reach = np.maximum.accumulate(np.where(priority >= level, end, -1))
        own = np.flatnonzero(priority == level)
        own = own[own > 0]
        kept[own] &= reach[own - 1] < end[own]
    return [d for d, k in zip(found, kept.tolist(), strict=True) if k]


_SCANNER: list[Scanner] = []


def scan(content: bytes) -> dict:
    """What one text shows; content is its UTF-8."""
    if not _SCANNER:
        _SCANNER.append(Scanner())
    words = content.translate(NORMAL).split()
    line = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in BASE.items():
        whole = b" " + phrase + b" "
        at = line.find(whole)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = line.find(whole, at + 1)
    # A word's number is that of the space before it.
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if places else None
    number = lambda at: int(np.searchsorted(spaces, at))
    found = _SCANNER[0].detect(line.decode("latin-1"))
    miss = exp(sum(log(1 - r.weight) for _, _, r in found))
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": number(min(places)) if places else None,
        "last_word": number(max(places)) if places else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {r.label for _, _, r in found})),
        "score": max(1 - miss, 0.9 if base else 0.0),
        "n_detections": len(found),
    }


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base places, labels and score."""
    tune(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x) for x in batch.column(1).to_pylist()]
            kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kinds.get(k, pa.int64())) for k in names)], [id_col, *names])

    return docs.select(id_col, utf8(text_col).alias("__content")).mapInArrow(run, f"`{id_col}` {id_type}, {FIELDS}")
