"""Token counts by a two-tier lookup of pre-token lengths, without shuffling any pre-token.

Tier one is a table of the commonest pre-tokens with the number of tokens each one becomes, gathered
from a bounded sample of the documents and broadcast. Tier two is each worker's own bounded cache:
a pre-token that the table lacks goes through the library once and is then remembered. The sample
decides only how often tier two is asked, never a count: byte-level BPE works on each pre-token alone,
so the sum over pre-tokens is the library's own count.

Defined results: null and empty texts have 0 tokens; rows are independent; a table without rows gives
none; a text of any length is one sum; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm.common import tune

#: Documents that tier one is gathered from, at most about so many; pre-tokens it holds, at most so many.
SAMPLE_DOCS, TABLE_SIZE = 1024, 32768
#: Pre-tokens that one worker's cache holds before it starts anew, and the longest one that it keeps.
CACHE_SIZE, CACHE_CHARS = 1 << 18, 64


def _cls(*kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] in kinds)


_L, _N, _S = _cls("L"), _cls("N"), " \t\n\r\x0b\x0c"
#: Code points whose class all Unicode versions agree on; a text with any other is split by the library itself.
_SAFE = _L + _N + _S + "".join(re.escape(chr(c)) for c in [*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0xC0), 0xD7, 0xF7, *range(0x2010, 0x2028), 0x20AC])
UNSAFE = re.compile(f"[^{_SAFE}]")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Lookup(dict):
    """Pre-token -> tokens; asks the library for what it does not hold."""

    def __init__(self, path: str, table: dict[str, int]) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(table)
        self.library, self.first = Tokenizer.from_file(path), table
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    def __missing__(self, piece: str) -> int:
        n = len(self.library.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_SIZE + len(self.first):
                self.clear()
                self.update(self.first)
            self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        if UNSAFE.search(text) is None:
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts if p)


_LOOKUPS: dict[tuple, Lookup] = {}


def lookup(path: str, table: dict[str, int], key: str) -> Lookup:
    if (path, key) not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[path, key] = Lookup(path, table)
    return _LOOKUPS[path, key]


def frequent(docs: DataFrame, path: str, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, size: int = TABLE_SIZE) -> dict[str, int]:
    """Tier one: the commonest pre-tokens of a sample, each with its tokens.

    A task hands over at most size pre-tokens of the few documents it drew, so what reaches the driver
    is bounded by the sample.
    """
    rows = docs.count()
    some = docs.select(text_col) if rows <= sample_docs else docs.select(text_col).sample(False, sample_docs / rows, 7)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = lookup(path, {}, "gather"), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in own.special.split(text) if own.special and text else [text]:
                    if part:
                        seen.update(p for p in own.pieces(part) if len(p) <= CACHE_CHARS)
        top = seen.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array([own[p] for p, _ in top], pa.int64())], ["piece", "n", "tokens"])

    table = some.mapInArrow(gather, "piece string, n long, tokens long").toArrow()
    top = table.group_by("piece").aggregate([("n", "sum"), ("tokens", "max")]).sort_by([("n_sum", "descending"), ("piece", "ascending")]).slice(0, size)
    return dict(zip(top["piece"].to_pylist(), top["tokens_max"].to_pylist(), strict=True))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: bytes, tokens, and whether there are more tokens than limit."""
    spark = docs.sparkSession
    tune(spark)
    shared, key = spark.sparkContext.broadcast(frequent(docs, path, text_col)), uuid.uuid4().hex
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lookup(path, shared.value, key)
        for batch in batches:
            counts = pa.array([own.count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], [id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("__text"))
    counted = rows.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
