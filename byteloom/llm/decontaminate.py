"""Benchmark decontamination by size-partitioned MinHash containment.

Items are partitioned by the size of their shingle sets. An item with n shingles is found in a text
only if at least ceil(0.8 n) of them stand there, so of any n - ceil(0.8 n) + 1 of its shingles one
does. Each item is therefore sketched by just so many of its smallest hashes (bottom-k MinHash, with k
set by the size partition), and a text is a candidate for an item if it holds one of them: no item is
missed, whatever the text's length, which banded signatures of long texts can't promise. Candidates
are then verified by exact containment of the shingles themselves.

The items are a query set: they go to the workers in blocks of bounded size, and each block meets all
documents. Words are runs of letters, digits and code points from 128, in lower case; a shingle has five words,
and an item with fewer words is one shingle of all of them.

Defined results: null and empty texts and items hold nothing and match nothing; repeated rows each get
their own result rows, repeated items likewise; null ids are carried along; without items or documents
there are no pairs; other columns are ignored by contaminated and kept by filter_documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from byteloom.llm.common import DOC, materialize, packed, tune, utf8
from byteloom.llm.license_rules import NORMAL

WORDS, SIMILARITY = 5, 0.8
#: Bytes of item text that go to the workers at a time.
BLOCK_BYTES = 32 << 20


def words(content: bytes) -> list[bytes]:
    return content.translate(NORMAL).split()


def shingles(w: list[bytes], n: int = WORDS) -> list[bytes]:
    return [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


class Sketches:
    """The items of one block: sketch hash -> items, by shingle width, and each item's shingles."""

    def __init__(self, items: list[tuple[object, bytes]], similarity: float = SIMILARITY) -> None:
        self.ids, self.sets, self.need = [], [], []
        by_size: dict[int, list[int]] = defaultdict(list)
        self.widths: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.width = []
        for key, content in items:
            w = words(content)
            if not w:
                continue
            k = min(WORDS, len(w))
            self.ids.append(key)
            self.width.append(k)
            self.sets.append(frozenset(shingles(w, k)))
            self.need.append(math.ceil(similarity * len(self.sets[-1]) - 1e-9))
            by_size[len(self.sets[-1]).bit_length()].append(len(self.ids) - 1)
        for members in by_size.values():
            most = max(len(self.sets[i]) - self.need[i] + 1 for i in members)
            for i in members:
                for h in sorted(map(xxhash.xxh64_intdigest, self.sets[i]))[:most]:
                    self.widths[self.width[i]][h].append(i)
        self.sorted = {k: np.array(sorted(table), np.uint64) for k, table in self.widths.items()}

    def matches(self, content: bytes) -> list[tuple[object, int, int]]:
        """(item, shingles of it that stand in the text, shingles it has), for those that are found."""
        w = words(content)
        out = []
        for k, known in self.sorted.items():
            if len(w) < k:
                continue
            here = shingles(w, k)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, here), np.uint64, len(here))
            at = np.searchsorted(known, hashes)
            hit = hashes[known[np.minimum(at, len(known) - 1)] == hashes]
            if not len(hit):
                continue
            own = set(here)
            for i in sorted({i for h in set(hit.tolist()) for i in self.widths[k][h]}):
                n = len(own & self.sets[i])
                if n >= self.need[i]:
                    out.append((self.ids[i], n, len(self.sets[i])))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded bytes, streamed to the driver partition by partition."""
    block, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), utf8(text_col).alias("t")).toLocalIterator():
        block.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _matched(docs: DataFrame, keep: list[str], block: list, item_type: DataType, text_col: str, negate: bool) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(block)
    cache: list[Sketches] = []

    def sketches() -> Sketches:
        if not cache:
            cache.append(Sketches(shared.value))
        return cache[0]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            rows = [(i, *m) for i, x in enumerate(batch.column(n).to_pylist()) for m in sketches().matches(x)]
            which = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(which) for c in batch.columns[:n]), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa_item), (2, pa.int64()), (3, pa.int64())))], [*batch.schema.names[:n], "item_id", "n_shared", "n_item"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            which = pa.array([i for i, x in enumerate(batch.column(n).to_pylist()) if not sketches().matches(x)], pa.int64())
            yield pa.RecordBatch.from_arrays([c.take(which) for c in batch.columns[:n]], batch.schema.names[:n])

    pa_item = to_arrow_type(item_type)
    schema = docs.select(*keep).schema
    rows = docs.select(*keep, utf8(text_col).alias("__content"))
    return rows.mapInArrow(clean, schema) if negate else rows.mapInArrow(pairs, schema.add("item_id", item_type).add("n_shared", "long").add("n_item", "long"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Pairs (document, item) with the containment of the item in the document, 0.8 or more."""
    kind = items.schema[item_col].dataType
    out = None
    for block in _blocks(items, item_col, text_col):
        part = _matched(docs, [id_col], block, kind, text_col, False)
        out = part if out is None else out.union(part)
    if out is None:
        out = _matched(docs, [id_col], [], kind, text_col, False)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def filter_documents(docs: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    kind, out = items.schema[item_col].dataType, packed(docs)
    for k, block in enumerate(_blocks(items, item_col, text_col)):
        out = _matched(materialize(out, "clean") if k else out, [DOC], block, kind, f"{DOC}.{text_col}", True)
    return out.select(f"{DOC}.*")
