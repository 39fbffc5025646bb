"""SimHash near-duplicates by vantage-point trees.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most one bit of one of their two
halves. So there are two trees, each over one half and searched with radius 1, and together they find
every pair. A tree is fitted on a bounded sample of fingerprints; each inner node has a vantage point
and a distance, and sends a fingerprint left or right by its Hamming distance. The triangle
inequality prunes: a fingerprint also visits the other side of a node only if its distance is within
the radius of that node's boundary. Every fingerprint has one home shard and is a mere visitor in the
boundary-overlapping shards. A shard compares homes with homes and visitors on all 64 bits, exactly,
and gives a spanning forest of the links, not all pairs. Shards too large for that are split again by
the same rule. Where very many fingerprints share one half, no tree over that half can part them: then
the other half, which may differ in 3 bits, is cut in two quarters, of which one differs in at most one
bit, and such a shard is dealt by two trees over the quarters, again with radius 1. What is still too
large for a task is dealt in blocks over tasks.

Defined results: null and empty texts have fingerprint zero and link like any other; equal rows
share a component; null ids never represent one; an empty table gives an empty result; a text
of any length is hashed whole; other columns are ignored by simhash_dedup and kept by filter_documents.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm.common import DOC, discard, materialize, packed, tune, utf8
from byteloom.llm.components import connected_components

BITS, RADIUS, SEED = 3, 1, 42
#: Fingerprints that the trees are fitted on, at most about so many; fingerprints that a shard should hold.
SAMPLE, SHARD = 1 << 17, 1024
#: Fingerprints that a task deals out; levels of a tree at most.
DEAL, DEPTH = 1 << 16, 20
#: A shard with more homes than this in one task is split again there; one with more rows than this is dealt in blocks.
LOCAL, BLOCK = 2048, 1 << 18
#: Bitmaps of kept rows that are broadcast at a time, 4096 bytes each.
BITMAPS = 1 << 14


def simhash(content: bytes) -> int:
    """The fingerprint of a text given as UTF-8."""
    words = content.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else list(map(b" ".join, zip(words, words[1:], words[2:], strict=False)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns and fp, the fingerprint as a signed long; written to the shared folder."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            fps = np.fromiter((simhash(x) for x in batch.column(n).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(fps.view(np.int64))], [*batch.schema.names[:n], "__fp"])

    out = docs.select(*keep).schema.add("__fp", "long")
    return materialize(docs.select(*keep, utf8(text_col).alias("__content")).mapInArrow(run, out), "fingerprints")


@dataclass
class Tree:
    """Nodes by number: vantage, boundary, children (left, right); a leaf's children are -1."""

    vantage: np.ndarray
    boundary: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def route(self, half: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, which, home): the leaves that each value must be in, as home or visitor.

        A home beyond a boundary visits the near side as well; a home on the near side need not visit the
        far one, as the partner there comes to it. A visitor goes wherever a home within the radius may be.
        """
        stack = [(0, np.arange(len(half)), home)]
        while stack:
            node, which, own = stack.pop()
            if not len(which):
                continue
            if self.left[node] < 0:
                yield node, which, own
                continue
            d = np.bitwise_count(half[which] ^ self.vantage[node]).astype(np.int16)
            mu = self.boundary[node]
            go_left = d <= mu + RADIUS
            stack.append((int(self.left[node]), which[go_left], own[go_left] & (d[go_left] <= mu)))
            go_right = np.where(own, d > mu, d > mu - RADIUS)
            stack.append((int(self.right[node]), which[go_right], own[go_right]))


def fit_tree(half: np.ndarray, depth: int, least: int, seed: int = 1) -> Tree:
    """Split until depth, or fewer than least values, or no split that overlaps little enough is found."""
    rng = random.Random(seed)
    vantage, boundary, left, right = [], [], [], []

    def node(values: np.ndarray, level: int) -> int:
        k = len(vantage)
        vantage.append(0), boundary.append(0), left.append(-1), right.append(-1)
        if level >= depth or len(values) < least:
            return k
        best = None
        for _ in range(12):
            point = int(values[rng.randrange(len(values))]) ^ (rng.getrandbits(32) if rng.random() < 0.5 else 0)
            share = np.bincount(np.bitwise_count(values ^ np.uint32(point)), minlength=33) / len(values)
            cum = np.cumsum(share)
            for mu in range(32):
                if 0.2 <= cum[mu] <= 0.8:
                    edge = share[mu + 1]
                    cost = max(cum[mu] + edge, 1 - cum[mu]) + edge
                    if best is None or cost < best[0]:
                        best = (cost, point, mu)
        if best is None or best[0] > 0.97:
            return k
        d = np.bitwise_count(values ^ np.uint32(best[1]))
        vantage[k], boundary[k] = best[1], best[2]
        left[k] = node(values[d <= best[2]], level + 1)
        right[k] = node(values[d > best[2]], level + 1)
        return k

    node(half, 0)
    return Tree(np.array(vantage, np.uint32), np.array(boundary, np.int16), np.array(left, np.int32), np.array(right, np.int32))


def half_of(fps: np.ndarray, side: int) -> np.ndarray:
    """fps as uint64 -> one half (side 0, 1) or one quarter (side 2 to 5) as uint32."""
    if side < 2:
        return (fps >> np.uint64(32 * side)).astype(np.uint32)
    return (fps >> np.uint64(16 * (side - 2))).astype(np.uint16).astype(np.uint32)


def other_quarters(side: int) -> tuple[int, int]:
    """The quarters of the half that is not this one."""
    return (4, 5) if side == 0 else (2, 3)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def shard_links(fps: np.ndarray, home: np.ndarray, side: int, forest: Forest, where: np.ndarray | None = None, level: int = 0) -> None:
    """Join in forest all positions whose fingerprints link: homes with homes and visitors."""
    where = np.arange(len(fps)) if where is None else where
    if home.sum() > LOCAL:
        own_side = half_of(fps, side)[home]
        tree = fit_tree(own_side[:: max(1, len(own_side) >> 16)], 1, 2, seed=level + 2)
        if tree.left[0] >= 0 and level < 24:
            for _, which, own in tree.route(half_of(fps, side), home):
                if own.any():
                    shard_links(fps[which], own, side, forest, where[which], level + 1)
            return
        if side < 2:  # one half in common: the quarters of the other one
            for quarter in other_quarters(side):
                shard_links(fps, home, quarter, forest, where)
            return
    at = np.flatnonzero(home)
    step = max(1, (1 << 21) // max(1, len(fps)))
    for k in range(0, len(at), step):
        rows = at[k : k + step]
        near = np.bitwise_count(fps[rows][:, None] ^ fps[None, :]) <= BITS
        near[np.arange(len(rows)), rows] = False
        for i in np.flatnonzero(near.any(axis=1)):
            x = int(where[rows[i]])
            for j in where[np.flatnonzero(near[i])]:
                forest.join(x, int(j))


class Dealer:
    """The trees over both halves, and over the quarters of the other half below the leaves that one value fills."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        self.trees, self.below = [], {}
        scale = n / max(1, len(sample))
        for side in (0, 1):
            tree = fit_tree(half_of(sample, side), _depth(n), 16)
            self.trees.append(tree)
            for leaf, which, own in tree.route(half_of(sample, side), np.ones(len(sample), bool)):
                homes = which[own]
                if len(homes) * scale > 4 * SHARD and len(homes) >= 64 and fit_tree(half_of(sample[homes], side), 1, 16).left[0] < 0:
                    self.below[side, leaf] = [(q, fit_tree(half_of(sample[homes], q), _depth(len(homes) * scale), 16)) for q in other_quarters(side)]

    def deal(self, fps: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(shard, side, which, home)."""
        for side in (0, 1):
            for leaf, which, own in self.trees[side].route(half_of(fps, side), np.ones(len(fps), bool)):
                shard = (leaf * 2 + side) * 3 << 24
                if (side, leaf) not in self.below:
                    yield shard, side, which, own
                    continue
                for k, (quarter, tree) in enumerate(self.below[side, leaf]):
                    for sub, some, home in tree.route(half_of(fps[which], quarter), own):
                        yield shard + (k + 1 << 24) + sub, quarter, which[some], home


def _depth(n: float) -> int:
    return max(0, min(DEPTH, int(np.ceil(np.log2(max(1.0, n) / SHARD)))))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of column fp that span every component of the links."""
    spark = distinct.sparkSession
    n = distinct.count()
    some = distinct if n <= SAMPLE else distinct.sample(False, SAMPLE / n, 11)
    sample = np.sort(some.select("fp").toArrow()["fp"].to_numpy().astype(np.int64)).view(np.uint64)
    dealer = spark.sparkContext.broadcast(Dealer(sample, n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = list(dealer.value.deal(fps))
            sizes = [len(which) for _, _, which, _ in parts]
            shards, sides = (np.repeat(np.array([p[k] for p in parts], np.int64), sizes) for k in (0, 1))
            which, own = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(sides.astype(np.int32)), pa.array(fps[which].view(np.int64)), pa.array(own)], ["shard", "side", "fp", "home"])

    # The distinct fingerprints stand in few files; dealing them out is spread over as many tasks as there are cores.
    spread = distinct.select("fp").repartition(max(spark.sparkContext.defaultParallelism, -(-n // DEAL)))
    dealt = materialize(spread.mapInArrow(deal, "shard long, side int, fp long, home boolean"), "shards")
    # Shards that are too large for one task: their homes are dealt over blocks, and all their rows visit every other block.
    blocks = {r["shard"]: -(-r["n"] // BLOCK) for r in dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).collect()}
    if blocks:
        of = F.element_at(F.create_map(*(F.lit(int(x)) for kv in blocks.items() for x in kv)), F.col("shard"))
        one = F.pmod(F.xxhash64("fp"), F.coalesce(of, F.lit(1)).cast("long")).cast("int")
        all_of = F.sequence(F.lit(0), F.coalesce(of, F.lit(1)) - 1)
        dealt = dealt.withColumn("own", one).withColumn("block", F.explode(all_of)).withColumn("home", F.col("home") & (F.col("own") == F.col("block"))).drop("own")
    else:
        dealt = dealt.withColumn("block", F.lit(0))

    def span(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        forest = Forest(len(fps))
        shard_links(fps, home, table.column("side")[0].as_py(), forest)
        roots = np.fromiter(map(forest.find, range(len(fps))), np.int64, len(fps))
        out = np.flatnonzero(roots != np.arange(len(fps)))
        signed = fps.view(np.int64)
        return pa.table({"a": pa.array(signed[out]), "b": pa.array(signed[roots[out]])})

    return dealt.groupBy("shard", "block").applyInArrow(span, "a long, b long")


def classes(prints: DataFrame, id_col: str) -> DataFrame:
    """(fp, component_id) for the fingerprints in prints: the smallest id among all that are reachable."""
    least = materialize(prints.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).alias("id")), "distinct")
    roots = materialize(connected_components(links(least.select("fp"))), "roots")
    known = materialize(least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "id"), "known")
    # Only the roots that gathered more than one fingerprint need a second look.
    discard(least)
    joint = materialize(known.join(roots.where("node = root").select(F.col("root").alias("r")), F.col("root") == F.col("r"), "left_semi").groupBy("root").agg(F.min("id").alias("low")), "joint")
    out = materialize(known.join(joint, "root", "left").select("fp", F.coalesce("low", "id").alias("component_id")), "classes")
    discard(roots, known, joint)
    return out


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint in hexadecimal and the smallest id of its component."""
    prints = fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text_col)), ["__id"], text_col)
    found = classes(prints, "__id")
    return prints.join(found, prints["__fp"] == found.fp).select(F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose number __row stands in kept (column row), without a shuffle of the rows themselves.

    kept becomes bitmaps of 32768 row numbers each. They are broadcast in blocks of at most BITMAPS (64 MB),
    each block to the stretch of rows that it covers; row numbers rise from file to file, so the scans of
    the blocks read every file once between them.
    """
    bits = materialize(kept.groupBy(F.bitmap_bucket_number(F.col("row") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("row") + 1)).alias("bits")), "bitmaps")
    # These functions count from 1. Buckets of one part of the input (18 bits above a bucket's 15) stay together.
    blocks, held = [], 0
    for r in sorted(bits.groupBy(F.shiftright(F.col("bucket") - 1, 18).alias("part")).agg(F.count("*").alias("n")).collect()):
        if not blocks or held + r["n"] > BITMAPS:
            blocks.append([r["part"], r["part"]])
            held = 0
        blocks[-1][1], held = r["part"], held + r["n"]
    out = None
    at = F.bitmap_bit_position(F.col("__row") + 1)
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    for low, high in blocks or [[0, 0]]:
        own = rows.where(F.col("__row").between(low << 33, (high + 1 << 33) - 1))
        some = bits.where((F.col("bucket") - 1).between(low << 18, (high + 1 << 18) - 1))
        hit = own.join(F.broadcast(some), F.bitmap_bucket_number(F.col("__row") + 1) == F.col("bucket")).where(F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1)
        out = hit if out is None else out.union(hit)
    return out.drop("bucket", "bits")


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the first in file order."""
    keyed = packed(docs).withColumn("__row", F.monotonically_increasing_id())
    prints = fingerprints(keyed, [DOC, "__row"], f"{DOC}.{text_col}")
    first = classes(prints.select("__fp", "__row"), "__row").select(F.col("component_id").alias("row")).distinct()
    return keep_rows(prints, first).select(f"{DOC}.*")
