"""Mixing sources to target weights by entropy balancing.

Every document starts with rate 1. Among all rates from 0 to 2 whose tokens meet each source's target,
entropy balancing takes those with the least relative entropy, summed over documents, to where they
started. Its convex dual has one multiplier a source, and a document's rate is the exponential of its
source's multiplier times its size: min(2, exp(multiplier * size / mean size of the source)). The
multipliers have no closed form. Newton's iterations find them: each is one distributed sum of tilted
tokens and their derivative over all sizes of all sources, and a bracket guards the steps. Sources are
rows of tables throughout; the driver sees a few sums.

Rates then become whole copies. Documents are dealt into cells of like size by (source, eighth of an
octave, bucket), as many buckets as keep a cell's rows within BUCKET_ROWS; going from large sizes to
small, each cell takes a whole number of copies and hands what it missed or overshot to the next, so a
source ends about as near to its target as its small documents allow. Within a cell the documents with
the smallest hashes get the odd copies, equal hashes (equal ids and texts) in the order of the table.
A rate is at most 2 and so are copies.

Defined results: null texts have size 0 and are never taken; null sources are one source, last; null or
repeated ids are told apart by text and row, so each row counts on its own; an empty table gives an
empty result; other columns are ignored by mix and kept by apply_mix. The table must give its rows in
the same order each time it is read, as files do.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from byteloom.llm.common import DOC, discard, materialize, packed

WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2.0
#: Documents that one cell should hold at most; relative error that a balanced source may have before rounding.
BUCKET_ROWS, TOLERANCE = 2_000_000, 1e-9


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def _key(source: Column) -> Column:
    """A source as a string that is never null and sorts as sources do: by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """docs with __key, __size, __octave, __hash and the row's number __row."""
    text = F.col(text_col)
    out = docs.withColumn("__key", _key(F.col(source_col))).withColumn("__size", size_of(text)).withColumn("__hash", F.xxhash64(F.col(id_col), text, F.lit("mix")))
    return out.withColumn("__octave", F.floor(8 * F.log2(F.greatest("__size", F.lit(1)))).cast("int")).withColumn("__row", F.monotonically_increasing_id())


def weighted(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes (key, ...) with the weight that each source has by its place among all, without a global window."""
    numbered = materialize(sizes.repartitionByRange("key").sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id()), "ordered")
    # A row's number is its partition in the upper bits and its place there in the lower 33.
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for r in sorted(numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((r["part"], before))
        before += r["n"]
    if not offsets:
        return numbered.drop("at").withColumn("weight", F.lit(weights[0]).cast("long"))
    first = numbered.sparkSession.createDataFrame(offsets, "part long, first long")
    cycle = F.array(*map(F.lit, weights))
    rank = (F.col("first") + place) % len(weights)
    return numbered.withColumn("part", part).join(F.broadcast(first), "part").withColumn("weight", F.get(cycle, rank.cast("int")).cast("long")).drop("part", "first", "at")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """sizes (key, size, ...) with weight and target: total times all tokens by weight, none above most times its size.

    The share of a unit of weight rises from pass to pass as full sources give back their excess, until no more are full.
    """
    known = materialize(weighted(sizes, weights), "weights")
    share, full = 0.0, -1
    while True:
        is_full = F.col("weight") * share > most * F.col("size")
        r = known.agg(F.sum("size").alias("all"), F.sum(F.when(is_full, F.col("size")).otherwise(0)).alias("given"), F.sum(F.when(is_full, 0).otherwise(F.col("weight"))).alias("free"), F.sum(is_full.cast("long")).alias("full")).first()
        if not r["free"] or r["full"] == full:
            break
        share, full = (total * r["all"] - most * r["given"]) / r["free"], r["full"]
    return known.withColumn("target", F.least(F.col("weight") * F.lit(share), most * F.col("size").cast("double")))


def balance(sizes: DataFrame, sources: DataFrame, most: float = MOST, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, scale, multiplier) by Newton's method on the dual; sizes: key, size, n (documents of that size); sources: key, size, n, target.

    A null multiplier means rate 0 (nothing wanted), positive infinity rate most (everything as often as allowed).
    """
    inf = F.lit(float("inf"))
    open_ = (F.col("target") > 0) & (F.col("target") < most * F.col("size") * (1 - 1e-12))
    state = sources.select("key", "target", (F.col("size") / F.col("n")).alias("scale"), F.when(open_, F.lit(0.0)).when(F.col("target") > 0, inf).alias("multiplier"), (-inf).alias("low"), inf.alias("high"), open_.alias("open"))
    state = materialize(state, "dual")
    while not state.where("open").isEmpty():
        x = F.col("size") / F.col("scale")
        tilt = F.col("multiplier") * x
        inside = tilt < math.log(most)
        tokens = F.col("n") * F.col("size")
        sums = sizes.join(state.where("open"), "key").groupBy("key").agg(F.sum(tokens * F.when(inside, F.exp(tilt)).otherwise(most)).alias("got"), F.sum(F.when(inside, tokens * x * F.exp(tilt)).otherwise(0.0)).alias("slope"))
        m, gap = F.col("multiplier"), F.col("target") - F.col("got")
        low, high = F.when(gap > 0, m).otherwise(F.col("low")), F.when(gap < 0, m).otherwise(F.col("high"))
        newton = m + gap / F.when(F.col("slope") > 0, F.col("slope"))
        # Beyond the bracket: its middle, or twice as far where it has no end yet.
        guarded = F.when(newton.isNotNull() & (newton > low) & (newton < high), newton).when((low > -inf) & (high < inf), (low + high) / 2).when(gap > 0, 2 * m + 1).otherwise(2 * m - 1)
        done = (F.abs(gap) <= tolerance * F.col("target")) | (high - low <= 1e-14 * F.greatest(F.lit(1.0), F.abs(m)))
        moved = sums.join(state, "key").select("key", "target", "scale", F.when(done, m).otherwise(guarded).alias("multiplier"), low.alias("low"), high.alias("high"), (~done).alias("open"))
        after = materialize(moved.union(state.where("not open")), "dual")
        discard(state)
        state = after
    return state.select("key", "scale", "multiplier")


def _rate() -> Column:
    """A document's rate from its __size and its source's scale and multiplier."""
    tilt = F.col("multiplier") * F.col("__size") / F.col("scale")
    return F.when(F.col("multiplier").isNull() | (F.col("__size") == 0), 0.0).when(tilt < math.log(MOST), F.exp(tilt)).otherwise(MOST)


def _round_cells(cells: pd.DataFrame) -> pd.DataFrame:
    """One source's cells, large sizes first: copies by carrying the difference on."""
    cells = cells.sort_values(["octave", "bucket"], ascending=[False, True])
    carry, copies = 0.0, []
    for n, tokens, due in zip(cells["n"], cells["tokens"], cells["due"], strict=True):
        mean = tokens / n
        k = int(min(math.floor(MOST) * n, max(0, round((due + carry) / mean))))
        carry += due - k * mean
        copies.append(k)
    return cells.assign(copies=copies)[["key", "octave", "bucket", "n", "copies"]]


def plan(narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, sources). cells: per (key, octave) the multiplier and, by bucket, the copies that all get and the last row that gets one more."""
    kept = narrow.where("__size > 0")
    sources = narrow.groupBy(F.col("__key").alias("key")).agg(F.sum("__size").alias("size"), F.count("*").alias("n"))
    sources = materialize(targets(sources), "targets")
    sizes = materialize(kept.groupBy(F.col("__key").alias("key"), F.col("__size").alias("size"), F.col("__octave").alias("octave")).agg(F.count("*").alias("n")), "sizes")
    dual = materialize(balance(sizes.select("key", "size", "n"), sources), "balanced")
    buckets = sizes.groupBy("key", "octave").agg(F.ceil(F.sum("n") / BUCKET_ROWS).alias("buckets"))
    grid = materialize(buckets.join(dual, "key"), "grid")
    celled = kept.join(grid.withColumnsRenamed({"key": "__key", "octave": "__octave"}), ["__key", "__octave"]).withColumn("bucket", _bucket())
    keys = ["key", "octave", "bucket"]
    named = celled.select(F.col("__key").alias("key"), F.col("__octave").alias("octave"), "bucket", "__size", "__hash", "__row", _rate().alias("rate"))
    cells = named.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("__size").alias("tokens"), F.sum(F.col("rate") * F.col("__size")).alias("due"))
    rounded = materialize(cells.groupBy("key").applyInPandas(_round_cells, "key string, octave int, bucket int, n long, copies long"), "cells")
    odd = rounded.where("copies % n > 0").select(*keys, (F.col("copies") % F.col("n")).alias("odd"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__hash", "__row"))
    last = named.join(odd, keys).withColumn("rank", rank).where("rank = odd").select(*keys, F.col("__hash").alias("hash"), F.col("__row").alias("row"))
    each = F.struct("bucket", F.floor(F.col("copies") / F.col("n")).cast("long").alias("all"), "hash", "row")
    listed = rounded.join(last, keys, "left").groupBy("key", "octave").agg(F.array_sort(F.collect_list(each)).alias("cells"))
    out = materialize(grid.join(listed, ["key", "octave"]).withColumnsRenamed({"key": "__key", "octave": "__octave"}), "plan")
    discard(sizes, dual, grid, rounded)
    return out, sources.select(F.col("key").alias("__key"), F.col("size").alias("source_size"), "target")


def _bucket() -> Column:
    return F.pmod(F.shiftright("__hash", 17), F.col("buckets")).cast("int")


def _decide(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with __copies and __rate, by a join with the cells alone, which are broadcast if they are small."""
    out = rows.join(cells, ["__key", "__octave"], "left").withColumn("__cell", F.element_at(F.filter("cells", lambda c: c["bucket"] == _bucket()), 1))
    cell = lambda name: F.col(f"__cell.{name}")
    more = (F.col("__hash") < cell("hash")) | (F.col("__hash") == cell("hash")) & (F.col("__row") <= cell("row"))
    copies = F.least(cell("all") + F.when(more, 1).otherwise(0), F.lit(int(MOST)))
    return out.withColumn("__copies", F.when(F.col("__size") > 0, copies).otherwise(0).cast("long")).withColumn("__rate", _rate())


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: its size, its source's size and target, and the tokens the mix takes of it."""
    sized = _sized(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col(text_col).alias("__text")), "__id", "__source", "__text")
    narrow = materialize(sized.select("__id", "__key", "__size", "__octave", "__hash", "__row"), "sized")
    cells, sources = plan(narrow)
    out = _decide(narrow, cells).join(sources, "__key")
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"), F.col("__rate").alias("rate"))


def source_targets(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """What mix has before it balances: one row per document, its size, its source's size and target."""
    sized = docs.select(F.col(id_col), _key(F.col(source_col)).alias("key"), size_of(F.col(text_col)).alias("size"))
    found = targets(sized.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    return sized.join(found.select("key", F.col("size").alias("source_size"), "target"), "key").select(id_col, "size", "source_size", "target")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents of the mix with all their columns, and how often each is to be repeated.

    Columns of docs named mix_copies or mix_taken give way to the new ones.
    """
    own = [F.col(f"{DOC}.`{c.replace('`', '``')}`").alias(c) for c in docs.columns if c.lower() not in ("mix_copies", "mix_taken")]
    rows = _sized(packed(docs), f"{DOC}.{id_col}", f"{DOC}.{source_col}", f"{DOC}.{text_col}")
    narrow = materialize(rows.select("__key", "__size", "__octave", "__hash", "__row"), "sized")
    cells, _ = plan(narrow)
    discard(narrow)
    return _decide(rows, cells).where("__copies > 0").select(*own, F.col("__copies").alias("mix_copies"), (F.col("__copies") * F.col("__size")).alias("mix_taken"))
