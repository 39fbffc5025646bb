"""Language-model scores of documents: an add-one unigram base and a causal attention model.

Words (lower-case A-Z, split at white space) and one end a text are the base's tokens. Their counts
over all training documents are summed map-side before they meet. The commonest words, a bounded
table, are broadcast; a document's other words, once a document, meet their counts in a join. Only words
too long for the table can be hot there, and the join's other side has one row a word.

The attention model works on the words' subword ids. Shares of ids in their classes, and of ids after
others within a word, come from the word counts of all training documents. The shares of a word's ids add
up to one number, worked out once a distinct word: the PAIRS commonest pairs of ids are broadcast, the
others meet their counts in a join. Documents get their words' numbers as they get their counts; they are
encoded once, and scored by their ids, as a word's ids are its own and the first of them shows where it begins. Classes
come from the neighbours of every id in all training documents, and the network is trained on every window of all of them: the documents are dealt into ROUNDS rounds, in each of which
every task goes over its own documents of the round from the same weights, and the tasks' weights are
averaged, an embedding row by how often a task used it.

Defined results: null and empty texts are one end token; a null id counts as empty text for the hold-out; repeated
rows get equal scores; an empty table gives an empty result, and without training documents every
count is 0; a text of any length is scored whole, in groups of bounded windows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.llm import attention_lm as net
from byteloom.llm.common import discard, materialize, tune, utf8

FOLDS, HELD_OUT = 7, 2
#: Words that are broadcast; distinct words that a task holds before it hands them on.
HEAVY, FLUSH = 1 << 17, 500_000
#: Rounds of training; the first one's rate; tasks that add up what the others give, before the driver does.
ROUNDS, RATE, FAN = 6, 4e-3, 4
#: Longer words are never broadcast but joined, so the table has at most HEAVY * HEAVY_BYTES bytes of words.
HEAVY_BYTES = 256
CACHE_SIZE, CACHE_BYTES = 1 << 18, 64
#: Words that the tokenizer gets at once.
TOGETHER = 512
#: Pairs of ids within a word whose counts are broadcast, 16 bytes each; the others are joined.
PAIRS = 1 << 19
#: Words' shares are multiples of this, so that their sums are exact in any order.
GRID = 2.0**-24


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


class Subwords(dict):
    """word -> its ids as uint16 bytes, by a byte-level BPE of public ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 2  # and the end
        #: Which ids begin a word: a word is encoded behind a space and holds none. The end counts as one.
        self.starts = np.zeros(self.size, bool)
        self.starts[[self.size - 1, *(i for b, i in ranks.items() if b[:1] == b" ")]] = True
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def spell(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. Words behind one another, with a space between, have the ids that each has alone, unless there is other white space at their ends."""
        out = []
        for k in range(0, len(words), TOGETHER):
            text = b" ".join(words[k : k + TOGETHER]).decode("utf-8", "replace")
            alone = text.split(" ")
            if alone != text.split():
                out += [np.array(self.encode(" " + w), "<u2").tobytes() for w in alone]
                continue
            ids = np.array(self.encode(" " + text), "<u2")
            out += cut(ids.tobytes(), [*(2 * np.flatnonzero(self.starts[ids])).tolist(), 2 * len(ids)])
        return out

    def many(self, words: list[bytes]) -> list[bytes]:
        """spell() that remembers short words."""
        found = list(map(self.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, self.spell([words[k] for k in new]), strict=True):
            found[k] = ids
        if len(self) + len(new) > CACHE_SIZE:
            self.clear()
        self.update((words[k], found[k]) for k in new[:CACHE_SIZE] if len(words[k]) <= CACHE_BYTES)
        return found

    def text(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(self.many(words)), "<u2").astype(np.int64)

    def texts(self, words: list[bytes], at: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The ids of texts of so many words, given one after the other as their places in words."""
        pieces = list(map(self.many(words).__getitem__, at.tolist()))
        upto = np.cumsum(sizes).tolist()
        return [b"".join(pieces[a:b]) for a, b in zip([0, *upto[:-1]], upto, strict=True)]


def cut(raw: bytes, at: list[int]) -> list[bytes]:
    """raw from each place to the next."""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def flat(array: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of a binary array without nulls, and where each value begins, and the end."""
    if not len(array):
        return b"", np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return data.slice(at[0], at[-1] - at[0]).to_pybytes() if data else b"", at - at[0]


def listed(array: pa.Array) -> list[bytes]:
    """to_pylist() of a binary array without nulls, in less time."""
    raw, at = flat(array)
    return cut(raw, at.tolist())


def distinct_spelt(texts: pa.Array, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As distinct_words(), from the texts' ids; a word is its ids, the first of which no other of them can be."""
    raw, at = flat(texts)
    first = np.flatnonzero(starts[np.frombuffer(raw, "<u2")])
    offsets = np.append(2 * first, len(raw)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(first, at // 2))


def distinct_words(contents: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a batch of texts, the place of every word among them, and how many words each text has."""
    words = [x.lower().split() for x in contents]
    coded = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.array(list(map(len, words)), np.int64)


_SUBWORDS: dict[str, Subwords] = {}


def subwords(path: str, pattern: str) -> Subwords:
    if path not in _SUBWORDS:
        _SUBWORDS[path] = Subwords(path, pattern)
    return _SUBWORDS[path]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c, n): how often each word stands in training documents, and in all. rows: content, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.set_column(0, "word", table["word"].cast(pa.string())).to_batches(max_chunksize=1 << 16)

        def together() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum"), ("n", "sum")]).rename_columns(["word", "c", "n"])

        for batch in batches:
            words, at, sizes = distinct_words(listed(batch.column(0)))
            train = np.repeat(~batch.column(1).to_numpy(zero_copy_only=False), sizes)
            c, n = (np.bincount(x, minlength=len(words)).astype(np.int64) for x in (at[train], at))
            held.append(pa.table([words, c, n], ["word", "c", "n"]))
            rows += len(words)
            if rows > FLUSH:
                held = [together()]
                if held[0].num_rows > FLUSH // 2:
                    yield from out(held.pop())
                rows = sum(t.num_rows for t in held)
        if held:
            yield from out(together())

    counted = rows.mapInArrow(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    return materialize(counted, "words")


def threshold(words: DataFrame, most: int) -> int:
    """The count n from which on at most so many rows are common, from a histogram of 16 bins an octave."""
    bins = words.groupBy(F.floor(16 * F.log2("n")).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    held, least = 0, 1 << 62
    for r in sorted(bins, key=lambda r: -r["bin"]):
        held += r["words"]
        if held > most:
            break
        least = r["least"]
    return least


def spelt(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """words with a key and the ids of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = subwords(path, pattern), TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        for batch in batches:
            ids = own.spell(listed(batch.column(0).cast(pa.binary())))
            yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(ids)), pa.int64()), *batch.columns, pa.array(ids, pa.binary())], ["key", "word", "c", "n", "ids"])
            number += len(ids)

    return materialize(words.select("word", "c", "n").mapInArrow(run, "key long, word string, c long, n long, ids binary"), "spelt")


def chained(ids: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words as uint16 bytes: the id before each id (the end before a word's first), the ids in a row, and the index of each word's first."""
    raw, at = flat(ids)
    row, first = np.frombuffer(raw, "<u2").astype(np.int64), at[:-1] // 2
    before = np.concatenate([row[:1], row[:-1]])
    before[first] = end
    return before, row, first


def subword_counts(words: DataFrame, size: int) -> tuple[np.ndarray, DataFrame]:
    """How often each id stands in the training documents, and (pair, c, n): each pair (before * ids + id), its times in training documents and in all; the end stands before a word's first id. words: from spelt()."""
    end = size - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            before, ids, first = chained(batch.column(2), end)
            sizes = np.diff(first, append=len(ids))
            pairs, where = np.unique(before * size + ids, return_inverse=True)
            c, n = (np.bincount(where, weights=np.repeat(batch.column(k).to_numpy(), sizes), minlength=len(pairs)).astype(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(c), pa.array(n)], ["pair", "c", "n"])

    counted = materialize(words.select("c", "n", "ids").mapInArrow(run, "pair long, c long, n long").groupBy("pair").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "pairs")
    counts = np.zeros(size)
    for r in counted.groupBy((F.col("pair") % size).alias("id")).agg(F.sum("c").alias("c")).collect():
        counts[r["id"]] = r["c"]
    return counts, counted


def word_shares(words: DataFrame, counted: DataFrame, vocab: net.Vocabulary, most: int) -> DataFrame:
    """(word, ids, c, n, share): the sum of log10 of the shares of each word's ids. words, counted: from spelt() and subword_counts(), deleted here; most: how many pairs are broadcast."""
    spark, size, end, given = words.sparkSession, len(vocab.classes), vocab.end, counted
    counted = given.where(F.col("pair") < end * size)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(net.group(vocab, pair // size, pair % size)), batch.column(1)], ["of", "c"])

    # An id before and a class: as many as the ids and classes allow, whatever the input.
    totals = counted.where("c > 0").select("pair", "c").mapInArrow(groups, "of long, c long").groupBy("of").agg(F.sum("c").alias("c")).toArrow()
    least = threshold(counted, most)
    chosen = counted.where(F.col("n") >= least).select("pair", "c").toArrow()
    pairs = net.Pairs(vocab, *(t[k].to_numpy().astype(np.int64) for t, k in ((chosen, "pair"), (chosen, "c"), (totals, "of"), (totals, "c"))))
    shared = spark.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            before, ids, first = chained(batch.column(4), end)
            share, rest = pairs.shares(before, ids), ~pairs.holds(before, ids)
            share[first], rest[first] = pairs.vocab.logp[ids[first]], False
            upto = np.concatenate([[0], np.cumsum(np.add.reduceat(rest.astype(np.int32), first))])
            others = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array((before * size + ids)[rest], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.add.reduceat(share, first)), others], ["key", "word", "c", "n", "ids", "share", "rest"])

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a pair's count adds to the share that it has without one."""
        for batch in batches:
            pair = batch.column(0).to_numpy()
            more = np.log10(1 + batch.column(1).to_numpy() / (net.SMOOTH * 10.0 ** vocab.logp[pair % size]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(more)], ["pair", "more"])

    told = partly = words.mapInArrow(run, "key long, word string, c long, n long, ids binary, share double, rest array<long>")
    others = counted.where(F.col("n") < least)
    share = F.col("share")
    if not others.isEmpty():
        told = partly = materialize(told, "told")
        # A pair is in no more rows here than its times in all documents, which are fewer than those of the broadcast ones.
        gained = told.select("key", F.explode("rest").alias("pair")).join(others.where("c > 0").select("pair", "c").mapInArrow(gains, "pair long, more double"), "pair")
        told, share = told.join(gained.groupBy("key").agg(F.sum("more").alias("more")), "key", "left"), share + F.coalesce("more", F.lit(0.0))
    out = materialize(told.select("word", "ids", "c", "n", (F.rint(share / GRID) * GRID).alias("share")), "shares")
    discard(words, given, partly)
    shared.unpersist()
    return out


def encoded(rows: DataFrame, path: str, pattern: str, inputs: np.ndarray, seen: np.ndarray) -> DataFrame:
    """(id, held, part, ids, sums): the ids of every document, with its round if it trains, and a row a task, or more, with part -1 and the sums of contexts of those that train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, near, end = subwords(path, pattern), 0, None, np.array([len(inputs) - 1])

        def out(ids: pa.Array, held: pa.Array, part: list[int | None], texts: list[bytes | None], sums: list[bytes | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, held, pa.array(part, pa.int32()), pa.array(texts, pa.binary()), pa.array(sums, pa.binary())], ["id", "held", "part", "ids", "sums"])

        def summary() -> pa.RecordBatch:
            return out(pa.nulls(1, kind), pa.nulls(1, pa.bool_()), [-1], [None], [near.contexts(seen).tobytes()])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(0).type
            words, at, sizes = distinct_words(listed(batch.column(1)))
            texts, part = own.texts(listed(words), at, sizes), []
            for held in batch.column(2).to_pylist():
                part.append(None if held else n % ROUNDS)
                n += not held
            train = [np.frombuffer(x, "<u2") for x, k in zip(texts, part, strict=True) if k is not None]
            for group in net.in_groups(train):
                near = near or net.Neighbours()
                near.see(inputs[np.concatenate([end, *(z for x in group for z in (x, end))])])
                if near.full:
                    yield summary()
                    near = None
            yield out(batch.column(0), batch.column(2), part, texts, [None] * len(texts))
        if near:
            yield summary()

    id_type = rows.schema["id"].dataType.simpleString()
    return materialize(rows.select("id", "content", "held").mapInArrow(run, f"id {id_type}, held boolean, part int, ids binary, sums binary"), "ids")


def summed(vectors: DataFrame) -> np.ndarray | None:
    """The sum of vectors of float64 as bytes, one a row; None without rows. Few tasks add up first, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                x = np.frombuffer(x)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    named = vectors.toDF("v").withColumn("task", F.spark_partition_id())
    few = named.repartition(FAN, F.col("task") % FAN).sortWithinPartitions("task").select("v").mapInArrow(run, "v binary").collect()
    return sum(np.frombuffer(bytes(r["v"])) for r in few) if few else None


def one_round(ids: DataFrame, vocab: net.Vocabulary, p: dict, number: int, passes: int) -> np.ndarray | None:
    """What the tasks' learners add to the mean of a round: over its part of the documents, or over all of a small corpus, which then has its passes dealt over the rounds."""
    shared = ids.sparkSession.sparkContext.broadcast((vocab, p))
    rate, again = RATE * (1 - 0.9 * number / ROUNDS), -(-passes // ROUNDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, held = net.Learner(*shared.value, rate, seed=number), []
        for batch in batches:
            texts = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(0).to_pylist()]
            if passes > 1:  # so few windows that a task can hold them
                held += texts
                continue
            for group in net.in_groups(texts):
                learner.see(group)
        for _ in range(again if held else 0):
            for group in net.in_groups(held):
                learner.see(group)
        if learner.windows:
            yield pa.RecordBatch.from_arrays([pa.array([net.weighed(learner).tobytes()], pa.binary())], ["v"])

    chosen = ids.where(F.col("part") >= 0 if passes > 1 else F.col("part") == number)
    total = summed(chosen.select("ids").mapInArrow(run, "v binary"))
    shared.unpersist()
    return total


def learnt(ids: DataFrame, vocab: net.Vocabulary, counts: np.ndarray, n_windows: int) -> dict:
    """The network after all rounds."""
    p, passes = net.start(np.bincount(vocab.classes, weights=counts, minlength=net.CLASSES) + 1.0), net.passes(n_windows)
    for number in range(ROUNDS if passes == 1 else min(ROUNDS, passes)):
        total = one_round(ids, vocab, p, number, passes)
        if total is not None:
            p = net.mean(total, p)
    return p


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("content"), held_out(id_col).alias("held"))


class Counted:
    """Word counts over all training documents: the table of all words, and the sums."""

    def __init__(self, rows: DataFrame) -> None:
        self.n_train = rows.agg(F.sum((~F.col("held")).cast("long"))).first()[0] or 0
        self.words = word_counts(rows.select("content", "held"))
        distinct, total = (x or 0 for x in self.words.where("c > 0").agg(F.count("*"), F.sum("c")).first())
        self.n_all, self.v_all = total + self.n_train, distinct + (self.n_train > 0)


def common_words(words: DataFrame, heavy: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The commonest words, their counts and shares (0 without)."""
    share = F.col("share") if "share" in words.columns else F.lit(0.0)
    chosen = words.where((F.col("n") >= threshold(words, heavy)) & (F.octet_length("word") <= HEAVY_BYTES)).select("word", "c", share.alias("share")).toArrow()
    return chosen["word"].combine_chunks().cast(pa.binary()), chosen["c"].to_numpy(), chosen["share"].to_numpy()


def _scored(rows: DataFrame, counted: Counted, heavy: int, id_col: str, model: tuple | None) -> DataFrame:
    """A row a document: the base, and the score of model (which ids begin a word, vocabulary, parameters) if there is one; rows then hold ids instead of content, and a word is its ids and has a share."""
    spark, n_train = rows.sparkSession, counted.n_train
    shared = spark.sparkContext.broadcast((common_words(counted.words, heavy), model))
    end = log10(n_train + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, counts, told), model = shared.value
        # The last are for words that are not in the table.
        logs, told = np.append(np.log10(counts + 1.0), 0.0), np.append(told, 0.0)
        if model:
            starts, vocab, p = model
            p = net.projected(p)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            distinct, at, sizes = distinct_spelt(batch.column(1), starts) if model else distinct_words(listed(batch.column(1)))
            doc, most = np.repeat(np.arange(n), sizes), max(1, len(distinct))
            place = pc.index_in(distinct, value_set=common).fill_null(-1).to_numpy()
            value = logs[place][at]
            base, known = np.bincount(doc, value, n) + end, np.bincount(doc[value > 0], minlength=n) + int(n_train > 0)
            lost = place[at] < 0
            rare, times = np.unique(doc[lost] * most + at[lost], return_counts=True)
            upto = pa.array(np.searchsorted(rare, np.arange(n + 1) * most), pa.int32())
            rare = distinct.take(pa.array(rare % most))
            rare = pa.ListArray.from_arrays(upto, rare if model else rare.cast(pa.string()))
            times = pa.ListArray.from_arrays(upto, pa.array(times, pa.int64()))
            scores, done = [None] * n if not model else np.zeros(n), 0
            if model:
                shares = np.bincount(doc, told[place][at], n) + vocab.logp[vocab.end]
                for group in net.in_groups([np.frombuffer(x, "<u2") for x in listed(batch.column(1))]):
                    scores[done : done + len(group)] = net.score(p, vocab, group, shares[done : done + len(group)])
                    done += len(group)
            keys = pa.array(range(number, number + n), pa.int64())
            number += n
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column(0), batch.column(2), pa.array(sizes + 1), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), rare, times],
                ["key", "id", "held", "size", "known", "base", "score", "rare", "times"],
            )

    id_type, word_type = (t.dataType.simpleString() for t in (rows.schema["id"], counted.words.schema["word"]))
    scored = materialize(rows.select("id", "ids" if model else "content", "held").mapInArrow(run, f"key long, id {id_type}, held boolean, size long, known long, base double, score double, rare array<{word_type}>, times array<long>"), "scored")
    pairs = scored.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # A count of 0 adds log10(1) to the base, so without shares words without counts need no row.
    words = counted.words if model else counted.words.where("c > 0").withColumn("share", F.lit(0.0))
    found = (
        pairs.join(words.select("word", "c", "share"), "word")
        .groupBy("key")
        .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("also"), F.sum(F.col("times") * F.col("share")).alias("told"))
    )
    return scored.drop("rare", "times").join(found, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        F.col("size").alias("n_tokens"),
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(int(counted.n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("size") * F.lit(log10(counted.n_all + counted.v_all + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("told", F.lit(0.0))).alias("score"),
    )


def base_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """lm_scores without the network: all columns but score."""
    rows = _rows(docs, id_col, text_col)
    return _scored(rows, Counted(rows), heavy, id_col, None).drop("score")


def lm_scores(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per document: hold-out, tokens, known tokens, training tokens, base score and model score."""
    rows = _rows(docs, id_col, text_col)
    counted = Counted(rows)
    own = subwords(path, pattern)
    words = spelt(counted.words, path, pattern)
    discard(counted.words)
    counts, pairs = subword_counts(words, own.size)
    counts[-1] = counted.n_train
    inputs = net.input_rows(counts, own.starts)
    seen = np.bincount(inputs, weights=counts, minlength=net.INPUTS)
    ids = encoded(rows, path, pattern, inputs, seen)
    sums = summed(ids.where("part < 0").select("sums"))
    sums = np.zeros((net.INPUTS, 2 * net.CONTEXT)) if sums is None else sums.reshape(net.INPUTS, -1)
    vocab = net.vocabulary_of(counts, len(counts) - 1, sums, seen, own.starts)
    p = learnt(ids, vocab, counts, int(counts.sum() / net.STEP + counted.n_train)) if counted.n_train else net.initial()
    counted.words = word_shares(words, pairs, vocab, PAIRS).select(F.col("ids").alias("word"), "c", "n", "share")
    scores = _scored(ids.where("ids IS NOT NULL"), counted, heavy, id_col, (own.starts, vocab, p))
    discard(ids)
    return scores
