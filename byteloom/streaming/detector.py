"""Detection over values that arrive in chunks: incremental, batch and Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from byteloom.functions.models import Models
from byteloom.functions.ranking import Options
from byteloom.operators.identify import detect

#: Bytes of chunks that a task holds before it hands on what may matter of them.
HELD = 32 << 20


class Buffer:
    """The first max_bytes of what is fed; knows whether more came."""

    def __init__(self, max_bytes: int = 200_000, content: bytes = b"", truncated: bool = False) -> None:
        if max_bytes < 1:
            raise ValueError("max_bytes must be a positive integer")
        self.max_bytes, self.content, self.truncated, self.closed = max_bytes, content, truncated, False

    @property
    def done(self) -> bool:
        return self.closed or len(self.content) >= self.max_bytes

    def feed(self, chunk: bytes) -> None:
        if self.closed:
            raise ValueError("feed() called after close() without reset()")
        room = self.max_bytes - len(self.content)
        self.truncated |= len(chunk) > room
        self.content += chunk[:room]

    def close(self) -> bytes:
        self.closed = True
        return self.content

    def reset(self) -> None:
        self.content, self.truncated, self.closed = b"", False, False


def _heads(max_bytes: int):
    """Of each stream's chunks in a task only those that can lie in its first max_bytes; dropped sizes go with the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict = {}
        held = 0
        schema = None

        def out() -> pa.RecordBatch:
            rows = []
            for key, chunks in streams.items():
                chunks.sort(key=lambda c: c[0])
                kept, before = [], 0
                for seq, chunk in chunks:
                    if before < max_bytes:
                        kept.append([key, seq, chunk[: max_bytes - before], len(chunk)])
                    else:
                        kept[-1][3] += len(chunk)
                    before += len(chunk)
                rows += kept
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], schema.field(0).type), pa.array(columns[1], schema.field(1).type), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64())], ["stream_id", "seq", "chunk", "size"])

        for batch in batches:
            schema = batch.schema
            for key, seq, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                streams.setdefault(key, []).append((seq, chunk))
                held += len(chunk)
            if held > HELD:
                yield out()
                streams.clear()
                held = 0
        if schema is not None:
            yield out()

    return run


def assemble(df: DataFrame, stream_id: str = "stream_id", seq: str = "seq", chunk: str = "chunk", max_bytes: int = 200_000) -> DataFrame:
    """(stream_id, content, truncated): each stream's first max_bytes, its chunks in order of seq.

    Only heads are shuffled, so a stream that holds a third of all chunks sends a bounded part of each task.
    Null chunks count as empty; a stream of empty chunks has empty content.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(F.col(stream_id).alias("stream_id"), F.col(seq).alias("seq"), F.coalesce(F.col(chunk), F.lit(b"")).alias("chunk"))
    heads = rows.mapInArrow(_heads(max_bytes), f"stream_id {kinds[stream_id]}, seq {kinds[seq]}, chunk binary, size long")
    before = F.sum(F.octet_length("chunk")).over(Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = heads.withColumn("before", F.coalesce(before, F.lit(0)))
    part = F.when(F.col("before") < max_bytes, F.struct("seq", "before", F.hex("chunk").alias("part")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda c: c["part"]), "")
    return placed.groupBy("stream_id").agg(F.substring(F.unhex(joined), 1, max_bytes).alias("content"), (F.sum("size") > max_bytes).alias("truncated")).withColumnRenamed("stream_id", stream_id)


def detect_chunks(df: DataFrame, stream_id: str = "stream_id", seq: str = "seq", chunk: str = "chunk", options: Options | None = None, models: Models | None = None) -> DataFrame:
    """One result a stream of a batch table."""
    options = options or Options()
    whole = assemble(df, stream_id, seq, chunk, options.max_bytes)
    return detect(whole, options=options, models=models, truncated=F.col("truncated")).drop("content")


def detect_stream(df: DataFrame, options: Options | None = None, models: Models | None = None, idle: str | None = None) -> DataFrame:
    """One result a stream of a streaming table (stream_id, seq, chunk, eof), at its end or after idle milliseconds.

    The state of a stream is its first max_bytes. Chunks are put in order of seq within a micro-batch.
    """
    options = options or Options()
    most = options.max_bytes

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = Buffer(most, *(state.get if state.exists else (b"", False)))
        ended = state.hasTimedOut
        if not ended:
            parts = pd.concat(list(frames)).sort_values("seq", kind="stable")
            for chunk in parts["chunk"]:
                buffer.feed(bytes(chunk) if chunk is not None else b"")
            ended = bool(parts["eof"].fillna(False).any())
        if ended:
            state.remove()
            yield pd.DataFrame({"stream_id": [key[0]], "content": [buffer.close()], "truncated": [buffer.truncated]})
        else:
            state.update((buffer.content, buffer.truncated))
            if idle:
                state.setTimeoutDuration(int(idle))

    kind = df.schema["stream_id"].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    closed = df.groupBy("stream_id").applyInPandasWithState(run, f"stream_id {kind}, content binary, truncated boolean", "content binary, truncated boolean", "append", timeout)
    # The filter keeps every row; it turns the rows of the stateful step into the binary form that an Arrow UDF reads.
    return detect(closed.where(F.col("content").isNotNull()), options=options, models=models, truncated=F.col("truncated")).drop("content")
