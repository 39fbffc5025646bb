"""detect and detect_all over a binary column.

File signatures stay in the JVM; every other stage runs in one Arrow UDF over the window, so a row costs one
trip to Python and the plan has no exchange. The models, a few MB whatever the data, are broadcast.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.functions import bytes_fns as B
from byteloom.functions.charset import zip_type
from byteloom.functions.models import Models
from byteloom.functions.ranking import Detector, Options, Result

RESULT = "struct<encoding:string,confidence:double,language:string,mime_type:string>"
_ARROW = pa.list_(pa.struct([("encoding", pa.string()), ("confidence", pa.float64()), ("language", pa.string()), ("mime_type", pa.string())]))


def detect_bytes(data: bytes, signature: str | None, cut: bool, detector: Detector, every: bool) -> list[Result]:
    """All results of one value's window, best first, or the best alone. signature: its file type, if it shows one."""
    ranked = detector.certain(data)
    if ranked is None and signature:
        ranked = [(None, 1.0, None, zip_type(data) if signature == "application/zip" else signature)]
    if ranked is None:
        ranked = detector.text(data, cut)
    ranked = detector.finish(data, ranked if every else ranked[:1])
    named = [detector.names(data, r) for r in (detector.above_threshold(ranked) if every else ranked)]
    return named


def _ranked(df: DataFrame, content: str, truncated: Column | None, options: Options, models: Models | None, every: bool) -> Column:
    options = options.checked()
    held = df.sparkSession.sparkContext.broadcast(models) if models is not None else None
    memo: list[Detector] = []

    def run(window: pa.Array, signature: pa.Array, cut: pa.Array) -> pa.Array:
        if not memo:
            memo.append(Detector(options, held.value if held is not None else None))
        rows = []
        for data, kind, c in zip(window, signature, cut, strict=True):
            value = data.as_py()
            if value is None:
                rows.append(None)
                continue
            found = detect_bytes(value, kind.as_py(), c.as_py(), memo[0], every)
            rows.append([dict(zip(("encoding", "confidence", "language", "mime_type"), r, strict=True)) for r in found])
        return pa.array(rows, _ARROW)

    window = F.substring(F.col(content), 1, options.max_bytes)
    over = F.octet_length(F.col(content)) > options.max_bytes
    cut = F.coalesce(over if truncated is None else over | truncated, F.lit(False))
    return F.arrow_udf(run, f"array<{RESULT}>")(window, B.magic(window), cut)


def detect(df: DataFrame, content: str = "content", output: str = "detected", options: Options | None = None, models: Models | None = None, truncated: Column | None = None) -> DataFrame:
    """Adds a struct (encoding, confidence, language, mime_type); null content gives null.

    Without models, text that only statistics could tell gets the no-match encoding, and languages are known
    only where an encoding has one. truncated marks rows whose bytes were cut before.
    """
    return df.withColumn(output, F.element_at(_ranked(df, content, truncated, options or Options(), models, False), 1))


def detect_all(df: DataFrame, content: str = "content", output: str = "detected", options: Options | None = None, models: Models | None = None) -> DataFrame:
    """Adds an array of results, best first: those above the threshold, or all if none is or the options say so."""
    return df.withColumn(output, _ranked(df, content, None, options or Options(), models, True))


def detect_all_rows(df: DataFrame, content: str = "content", options: Options | None = None, models: Models | None = None) -> DataFrame:
    """detect_all with one row a result: rank (from 1), encoding, confidence, language, mime_type."""
    found = detect_all(df, content, "_found", options, models)
    return found.select(*df.columns, F.posexplode("_found").alias("_rank", "_one")).select(*df.columns, (F.col("_rank") + 1).alias("rank"), "_one.*")
