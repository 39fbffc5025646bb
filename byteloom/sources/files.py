"""Files and text tables as inputs, and results as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.functions import registry as R
from byteloom.functions.bytes_fns import MAX_BYTES


def read_files(spark: SparkSession, *paths: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(label, content, truncated): whole files, of which only the first max_bytes are kept."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.col("path").alias("label"), F.substring("content", 1, max_bytes).alias("content"), (F.col("length") > max_bytes).alias("truncated"))


def number(value: Column) -> Column:
    """A double in its shortest form, whole numbers without a fraction."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def _described(found: Column, language: Column, mime_type: bool) -> Column:
    parts = [F.coalesce(found["encoding"], F.lit("None")), language]
    if mime_type:
        parts.append(F.coalesce(found["mime_type"], F.lit("application/octet-stream")))
    return F.concat_ws(" ", *parts)


def text_line(label: Column, found: Column, language: bool = False, mime_type: bool = False) -> Column:
    """label: encoding [language (Name)] [type] with confidence c."""
    code = F.coalesce(found["language"], F.lit("und"))
    named = F.concat(code, F.lit(" ("), F.initcap(F.coalesce(R.language_column(code), code)), F.lit(")")) if language else F.lit(None).cast("string")
    return F.concat(label.cast("string"), F.lit(": "), _described(found, named, mime_type), F.lit(" with confidence "), number(found["confidence"]))


def minimal_line(found: Column, language: bool = False, mime_type: bool = False) -> Column:
    """encoding [language] [type]."""
    return _described(found, F.coalesce(found["language"], F.lit("und")) if language else F.lit(None).cast("string"), mime_type)


def raw_line(label: Column, found: Column) -> Column:
    """Five fields between tabs, None for nulls."""
    shown = lambda c: F.coalesce(c, F.lit("None"))
    return F.concat_ws("\t", label.cast("string"), shown(found["encoding"]), number(found["confidence"]), shown(found["language"]), shown(found["mime_type"]))
