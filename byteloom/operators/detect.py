"""The deterministic part of detection as a DataFrame transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.functions import bytes_fns as B


def _result(encoding: Column, confidence: Column, mime: Column) -> Column:
    return F.struct(encoding.cast("string").alias("encoding"), confidence.cast("double").alias("confidence"), mime.cast("string").alias("mime_type"))


def detect_deterministic(df: DataFrame, content: str = "content", output: str = "detected", max_bytes: int = B.MAX_BYTES) -> DataFrame:
    """Adds a struct (encoding, confidence, mime_type): what detect() would say, or null where that takes more than patterns.

    Stages run in order of cost, each only where those before say nothing: empty input, byte order mark,
    escape sequences, file signature, UTF-8, ASCII, binary. Null are ZIP files; rows with many zeros among the
    first bytes (they may be UTF-16 or UTF-32); plain rows that may be HZ or UTF-7; rows that declare
    another charset than UTF-8, or declare one in a form that only detect() reads; and what only statistics
    could tell. No row needs another one, so the plan has no exchange, and the window is cut before any
    stage looks at it.
    """
    text, none = F.lit("text/plain"), F.lit(None)
    window = F.substring(F.col(content), 1, max_bytes)
    unknown = F.lit(None).cast("struct<encoding:string,confidence:double,mime_type:string>")

    def told(w: Column) -> Column:
        head = B.latin1(F.substring(w, 1, 4096))
        return F.struct(B.bom(w).alias("bom"), B.latin1(w).alias("text"), head.alias("head"), (F.octet_length(w) == 0).alias("empty"))

    def marked(w: Column, s: Column) -> Column:
        """The stages from escape sequences on."""
        has = lambda x: s["text"].contains(x)
        plain = ~s["text"].rlike(r"[\x80-\xff]")
        # Below this share of zeros no text is taken for UTF-16 or UTF-32.
        zeros = (F.length(s["head"]) >= 10) & (F.regexp_count(s["head"], F.lit(r"\x00")) / F.length(s["head"]) >= 0.015)
        doubtful = zeros | plain & (has("~{") | s["text"].rlike(r"\+[A-Za-z0-9+/]{2}"))
        return B.let(
            F.struct(F.when(has("\u001b"), B.escapes(w)).alias("escape"), B.magic(w).alias("magic"), plain.alias("plain"), doubtful.alias("doubtful"), (zeros & F.substring(s["head"], 1, 8).contains("\0")).alias("wide")),
            lambda m: (
                F.when(~m["doubtful"] & m["escape"].isNotNull(), _result(m["escape"], F.lit(0.95), text))
                .when((m["magic"] == "application/zip") | m["wide"], unknown)
                .when(m["magic"].isNotNull(), _result(none, F.lit(1.0), m["magic"]))
                .when(m["doubtful"], unknown)
                .otherwise(charset(w, s, m["plain"]))
            ),
        )

    def charset(w: Column, s: Column, plain: Column) -> Column:
        declares = s["head"].rlike(r"(?i)(charset|coding)\s*[=:]|\x83\x88\x81\x99\xa2\x85\xa3|\x95\x83\x96\x84\x89\x95\x87")
        sure = F.struct(F.when(plain, B.ascii_confidence(w)).alias("ascii"), F.when(~plain, B.utf8_confidence(w)).alias("utf8"), F.when(declares, B.declared(w)).alias("declared"), declares.alias("declares"))

        def last(c: Column) -> Column:
            utf8_named = F.lower(c["declared"]["name"]).isin("utf-8", "utf8")
            return (
                F.when(c["declares"] & (c["declared"].isNull() | ~utf8_named), unknown)
                .when(c["declared"].isNotNull() & (c["ascii"].isNotNull() | c["utf8"].isNotNull()), _result(F.lit("utf-8"), F.lit(0.95), c["declared"]["mime"]))
                .when(c["declares"], unknown)
                .when(c["ascii"].isNotNull(), _result(F.lit("ascii"), c["ascii"], text))
                .when(c["utf8"].isNotNull(), _result(F.lit("utf-8"), c["utf8"], text))
                .when(B.is_binary(w), _result(none, F.lit(0.95), F.lit("application/octet-stream")))
            )

        return B.let(sure, last)

    def ranked(w: Column, s: Column) -> Column:
        return F.when(s["empty"], _result(F.lit("utf-8"), F.lit(0.1), text)).when(s["bom"].isNotNull(), _result(s["bom"], F.lit(1.0), text)).when(s["head"].rlike(r"^\+/v[89+/]"), unknown).otherwise(marked(w, s))

    return df.withColumn(output, B.let(window, lambda w: B.let(told(w), lambda s: ranked(w, s))))
