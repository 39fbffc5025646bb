"""Queries over bytes in many encodings, whose truth is known by the way they are made, and their SQL twins.

A document picks one of a query's cases by its id and gets the case's bytes, so every row of the table
goes through the operator; the twins hold the expected values as written here by hand.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.functions.charset import decodes
from byteloom.functions.evidence import Evidence, differing
from byteloom.functions.ranking import Options, corrected
from byteloom.operators.identify import detect, detect_all_rows

JA = "日本語のテキストです。これは文字コードを調べるための例文です。"
ZH = "这是一个中文文本的例子，用来测试编码。我们希望它足够长。"
TW = "這是一個中文文本的例子，用來測試編碼。我們希望它足夠長。"
KO = "이것은 한국어 텍스트의 예입니다. 우리는 그것이 충분히 길기를 바랍니다."


def zipped(name: str, content: str = "x") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def tarred() -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        t.addfile(tarfile.TarInfo("a.txt"))
    return out.getvalue()


#: bytes, then what detect must say: encoding, confidence, language, MIME type.
WIDE = (
    ("Hello UTF-16, no mark".encode("utf-16-le"), "utf-16-le", 0.95, None, "text/plain"),
    ("Привет мир, как дела".encode("utf-16-be"), "utf-16-be", 0.95, None, "text/plain"),
    ("Hello there".encode("utf-32-be"), "utf-32-be", 0.95, None, "text/plain"),
    ("Hello there".encode("utf-32-le"), "utf-32-le", 0.95, None, "text/plain"),
    (b"\xff\xfe" + "Hello UTF-16".encode("utf-16-le"), "UTF-16", 1.0, None, "text/plain"),
    (b"\xff\xfe\x00\x00" + "Hello UTF-32".encode("utf-32-le"), "UTF-32", 1.0, None, "text/plain"),
    (b"\xef\xbb\xbfHello", "UTF-8-SIG", 1.0, None, "text/plain"),
)
ESCAPED = (
    ("日本語のテキスト".encode("iso2022_jp"), "ISO-2022-JP", 0.95, "ja", "text/plain"),
    ("한국어 텍스트".encode("iso2022_kr"), "ISO-2022-KR", 0.95, "ko", "text/plain"),
    ("你好世界".encode("hz"), "HZ-GB-2312", 0.95, "zh", "text/plain"),
    ("Grüße, 日本語".encode("utf-7"), "utf-7", 0.95, None, "text/plain"),
)
MARKED = (
    (b"# -*- coding: latin-1 -*-\nx = 1\n", "ISO-8859-1", 0.95, None, "text/x-python"),
    (b"#!/usr/bin/python\n# vim: set fileencoding=koi8-r :\n", "KOI8-R", 0.95, "ru", "text/x-python"),
    (b"<meta http-equiv='c' content='text/html; charset=koi8-r'>\xf0\xd2", "KOI8-R", 0.95, "ru", "text/html"),
    (b'<html><head><meta charset="utf-8"></head><body>plain</body></html>', "utf-8", 0.95, None, "text/html"),
    (b'<?xml version="1.0" encoding="iso-8859-1"?><a>x</a>', "ISO-8859-1", 0.95, None, "text/xml"),
    ('<?xml version="1.0" encoding="cp500"?><a>hello</a>'.encode("cp500"), "cp500", 0.95, None, "text/html"),
    (b'<meta charset="no-such"><p>plain</p>', "ascii", 1.0, None, "text/plain"),
    (b"Hello, world!", "ascii", 1.0, None, "text/plain"),
    (b"", "utf-8", 0.1, None, "text/plain"),
    (bytes(range(256)), None, 0.95, None, "application/octet-stream"),
)
CONTAINED = (
    (zipped("word/document.xml"), None, 1.0, None, "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    (zipped("xl/workbook.xml"), None, 1.0, None, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    (zipped("ppt/presentation.xml"), None, 1.0, None, "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    (zipped("META-INF/MANIFEST.MF"), None, 1.0, None, "application/java-archive"),
    (zipped("AndroidManifest.xml"), None, 1.0, None, "application/vnd.android.package-archive"),
    (zipped("META-INF/container.xml"), None, 1.0, None, "application/epub+zip"),
    (zipped("mimetype", "application/vnd.oasis.opendocument.text"), None, 1.0, None, "application/vnd.oasis.opendocument.text"),
    (zipped("readme.txt"), None, 1.0, None, "application/zip"),
    (tarred(), None, 1.0, None, "application/x-tar"),
    (b"\x89PNG\r\n\x1a\n" + bytes(100), None, 1.0, None, "image/png"),
)
MULTIBYTE = (
    (JA.encode("euc_jp"), "EUC-JP", None, "ja", "text/plain"),
    (JA.encode("cp932"), "CP932", None, "ja", "text/plain"),
    (ZH.encode("gb18030"), "GB18030", None, "zh", "text/plain"),
    (TW.encode("big5"), "Big5", None, "zh", "text/plain"),
    (KO.encode("cp949"), "CP949", None, "ko", "text/plain"),
)

#: Bytes, encoding, whether they are valid under it (an unfinished last character is).
VALID = (
    (b"plain", "ascii", True), (b"caf\xe9", "ascii", False), (b"caf\xc3\xa9", "utf-8", True), (b"caf\xe9.", "utf-8", False), (b"cut \xe2\x82", "utf-8", True),
    (b"\xed\xa0\x80", "utf-8", False), (b"\x81", "cp1252", False), (b"\x80", "cp1252", True), (b"\xff", "iso8859-1", True), (b"\xa1", "iso8859-6", False),
    (b"\xd0\xcf", "koi8-r", True), (b"\xd2", "iso8859-7", False), (b"A\x00B\x00", "utf-16-le", True), (b"\x00\xd8A\x00", "utf-16-le", False), (b"A\x00\x00\x00", "utf-32-le", True),
    (b"\x00\x00\x11\x00", "utf-32-le", False), (b"\x82\xa0", "cp932", True), (b"\x82\x01", "cp932", False), (b"\xa4\xa2", "euc_jis_2004", True), (b"\xa4\x20", "euc_jis_2004", False),
    (b"\xc4\xe3", "gb18030", True), (b"\xff\xff", "gb18030", False), (b"\x1b$B$\"\x1b(B", "iso2022_jp_2", True), (b"~{VPND~}", "hz", True), (b"~z", "hz", False),
)

#: Bytes, two encodings, which one the vote on their differing bytes is for, whether it is decisive. Weighed by hand.
VOTES = (
    (b"5 \xa4", "iso8859-1", "iso8859-15", None, False),  # both currency signs
    (b"c\xbdur", "iso8859-1", "iso8859-15", "iso8859-15", False),  # a number 7, a letter between letters 10
    (b"2 \xbd 3 \xbd", "iso8859-1", "iso8859-15", "iso8859-1", True),  # a number 7, a letter among blanks 2, twice
    (b"2 \xbd", "iso8859-1", "iso8859-15", "iso8859-1", False),  # once
    (b"a\x80b", "cp1252", "iso8859-1", "cp1252", False),  # a currency sign 5, a control 1
    (b"plain", "cp1252", "iso8859-1", None, False),
    (b"a\x93b", "cp1252", "cp1251", None, False),  # the same mark under both
    (b"x\xd7x", "iso8859-1", "iso8859-14", "iso8859-14", False),  # a times sign 5, a capital between letters 10
)
#: Bytes, a ranking as encoding:confidence:language, its order after all corrections. Worked out by hand, without models.
RANKED = (
    (b"\x82\xa0", "shift_jis_2004:0.5:ja cp932:0.5:ja", "cp932 shift_jis_2004"),
    (b"\x82\xa0", "shift_jis_2004:0.5:ja cp932:0.4:ja", "shift_jis_2004 cp932"),
    (b"abc", "iso8859-14:0.14:gd iso8859-1:0.13:en", "iso8859-1 iso8859-14"),
    (b"c\xbdur", "iso8859-1:0.5:fr iso8859-15:0.4:fr", "iso8859-15 iso8859-1"),
    (b"2 \xbd 3 \xbd", "iso8859-1:0.5:fr iso8859-15:0.4:fr", "iso8859-1 iso8859-15"),
    (b"caf\xe9", "cp1254:0.5:tr cp1252:0.4:fr koi8-r:0.1:ru", "cp1252 koi8-r cp1254"),
    (b"\xc1\x8a", "koi8-r:0.5:ru koi8-t:0.2:tg", "koi8-t koi8-r"),
    (b"a\rb\rc\r", "cp1252:0.5:fr mac-roman:0.497:fr", "mac-roman cp1252"),
    (b"a\rb\rc\r\n", "cp1252:0.5:fr mac-roman:0.497:fr", "cp1252 mac-roman"),
    (b"caf\xe9", "cp932:0.5:ja cp1252:0.3:fr", "cp1252 cp932"),
)


def _probes(spark: SparkSession, sf_dir: str, listed: tuple[bytes, ...]) -> DataFrame:
    one = F.unhex(F.element_at(F.lit([b.hex() for b in listed]), (F.pmod("doc_id", F.lit(len(listed))) + 1).cast("int")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", one.alias("content"))


def _detected(spark: SparkSession, sf_dir: str, cases: tuple) -> DataFrame:
    found = detect(_probes(spark, sf_dir, tuple(c[0] for c in cases)))
    return found.select("doc_id", "detected.encoding", F.round("detected.confidence", 9).alias("confidence"), "detected.language", "detected.mime_type")


def q_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-16 and UTF-32, with and without byte order marks."""
    return _detected(spark, sf_dir, WIDE)


def q_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO 2022, HZ and UTF-7."""
    return _detected(spark, sf_dir, ESCAPED)


def q_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations in Python, HTML, XML and EBCDIC; plain, empty and binary input."""
    return _detected(spark, sf_dir, MARKED)


def q_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP families, TAR and a signature."""
    return _detected(spark, sf_dir, CONTAINED)


def q_multibyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multibyte encodings by their structure alone; their confidence is this engine's own."""
    return _detected(spark, sf_dir, MULTIBYTE).drop("confidence")


def q_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of bytes under an encoding."""
    names = F.element_at(F.lit([n for _, n, _ in VALID]), (F.pmod("doc_id", F.lit(len(VALID))) + 1).cast("int"))

    def check(content, encoding):
        return pd.Series([decodes(bytes(c), e) for c, e in zip(content, encoding, strict=True)], dtype=bool)

    rows = _probes(spark, sf_dir, tuple(b for b, _, _ in VALID)).withColumn("encoding", names)
    return rows.select("doc_id", "encoding", F.pandas_udf(check, "boolean")("content", "encoding").alias("valid"))


def q_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote of two encodings on the bytes that they read differently."""
    names = F.element_at(F.lit([f"{a} {b}" for _, a, b, _, _ in VOTES]), (F.pmod("doc_id", F.lit(len(VOTES))) + 1).cast("int"))

    def vote(content: pd.Series, pair: pd.Series) -> pd.DataFrame:
        found = [Evidence(bytes(c)).vote(*p.split(), differing(*p.split())) for c, p in zip(content, pair, strict=True)]
        return pd.DataFrame(found, columns=["winner", "decisive"])

    rows = _probes(spark, sf_dir, tuple(v[0] for v in VOTES)).withColumn("pair", names)
    return rows.select("doc_id", "pair", F.pandas_udf(vote, "winner string, decisive boolean")("content", "pair").alias("v")).select("doc_id", "pair", "v.winner", "v.decisive")


def q_rank_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of given rankings after the eight corrections."""
    given = F.element_at(F.lit([r for _, r, _ in RANKED]), (F.pmod("doc_id", F.lit(len(RANKED))) + 1).cast("int"))

    def order(content: pd.Series, ranking: pd.Series) -> pd.Series:
        out = []
        for c, listed in zip(content, ranking, strict=True):
            parts = [r.split(":") for r in listed.split()]
            ranked = corrected(Evidence(bytes(c)), [(e, float(x), lang, None) for e, x, lang in parts], False)
            out.append(" ".join(r[0] for r in ranked))
        return pd.Series(out, dtype=object)

    rows = _probes(spark, sf_dir, tuple(r[0] for r in RANKED)).withColumn("ranking", given)
    return rows.select("doc_id", "ranking", F.pandas_udf(order, "string")("content", "ranking").alias("corrected"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def q_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of supersets instead, with and without the compatible spelling."""
    one = detect(_texts(spark, sf_dir), output="wide", options=Options(prefer_superset=True))
    two = detect(one, output="plain", options=Options(prefer_superset=True, compat_names=False))
    return two.select("doc_id", F.col("wide.encoding").alias("compatible"), F.col("plain.encoding").alias("canonical"))


def q_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only ASCII is allowed, and the fallbacks are not: other texts have no encoding."""
    return detect(_texts(spark, sf_dir), options=Options(include_encodings=("us-ascii",))).select("doc_id", "detected.*")


def q_ranked_certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certain results are the only ones of their row."""
    return detect_all_rows(_probes(spark, sf_dir, tuple(c[0] for c in ESCAPED)), options=Options(ignore_threshold=True)).select("doc_id", "rank", "encoding")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (q_wide, q_escaped, q_marked, q_contained, q_multibyte, q_valid, q_votes, q_rank_corrections, q_superset, q_filtered, q_ranked_certain)}


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + str(v) + "'"


def _expected(cases: tuple, names: tuple[str, ...], first: int) -> str:
    rows = ", ".join(f"({k}, {', '.join(_literal(v) for v in c[first:])})" for k, c in enumerate(cases))
    return f"SELECT doc_id, {', '.join(names)} FROM documents JOIN (VALUES {rows}) t(k, {', '.join(n for n in names)}) ON doc_id % {len(cases)} = k"


def oracle_sql() -> dict[str, str]:
    names = ("encoding", "confidence", "language", "mime_type")
    out = {f"q_{k}": _expected(v, names, 1) for k, v in (("wide", WIDE), ("escaped", ESCAPED), ("marked", MARKED), ("contained", CONTAINED))}
    out["q_multibyte"] = _expected(tuple((c[0], c[1], c[3], c[4]) for c in MULTIBYTE), ("encoding", "language", "mime_type"), 1)
    out["q_valid"] = _expected(VALID, ("encoding", "valid"), 1)
    out["q_votes"] = _expected(tuple((None, f"{a} {b}", w, d) for _, a, b, w, d in VOTES), ("pair", "winner", "decisive"), 1)
    out["q_rank_corrections"] = _expected(RANKED, ("ranking", "corrected"), 1)
    plain = "coalesce(regexp_full_match(text, '[\\t\\n\\r -~]+'), false)"
    empty = "coalesce(text, '') = ''"
    out["q_superset"] = f"SELECT doc_id, CASE WHEN {plain} AND NOT {empty} THEN 'Windows-1252' ELSE 'utf-8' END AS compatible, CASE WHEN {plain} AND NOT {empty} THEN 'cp1252' ELSE 'utf-8' END AS canonical FROM documents"
    out["q_filtered"] = f"SELECT doc_id, CASE WHEN {plain} THEN 'ascii' END AS encoding, CASE WHEN {plain} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS confidence, CAST(NULL AS VARCHAR) AS language, CASE WHEN {plain} THEN 'text/plain' ELSE 'application/octet-stream' END AS mime_type FROM documents"
    out["q_ranked_certain"] = f"SELECT doc_id, CAST(1 AS INTEGER) AS rank, encoding FROM ({_expected(ESCAPED, ('encoding',), 1).replace('t(k, encoding)', 't(k, encoding, c, l, m)')})"
    return out
