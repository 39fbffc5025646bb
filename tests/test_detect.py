"""Golden results that need no statistical model, and the registered queries against their SQL."""

import glob
import os
import random

import pytest

from byteloom.functions import registry
from byteloom.functions.ranking import Options
from byteloom.operators import identify
from byteloom.operators.detect import detect_deterministic
from byteloom.plans import catalog, encoded

SF = "/root/testdata/sf0.001"

GOLDEN = [
    ("empty", b"", "utf-8", 0.1, "text/plain"),
    ("ascii", b"Hello, world!", "ascii", 1.0, "text/plain"),
    ("utf8", "café ☕ — произведение".encode(), "utf-8", 0.99, "text/plain"),
    ("utf8_bom", b"\xef\xbb\xbfHello", "utf-8-sig", 1.0, "text/plain"),
    ("utf16_bom", b"\xff\xfe" + "Hello UTF-16".encode("utf-16-le"), "utf-16", 1.0, "text/plain"),
    ("utf32_bom", b"\xff\xfe\x00\x00" + "Hello UTF-32".encode("utf-32-le"), "utf-32", 1.0, "text/plain"),
    ("binary", bytes(range(256)), None, 0.95, "application/octet-stream"),
    ("png", b"\x89PNG\r\n\x1a\n" + bytes(100), None, 1.0, "image/png"),
    ("truncated", "é".encode() * 10 + b"\xe2\x82", "utf-8", 0.99, "text/plain"),
    ("latin1", "d\xe9j\xe0 vu".encode("latin-1"), None, None, None),
]


def test_golden(spark):
    df = spark.createDataFrame([(n, bytearray(c)) for n, c, *_ in GOLDEN], "name string, content binary")
    got = {r["name"]: r["detected"] for r in detect_deterministic(df).collect()}
    for name, _, encoding, confidence, mime in GOLDEN:
        if confidence is None:
            assert got[name] is None
        else:
            assert (got[name]["encoding"], got[name]["mime_type"]) == (encoding, mime), name
            assert got[name]["confidence"] == pytest.approx(confidence, abs=1e-12)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql() | encoded.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = (catalog.queries() | encoded.queries())[name](spark, SF)
    rows = con.execute(f"SELECT {', '.join(df.columns)} FROM ({(catalog.oracle_sql() | encoded.oracle_sql())[name]})").fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in df.collect())


def test_deterministic_is_detect_or_null(spark):
    values = [c[0] for g in (encoded.WIDE, encoded.ESCAPED, encoded.MARKED, encoded.CONTAINED, encoded.MULTIBYTE) for c in g]
    values += [b"a+b", b"1+1=2", b"x ~{ y", b"user+tag@example.com", "\u00e9 charset=x".encode(), b"MZ\0\0", b"\0" * 50 + b"abc", b"<meta charset=latin1>\xc3\xa9", b"\x1b(I\0", b"coding: nothing", b"\xca\xfe\xba\xbe\0\0\0\x03short"]
    rng = random.Random(3)
    values += [b"".join(rng.choice([b"a", b" ", b"\xc3\xa9", b"\0", b"+", b"~{", b"\x1b$B", b"<meta charset='utf-8'>", b"\xff", b"\x01", b"&AOk-", b"coding=x"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "content binary")
    both = identify.detect(detect_deterministic(df, output="a"), output="b", options=Options(compat_names=False)).collect()
    wrong = [r for r in both if r["a"] is not None and (r["a"]["encoding"], round(r["a"]["confidence"], 9), r["a"]["mime_type"]) != (r["b"]["encoding"], round(r["b"]["confidence"], 9), r["b"]["mime_type"])]
    assert not wrong
    assert sum(r["a"] is not None for r in both) > 150


def test_aliases_with_dots():
    assert registry.lookup("ANSI_X3.4-1986") == registry.lookup("iso_646.irv_1991") == "ascii"
