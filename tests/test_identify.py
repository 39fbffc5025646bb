"""Names, code pages, streams and lines against known values; models against encoded texts."""

import codecs
import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from byteloom.functions import charset as C
from byteloom.functions import models as M
from byteloom.functions import registry as R
from byteloom.functions.ranking import Detector, Options
from byteloom.operators.identify import detect, detect_all
from byteloom.streaming.detector import Buffer, assemble, detect_chunks, detect_stream

TEXTS = {
    "en": "The quick brown fox jumps over the lazy dog while the café serves its naïve guests another round of tea.",
    "fr": "Les élèves étaient très fatigués après une journée passée à étudier les sciences, où ça va très bien déjà.",
    "de": "Die Größe der Straße überrascht die Gäste, die für das Frühstück süße Brötchen und Käse möchten.",
    "es": "El niño pequeño comió una manzana mientras la señora leía el periódico en el jardín de la montaña.",
}


@pytest.fixture(scope="module")
def models(spark):
    return M.train(spark.createDataFrame([(k, v) for k, v in TEXTS.items()] + [(None, "x"), ("en", None), ("fr", "")], "lang string, text string"))


def test_registry():
    assert len(R.REGISTRY) == 86 and sum(e.is_multibyte for e in R.REGISTRY) == 13
    for name, want in (("Big5", "big5hkscs"), ("GBK", "gb18030"), ("sjis", "shift_jis_2004"), ("cp037", "cp1140"), ("ms_kanji", "cp932"), ("latin_1", "iso8859-1"), ("chinese", "gb18030"), ("nope", None)):
        assert R.lookup(name) == want
    with pytest.raises(ValueError):
        R.validate("nope")
    with pytest.raises(ValueError):
        R.candidates(include=[])
    assert [e.name for e in R.candidates(R.Era.MAINFRAME, exclude=["cp037"])] == ["cp424", "cp500", "cp875", "cp1026", "cp273"]


def zipped(name, content="x"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, content)
    return out.getvalue()


GOLDEN = [
    (b"", "utf-8", 0.1, "text/plain"),
    (b"Hello, world!", "ascii", 1.0, "text/plain"),
    ("Hello UTF-16, no mark".encode("utf-16-le"), "utf-16-le", 0.95, "text/plain"),
    ("Привет мир, как дела".encode("utf-16-be"), "utf-16-be", 0.95, "text/plain"),
    ("Hello there".encode("utf-32-be"), "utf-32-be", 0.95, "text/plain"),
    ("日本語のテキスト".encode("iso2022_jp"), "ISO-2022-JP", 0.95, "text/plain"),
    ("你好世界".encode("hz"), "HZ-GB-2312", 0.95, "text/plain"),
    ("Grüße, 日本語".encode("utf-7"), "utf-7", 0.95, "text/plain"),
    (zipped("word/document.xml"), None, 1.0, "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    (zipped("mimetype", "application/vnd.oasis.opendocument.text"), None, 1.0, "application/vnd.oasis.opendocument.text"),
    (b"# -*- coding: latin-1 -*-\nx = 1\n", "ISO-8859-1", 0.95, "text/x-python"),
    ('<?xml version="1.0" encoding="cp500"?><a>hello</a>'.encode("cp500"), "cp500", 0.95, "text/html"),
    (b"<meta http-equiv='c' content='text/html; charset=koi8-r'>\xf0\xd2", "KOI8-R", 0.95, "text/html"),
    (b'<meta charset="no-such"><p>plain</p>', "ascii", 1.0, "text/plain"),
    (bytes(range(256)), None, 0.95, "application/octet-stream"),
    (b"\x89PNG\r\n\x1a\n" + bytes(100), None, 1.0, "image/png"),
    ("日本語のテキストです。これは試験です。".encode("euc_jp"), "EUC-JP", None, "text/plain"),
    ("这是一个中文文本的例子，用来测试编码。".encode("gb18030"), "GB18030", None, "text/plain"),
    ("이것은 한국어 텍스트의 예입니다.".encode("cp949"), "CP949", None, "text/plain"),
]


def test_golden_through_spark(spark):
    df = spark.createDataFrame([(k, bytearray(g[0])) for k, g in enumerate(GOLDEN)] + [(-1, None)], "k int, content binary")
    got = {r["k"]: r["detected"] for r in detect(df).collect()}
    assert got[-1] is None
    for k, (_, encoding, confidence, mime) in enumerate(GOLDEN):
        assert (got[k]["encoding"], got[k]["mime_type"]) == (encoding, mime), k
        if confidence is not None:
            assert got[k]["confidence"] == pytest.approx(confidence, abs=1e-12)


def test_bigram_counts(spark):
    df = spark.createDataFrame([(bytearray(b"abab  c"),), (bytearray(b"a"),), (None,), (bytearray(b""),)], "content binary")
    assert {bytes.fromhex(r["pair"]): r["n"] for r in M.bigram_counts(df).collect()} == {b"ab": 2, b"ba": 1, b"b ": 1, b" c": 1}


def test_empty_table(spark, models):
    df = spark.createDataFrame([], "k int, content binary")
    assert detect(df, models=models).count() == 0 and detect_all(df).count() == 0


@pytest.mark.parametrize("encoding,accepted", [("cp1252", {"cp1252", "iso8859-1", "iso8859-15"}), ("mac-roman", {"mac-roman"}), ("cp850", {"cp850", "cp437", "cp858"}), ("cp500", {"cp500", "cp1140", "cp273"})])
def test_models_tell_code_pages(models, encoding, accepted):
    detector = Detector(None, models)
    for lang, text in TEXTS.items():
        data = text.encode(encoding)
        best = detector.finish(data, detector.text(data, False))[0]
        assert best[0] in accepted and best[2] == lang


def test_options(spark):
    df = spark.createDataFrame([(bytearray(b"plain"),)], "content binary")
    one = lambda **kw: detect(df, options=Options(**kw)).first()["detected"]["encoding"]
    assert one(prefer_superset=True) == "Windows-1252" and one(compat_names=False, prefer_superset=True) == "cp1252"
    assert one(exclude_encodings=("ascii",), no_match_encoding="cp1252") == "Windows-1252"
    for bad in ({"max_bytes": 0}, {"include_encodings": ()}, {"no_match_encoding": "nope"}):
        with pytest.raises(ValueError):
            Options(**bad).checked()


def test_single_byte_validity_equals_python():
    for e in R.REGISTRY:
        if C._undefined(e.name) is None:
            continue
        for b in range(256):
            try:
                bytes([b]).decode(C.PYTHON_NAMES.get(e.name, e.name))
                fine = True
            except UnicodeDecodeError:
                fine = False
            assert C.decodes(bytes([b]), e.name) == fine
    assert codecs.lookup("hp_roman8")


def test_chunks_in_order(spark):
    text = "Größe und Straße. " * 40
    data = text.encode()
    parts = [(7, k, bytearray(data[k * 11 : k * 11 + 11])) for k in range(len(data) // 11 + 1)]
    rows = list(reversed(parts)) + [(8, 0, None), (9, 0, bytearray(b"a" * 50)), (9, 1, bytearray(b"b" * 60)), (9, 2, bytearray(b"c"))]
    df = spark.createDataFrame(rows, "stream_id long, seq long, chunk binary").repartition(3)
    got = {r["stream_id"]: (bytes(r["content"]), r["truncated"]) for r in assemble(df, max_bytes=100).collect()}
    assert got == {7: (data[:100], True), 8: (b"", False), 9: (b"a" * 50 + b"b" * 50, True)}
    assert {r["stream_id"]: r["detected"]["encoding"] for r in detect_chunks(df).collect()} == {7: "utf-8", 8: "utf-8", 9: "ascii"}


def test_buffer():
    b = Buffer(4)
    b.feed(b"abc")
    assert not b.done
    b.feed(b"def")
    assert b.done and b.truncated and b.close() == b"abcd"
    with pytest.raises(ValueError):
        b.feed(b"x")
    b.reset()
    assert not b.done and b.content == b""


def test_structured_stream(spark, tmp_path):
    rows = pd.DataFrame({"stream_id": [1, 1, 2], "seq": [1, 0, 0], "chunk": [b"lo", b"hel", "é".encode()], "eof": [True, False, True]})
    spark.createDataFrame(rows, "stream_id long, seq long, chunk binary, eof boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id long, seq long, chunk binary, eof boolean").parquet(str(tmp_path / "in"))
    q = detect_stream(stream).writeStream.format("memory").queryName("detected_streams").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {r["stream_id"]: r["encoding"] for r in spark.table("detected_streams").select("stream_id", F.col("detected.encoding")).collect()}
    assert got == {1: "ascii", 2: "utf-8"}
