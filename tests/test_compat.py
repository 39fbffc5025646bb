"""Model files as exact round trips; the interface for single values."""

import struct

import numpy as np
import pytest

from byteloom import compat
from byteloom.functions import evidence
from byteloom.functions import models as M
from byteloom.sources import model_files as MF


@pytest.fixture(scope="module")
def models():
    return M.build({"en": [("th", 9), ("he", 8), ("e ", 4)], "fr": [("é ", 5), ("dé", 7)], "ru": [("пр", 6), ("ри", 5)]})


def test_models_round_trip(models):
    data, weights = MF.dump_models(models)
    back = MF.parse_models(data, weights)
    assert back.keys == models.keys
    assert (back.weights == models.weights).all() and (back.norms == models.norms).all() and (back.idf == models.idf).all()
    assert (MF.parse_models(data).idf == 1).all()
    assert back.best("при".encode("cp1251"), ["cp1251", "koi8-r"]) == models.best("при".encode("cp1251"), ["cp1251", "koi8-r"])


def test_broken_models(models):
    data, _ = MF.dump_models(models)
    for bad in (b"", b"CMD1" + data[4:], data[:20], data[:-9], b"CMD2" + struct.pack(">I", 10_001), b"CMD2" + struct.pack(">II", 1, 257)):
        with pytest.raises(ValueError):
            MF.parse_models(bad)
    assert MF.parse_models(MF.dump_models(M.build({}))[0]).keys == []


def test_aliases_and_no_language():
    assert MF.parse_models(MF.dump_models(M.Models([("zxx", "utf8")], np.ones((1, 65536), np.uint8), np.ones(1), np.ones(65536)))[0]).keys == [("zxx", "utf-8")]


def test_row_maxima(models):
    data, _ = MF.dump_models(models)
    own = MF.row_maxima(models)
    assert own.shape == (len(models.keys), 256) and own[0, ord("t")] == models.weights[0, ord("t") * 256 : ord("u") * 256].max()
    kept = MF.dump_row_maxima(models, data)
    assert (MF.row_maxima(models, data, kept) == own).all()
    assert (MF.row_maxima(models, data + b"x", kept[:-1] + b"\xff") == own).all()


def test_pairs(spark):
    pairs = {("cp1252", "iso8859-15"): {0xA4: ("Sc", "Sc"), 0xBC: ("No", "Lu")}, ("koi8-r", "koi8-u"): {}}
    assert MF.parse_pairs(MF.dump_pairs(pairs)) == pairs
    assert MF.parse_pairs(b"") == MF.parse_pairs(b"\0") == MF.parse_pairs(b"\0\0") == {}
    assert MF.pairs_table(spark, pairs).count() == 2
    with pytest.raises(ValueError):
        MF.parse_pairs(MF.dump_pairs(pairs)[:-3])
    assert set(pairs["cp1252", "iso8859-15"]) <= evidence.differing("cp1252", "iso8859-15")


def test_single_values(spark):
    assert compat.detect(b"Hello, world!")["encoding"] == "ascii"
    assert compat.detect(bytearray(b""))["confidence"] == 0.1
    with pytest.warns(DeprecationWarning):
        assert compat.detect(b"Hello", should_rename_legacy=True)["encoding"] == "Windows-1252"
    with pytest.warns(DeprecationWarning):
        compat.detect(b"a", chunk_size=1)
    for bad in ({"max_bytes": 0}, {"include_encodings": ["nope"]}, {"include_encodings": []}):
        with pytest.raises(ValueError):
            compat.detect(b"a", **bad)
    with pytest.raises(ValueError):
        compat.detect("text")
    assert [r["encoding"] for r in compat.detect_all("café ☕".encode())] == ["utf-8"]


def test_universal_detector(spark):
    with pytest.warns(DeprecationWarning):
        d = compat.UniversalDetector(compat.LanguageFilter.CJK, max_bytes=12)
    assert d.result == compat.NO_RESULT and not d.done
    for chunk in (b"caf", "é ☕".encode(), b"more and more"):
        d.feed(chunk)
    assert d.done
    assert d.close()["encoding"] == d.close()["encoding"] == "utf-8"
    with pytest.raises(ValueError):
        d.feed(b"x")
    d.reset()
    assert not d.done and d.result == compat.NO_RESULT


def test_names_of_results():
    assert compat.apply_legacy_rename({"encoding": "ascii"}, b"a") == {"encoding": "cp1252"}
    assert compat.apply_preferred_superset({"encoding": None}) == {"encoding": None}
    assert compat.apply_compat_names(compat.apply_preferred_superset({"encoding": "iso8859-1"}, b"\x81"))["encoding"].lower().startswith("iso")
    assert compat.LEGACY_MAP["tis-620"] == "cp874"


def test_no_language_and_command_line(spark, models, tmp_path, capsys):
    from byteloom import cli

    plain = M.Models([("zxx", e) for _, e in models.keys], models.weights, models.norms, models.idf)
    text = "при".encode("cp1251") * 3
    assert compat.detect(text, include_encodings=["cp1251", "cp1252"], models=plain)["language"] is None
    data, weights = MF.dump_models(models)
    for name, content in (("m", data), ("w", weights), ("t", text)):
        (tmp_path / name).write_bytes(content)
    files = ["--models", str(tmp_path / "m"), "--weights", str(tmp_path / "w")]
    assert cli.main(["--minimal", "-l", "-i", "cp1251,cp1252", *files, str(tmp_path / "t")]) == 0
    assert capsys.readouterr().out.split() == ["Windows-1251", "ru"]
    assert cli.main(["--models", str(tmp_path / "t"), str(tmp_path / "t")]) == 2
