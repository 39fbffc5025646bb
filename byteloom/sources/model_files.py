"""Model files: bigram models, bigram weights, row maxima and pairs of confusable encodings.

A models file is b"CMD2", the number of models, a name ("language/encoding", an empty language or None for no
language) and a norm for each, and one zlib stream of 65536 weights a model. A weights file is 65536 bytes.
A row-maxima file is b"CRM1", the SHA-256 of the models file and 256 bytes a model. A pairs file
lists, for two encodings, the bytes that they read differently and the Unicode category under each. Numbers are big-endian.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from byteloom.functions import registry as R
from byteloom.functions.models import Models

# Magic numbers, limits, and the categories by their number in a pairs file.
MODELS_MAGIC, MAXIMA_MAGIC = b"CMD2", b"CRM1"
MOST_MODELS, MOST_NAME, CELLS = 10_000, 256, 65536
CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split()

Pairs = dict[tuple[str, str], dict[int, tuple[str, str]]]


class _Reader(io.BytesIO):
    """Reads exactly what is asked for, or raises ValueError."""

    def take(self, n: int) -> bytes:
        found = self.read(n)
        if len(found) != n:
            raise ValueError("the file ends too soon")
        return found

    def number(self, form: str) -> int | float:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]


def _canonical(name: str) -> str:
    return R.lookup(name) or name


def parse_models(data: bytes, weights: bytes | None = None) -> Models:
    """Models in the order of the file; raises ValueError for a broken file. Without weights every bigram weighs 1."""
    r = _Reader(data)
    if r.read(4) != MODELS_MAGIC:
        raise ValueError("no models file")
    count = r.number(">I")
    if count > MOST_MODELS:
        raise ValueError(f"{count} models exceed {MOST_MODELS}")
    keys, norms = [], []
    for _ in range(count):
        size = r.number(">I")
        if size > MOST_NAME:
            raise ValueError(f"a name of {size} bytes exceeds {MOST_NAME}")
        language, slash, encoding = r.take(size).decode().partition("/")
        if not slash:
            language, encoding = "", language
        keys.append(("zxx" if language in ("", "None") else language, _canonical(encoding)))
        norms.append(r.number(">d"))
    unpack = zlib.decompressobj()
    try:
        blob = unpack.decompress(r.read(), count * CELLS + 1)
    except zlib.error as e:
        raise ValueError(f"broken weights: {e}") from e
    if len(blob) != count * CELLS:
        raise ValueError(f"not {CELLS} weights a model")
    idf = np.frombuffer(weights, np.uint8).astype(np.int64) if weights is not None and len(weights) == CELLS else np.ones(CELLS, np.int64)
    return Models(keys, np.frombuffer(blob, np.uint8).reshape(count, CELLS), np.array(norms), idf)


def dump_models(models: Models) -> tuple[bytes, bytes]:
    """A models file and its weights file."""
    out = [MODELS_MAGIC, struct.pack(">I", len(models.keys))]
    for (language, encoding), norm in zip(models.keys, models.norms, strict=True):
        name = f"{'None' if language == 'zxx' else language}/{encoding}".encode()
        out += [struct.pack(">I", len(name)), name, struct.pack(">d", norm)]
    return b"".join([*out, zlib.compress(models.weights.astype(np.uint8).tobytes())]), models.idf.astype(np.uint8).tobytes()


def load_models(path: str, weights: str | None = None) -> Models:
    with open(path, "rb") as f:
        data = f.read()
    if weights is None:
        return parse_models(data)
    with open(weights, "rb") as f:
        return parse_models(data, f.read())


def row_maxima(models: Models, models_file: bytes = b"", maxima_file: bytes = b"") -> np.ndarray:
    """The largest weight by model and first byte: from the file if it belongs to the models file, else from the weights."""
    head = MAXIMA_MAGIC + hashlib.sha256(models_file).digest()
    if maxima_file.startswith(head) and len(maxima_file) == len(head) + 256 * len(models.keys):
        return np.frombuffer(maxima_file, np.uint8, offset=len(head)).reshape(-1, 256)
    return models.weights.reshape(-1, 256, 256).max(axis=2, initial=0)


def dump_row_maxima(models: Models, models_file: bytes) -> bytes:
    return MAXIMA_MAGIC + hashlib.sha256(models_file).digest() + row_maxima(models).astype(np.uint8).tobytes()


def parse_pairs(data: bytes) -> Pairs:
    """(encoding, encoding) -> byte -> categories under either; a file without a count has no pairs."""
    if len(data) < 2:
        return {}
    r, out = _Reader(data), {}
    for _ in range(r.number(">H")):
        a, b = (_canonical(r.take(r.number(">B")).decode("utf-8", "replace")) for _ in "ab")
        cells = r.take(3 * r.number(">B"))
        kind = lambda k: CATEGORIES[k] if k < len(CATEGORIES) else "Cn"
        out[a, b] = {cells[k]: (kind(cells[k + 1]), kind(cells[k + 2])) for k in range(0, len(cells), 3)}
    return out


def dump_pairs(pairs: Pairs) -> bytes:
    out = [struct.pack(">H", len(pairs))]
    for names, cells in pairs.items():
        out += [bytes([len(n.encode())]) + n.encode() for n in names]
        out.append(bytes([len(cells)]))
        out += [bytes([byte, CATEGORIES.index(x), CATEGORIES.index(y)]) for byte, (x, y) in cells.items()]
    return b"".join(out)


def pairs_table(spark: SparkSession, pairs: Pairs) -> DataFrame:
    """(enc_a, enc_b, byte, cat_a, cat_b), one row a differing byte."""
    rows = [(a, b, byte, x, y) for (a, b), cells in pairs.items() for byte, (x, y) in cells.items()]
    return spark.createDataFrame(rows, "enc_a string, enc_b string, byte int, cat_a string, cat_b string")
