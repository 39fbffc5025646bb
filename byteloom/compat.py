"""Single values in, dictionaries out: the same cascade for callers that hold bytes, not tables.

Each call is a one-row DataFrame; tables should go through operators.identify instead.
"""

from __future__ import annotations

import enum
import warnings

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from byteloom.functions import charset as C
from byteloom.functions import registry as R
from byteloom.functions.models import Models
from byteloom.functions.ranking import MINIMUM, Options
from byteloom.operators import identify
from byteloom.streaming.detector import Buffer

EncodingEra = R.Era
MINIMUM_THRESHOLD, DEFAULT_MAX_BYTES, CHUNK_SIZE = MINIMUM, Options().max_bytes, 65536
LEGACY_MAP = PREFERRED_SUPERSET = R.SUPERSETS
NO_RESULT = {"encoding": None, "confidence": 0.0, "language": None, "mime_type": None}


class LanguageFilter(enum.IntFlag):
    """Accepted and ignored, with a warning."""

    CHINESE_SIMPLIFIED = 1
    CHINESE_TRADITIONAL = 2
    JAPANESE = 4
    KOREAN = 8
    NON_CJK = 16
    ALL = 31
    CHINESE = CHINESE_SIMPLIFIED | CHINESE_TRADITIONAL
    CJK = CHINESE | JAPANESE | KOREAN


def options_of(should_rename_legacy: bool = False, chunk_size: int = CHUNK_SIZE, lang_filter: int = LanguageFilter.ALL, **known) -> Options:
    """Options from keywords, deprecated ones included."""
    if chunk_size != CHUNK_SIZE:
        warnings.warn("chunk_size is ignored", DeprecationWarning, stacklevel=3)
    if lang_filter != LanguageFilter.ALL:
        warnings.warn("lang_filter is ignored", DeprecationWarning, stacklevel=3)
    if should_rename_legacy:
        warnings.warn("should_rename_legacy is deprecated, use prefer_superset", DeprecationWarning, stacklevel=3)
        known["prefer_superset"] = True
    for name in ("include_encodings", "exclude_encodings"):
        if known.get(name) is not None:
            known[name] = tuple(known[name])
    return Options(**known).checked()


def _bytes(value: object) -> bytes:
    if not isinstance(value, (bytes, bytearray)):
        raise ValueError("expected bytes or bytearray")
    return bytes(value)


def _one(value: bytes, truncated: bool = False):
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return spark.createDataFrame([(bytearray(value), truncated)], "content binary, truncated boolean")


def detect(value: bytes, should_rename_legacy: bool = False, encoding_era: int = R.Era.ALL, chunk_size: int = CHUNK_SIZE, max_bytes: int = DEFAULT_MAX_BYTES, *, models: Models | None = None, **more) -> dict:
    """The best result of one value."""
    options = options_of(should_rename_legacy, chunk_size, encoding_era=int(encoding_era), max_bytes=max_bytes, **more)
    return identify.detect(_one(_bytes(value)[: max_bytes + 1]), options=options, models=models).first()["detected"].asDict()


def detect_all(value: bytes, ignore_threshold: bool = False, should_rename_legacy: bool = False, encoding_era: int = R.Era.ALL, chunk_size: int = CHUNK_SIZE, max_bytes: int = DEFAULT_MAX_BYTES, *, models: Models | None = None, **more) -> list[dict]:
    """All results of one value, best first."""
    options = options_of(should_rename_legacy, chunk_size, encoding_era=int(encoding_era), max_bytes=max_bytes, ignore_threshold=ignore_threshold, **more)
    return [r.asDict() for r in identify.detect_all(_one(_bytes(value)[: max_bytes + 1]), options=options, models=models).first()["detected"]]


class UniversalDetector:
    """feed() chunks, close(), read result; done once max_bytes are there or after close()."""

    MINIMUM_THRESHOLD, LEGACY_MAP = MINIMUM_THRESHOLD, LEGACY_MAP

    def __init__(self, lang_filter: int = LanguageFilter.ALL, should_rename_legacy: bool = False, encoding_era: int = R.Era.ALL, max_bytes: int = DEFAULT_MAX_BYTES, *, models: Models | None = None, **more) -> None:
        self._options = options_of(should_rename_legacy, lang_filter=lang_filter, encoding_era=int(encoding_era), max_bytes=max_bytes, **more)
        self._models, self._buffer, self._result = models, Buffer(max_bytes), None

    @property
    def done(self) -> bool:
        return self._buffer.done

    @property
    def result(self) -> dict:
        return dict(self._result or NO_RESULT)

    def feed(self, chunk: bytes) -> None:
        self._buffer.feed(_bytes(chunk))

    def close(self) -> dict:
        if self._result is None:
            df = _one(self._buffer.close(), self._buffer.truncated)
            self._result = identify.detect(df, options=self._options, models=self._models, truncated=F.col("truncated")).first()["detected"].asDict()
        return self.result

    def reset(self) -> None:
        self._buffer.reset()
        self._result = None


def apply_preferred_superset(result: dict, data: bytes | None = None) -> dict:
    """Replaces a result's encoding by its superset, if data decodes under that."""
    wanted = R.SUPERSETS.get(result.get("encoding"))
    if wanted and (data is None or C.decodes(data, wanted)):
        result["encoding"] = wanted
    return result


def apply_compat_names(result: dict) -> dict:
    """Replaces a result's encoding by its display name."""
    encoding = result.get("encoding")
    if isinstance(encoding, str):
        result["encoding"] = R.DISPLAY.get(encoding, encoding)
    return result


#: The deprecated name.
apply_legacy_rename = apply_preferred_superset
