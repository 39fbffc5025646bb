"""Detection steps that need a decoder or a walk over the bytes; plain functions on one value."""

from __future__ import annotations

import base64
import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

from byteloom.functions.registry import BY_NAME, Era, lookup

TEXT_BYTES = b"\t\n\r" + bytes(range(0x20, 0x7F))
CONTROLS = bytes(b for b in range(0x20) if not 9 <= b <= 13)
HEAD, SAMPLE, EVIDENCE = 4096, 4096, 262_144

# Name parts of ZIP members and the types they show; stored types of OpenDocument.
ZIP_PREFIXES = (
    (b"xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    (b"word/", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    (b"ppt/", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    (b"META-INF/MANIFEST.MF", "application/java-archive"),
    (b"AndroidManifest.xml", "application/vnd.android.package-archive"),
    (b"META-INF/container.xml", "application/epub+zip"),
)
WHEEL = b".dist-info/"
OPENDOCUMENT = tuple(f"application/vnd.oasis.opendocument.{kind}".encode() for kind in ("text", "spreadsheet", "presentation", "graphics"))
# Codecs that go by another name in Python, and code units a lone UTF-7 run may stand for.
PYTHON_NAMES = {"tis-620": "tis-620", "hp-roman8": "hp_roman8", "kz1048": "kz1048", "mac-latin2": "mac_latin2"}
LONE_UNITS = ((0x0080, 0x07FF), (0x0E00, 0x0FFF), (0x2000, 0x2BFF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF))


@cache
def _undefined(encoding: str) -> bytes | None:
    """The bytes a single-byte encoding leaves undefined; none for other encodings."""
    entry = BY_NAME.get(encoding)
    if entry is None or entry.is_multibyte or encoding.startswith("utf") or encoding == "ascii":
        return None
    name, bad = PYTHON_NAMES.get(encoding, encoding), []
    for b in range(256):
        try:
            bytes([b]).decode(name)
        except UnicodeDecodeError:
            bad.append(b)
    return bytes(bad)


def decodes(data: bytes, encoding: str, whole: bool = False) -> bool:
    """No error under encoding; an unfinished last character is one only if whole."""
    bad = _undefined(encoding)
    if bad is not None:
        return not bad or len(data.translate(None, bad)) == len(data)
    if encoding in ("utf-16", "utf-32") and not data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE, codecs.BOM_UTF32_LE, codecs.BOM_UTF32_BE)):
        return False
    try:
        codecs.getincrementaldecoder(PYTHON_NAMES.get(encoding, encoding))("strict").decode(data, whole)
    except (UnicodeError, ValueError):
        return False
    return True


def ascii_confidence(data: bytes) -> float | None:
    if not data or not data.isascii():
        return None
    odd = data.translate(None, TEXT_BYTES)
    if not odd:
        return 1.0
    return 0.99 if odd.count(0) == len(odd) and len(odd) / len(data) <= 0.05 else None


def utf8_scan(data: bytes) -> tuple[bool, float | None]:
    """Whether data is UTF-8 but for an unfinished end, and the confidence its multibyte sequences give."""
    whole = data
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        for back in (3, 2, 1):
            if len(data) >= back and (0xC2, 0xE0, 0xF0)[back - 1] <= data[-back] <= 0xF4:
                whole = data[:-back]
                break
        try:
            whole.decode("utf-8")
        except UnicodeDecodeError:
            return False, None
        if whole is data:
            return False, None
    high = len(whole) - len(whole.translate(None, bytes(range(0x80, 0x100))))
    return True, min(0.99, 0.80 + (0.99 - 0.80) * min(high / len(data) * 6.0, 1.0)) if high else None


def is_binary(data: bytes) -> bool:
    n = len(data)
    if n == 0:
        return False
    controls = n - len(data.translate(None, CONTROLS))
    if controls / n <= 0.01:
        return False
    hard = controls - data.count(5) - data.count(0x15)
    spaces = data.count(0x40) + data.count(5)
    high = n - len(data.translate(None, bytes(range(0x80, 0x100))))
    return hard / n > 0.01 or (n > spaces and not (high / (n - spaces) >= 0.25 and spaces / n >= 0.02))


def _texty(text: str) -> bool:
    sample = text[:500]
    return bool(sample) and sum(c.isprintable() or c in "\n\r\t" for c in sample) / len(sample) > 0.7


def _quality(text: str) -> float:
    sample = text[:500]
    kinds = [unicodedata.category(c) for c in sample]
    n = len(kinds)
    blank = [k == "Zs" or c in "\n\r\t" for c, k in zip(sample, kinds, strict=True)]
    share = lambda first: sum(k[0] == first and not b for k, b in zip(kinds, blank, strict=True)) / n
    if n == 0 or share("C") > 0.1 or share("M") > 0.2:
        return -1.0
    plain = sum(c.isascii() and c.isalpha() for c in sample) / n
    return share("L") + 0.5 * plain + (0.1 if n > 20 and any(blank) else 0.0)


def _decoded(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def utf1632(data: bytes) -> str | None:
    """UTF-32 or UTF-16 without a mark, from where its NULs stand in the first 4096 bytes."""
    sample = data[:SAMPLE]
    if len(sample) < 10:
        return None
    quads = sample[: len(sample) // 4 * 4]
    if len(quads) >= 16:
        units = len(quads) // 4
        for name, outer, inner in (("utf-32-be", 0, 1), ("utf-32-le", 3, 2)):
            if quads[outer::4].count(0) == units and quads[inner::4].count(0) / units > 0.5 and _texty(_decoded(quads, name) or ""):
                return name
    pairs = sample[: len(sample) // 2 * 2]
    share = {"utf-16-le": pairs[1::2].count(0) / (len(pairs) // 2), "utf-16-be": pairs[0::2].count(0) / (len(pairs) // 2)}
    separated = not pairs.translate(None, TEXT_BYTES + b"\0")
    fit = {name: s >= 0.03 and not (separated and s < 0.15) for name, s in share.items()}
    if not any(fit.values()):
        return None
    texts = {name: _decoded(pairs, name) for name in sorted(share, key=lambda k: -share[k])}
    viable = {name: _quality(text) for name, text in texts.items() if text is not None and _texty(text)}
    best = None
    for name, q in viable.items():
        if best is None or q > viable[best] + 0.05:
            best = name
    if best is None:
        return None
    if fit[best]:
        return best if len(viable) == 1 or viable[best] >= 0.5 else None
    return best if viable[best] >= 0.5 and any(fit[k] and t is not None for k, t in texts.items()) else None


def has_hz(data: bytes) -> bool:
    """A region between ~{ and the next ~} that holds pairs of printable bytes."""
    return any(m[1] and len(m[1]) % 2 == 0 and not re.search(rb"[^!-~]", m[1]) for m in re.finditer(rb"~\{(.*?)~\}", data[: 2 * EVIDENCE], re.S))


_RUN = re.compile(rb"\+(?:-|\++|([A-Za-z0-9+/]*))")
_BEFORE = re.compile(rb"(?:[A-Za-z0-9+/=][\r\n]*){4}\Z")


def _utf7_run(run: bytes) -> bool:
    """A base64 run of whole UTF-16 code units with zero padding, sound surrogates and, if alone, a likely unit."""
    if len(run) < 3 or not re.search(rb"[A-Z]", run):
        return False
    value = int.from_bytes(base64.b64decode(run + b"A" * (-len(run) % 4)), "big") >> (6 * (-len(run) % 4))
    spare = len(run) * 6 % 16
    if value & ((1 << spare) - 1):
        return False
    n = len(run) * 6 // 16
    try:
        text = (value >> spare).to_bytes(2 * n, "big").decode("utf-16-be")
    except UnicodeDecodeError:
        return False
    return n != 1 or any(a <= ord(text) <= b for a, b in LONE_UNITS)


def has_utf7(data: bytes) -> bool:
    at = 0
    while m := _RUN.search(data, at):
        run, at = m[1], max(m.end(), m.start() + 1)
        if run is None:
            continue
        if _BEFORE.search(data, max(0, m.start() - 64), m.start()):
            at = m.start() + 1
        elif _utf7_run(run):
            return True
    return False


def utf7_marked(data: bytes) -> bool:
    return data.startswith((b"+/v8", b"+/v9", b"+/v+", b"+/v/")) and data.isascii() and has_utf7(data)


def zip_type(data: bytes) -> str:
    """The type that a ZIP archive's members in the first 4096 bytes show."""
    scan, at = data[:HEAD], 0
    number = lambda k, n: int.from_bytes(scan[k : k + n], "little")
    while (at := scan.find(b"PK\x03\x04", at)) >= 0 and at + 30 <= len(scan):
        body = at + 30 + number(at + 26, 2)
        if body > len(scan):
            break
        name, content = scan[at + 30 : body], body + number(at + 28, 2)
        for prefix, mime in ZIP_PREFIXES:
            if name.startswith(prefix):
                return mime
        if WHEEL in name:
            return "application/x-wheel+zip"
        if name == b"mimetype" and number(at + 8, 2) == 0:
            stored = scan[content : content + number(at + 22, 4)]
            if stored in OPENDOCUMENT:
                return stored.decode()
        at = content + (0 if number(at + 6, 2) & 8 else number(at + 18, 4))
    return "application/zip"


_S = rb"[ \t\r\n\f\x0b]*"
_MARKUP = (
    (re.compile(rb"<\?xml[^>]+encoding" + _S + rb"=" + _S + rb"['\"]([^'\"]+)['\"]", re.I), "text/xml"),
    (re.compile(rb"<meta[^>]+charset" + _S + rb"=" + _S + rb"['\"]?" + _S + rb"([^ \t\r\n\f\x0b'\">;]+)", re.I), "text/html"),
    (re.compile(rb"<meta[^>]+content" + _S + rb"=" + _S + rb"['\"][^'\"]*charset=([^ \t\r\n\f\x0b'\">;]+)", re.I), "text/html"),
)
_PEP263 = re.compile(rb"^[ \t\f]*#[^\n]*?coding[:=][ \t]*([-A-Za-z0-9_.]+)", re.M)
_EBCDIC_TAG = re.compile(r"<(?:meta|\?xml)[^>]*", re.I)
_EBCDIC_NAME = re.compile(r"(?:charset|encoding)\s*=\s*[^\sA-Za-z0-9._-]?\s*([A-Za-z][A-Za-z0-9._-]+)", re.I)


def _declared(data: bytes) -> Iterator[tuple[str, str]]:
    head = data[:HEAD]
    for pattern, mime in _MARKUP:
        m = pattern.search(head)
        if m:
            yield m[1].decode("utf-8", "replace").strip(), mime
    if len(head.translate(None, bytes(range(0x80)))) >= len(head) * 0.25:
        for tag in _EBCDIC_TAG.finditer(head.decode("cp1140", "replace")):
            for m in _EBCDIC_NAME.finditer(tag[0]):
                known = lookup(m[1])
                if known and BY_NAME[known].era & Era.MAINFRAME:
                    yield known, "text/html"
    if b"#" in data[:200]:
        m = _PEP263.search(b"\n".join(data.split(b"\n", 2)[:2]))
        if m:
            yield m[1].decode(), "text/x-python"


def markup(data: bytes) -> tuple[str, str] | None:
    """The first declared charset that is known and fits the first 4096 bytes, and the type of its markup."""
    for name, mime in _declared(data):
        encoding = lookup(name)
        if encoding and decodes(data[:HEAD], encoding):
            return encoding, mime
    return None


# Byte ranges of whole characters (first group) and of lead bytes of the multibyte encodings.
_SHAPES = {
    "cp932": (rb"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]", rb"[\x81-\x9f\xe0-\xfc]"),
    "shift_jis_2004": (rb"[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]", rb"[\x81-\x9f\xe0-\xef]"),
    "euc_jis_2004": (rb"\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2}|[\xa1-\xfe]{2}", rb"[\x8e\x8f\xa1-\xfe]"),
    "euc_kr": (rb"[\xa1-\xfe]{2}", rb"[\xa1-\xfe]"),
    "cp949": (rb"[\x81-\xc8\xca-\xfd][\x41-\x5a\x61-\x7a\x81-\xfe]", rb"[\x81-\xc8\xca-\xfd]"),
    "gb18030": (rb"[\x81-\xfe][0-9][\x81-\xfe][0-9]|[\xa1-\xf7][\xa1-\xfe]", rb"[\x81-\xfe]"),
    "big5hkscs": (rb"[\x87-\xfe][\x40-\x7e\xa1-\xfe]", rb"[\x87-\xfe]"),
    "johab": (rb"[\x84-\xd3\xd8-\xde\xe0-\xf9][\x31-\x7e\x91-\xfe]", rb"[\x84-\xd3\xd8-\xde\xe0-\xf9]"),
}
_SCANNERS = {name: re.compile(b"(" + whole + b")|" + lead) for name, (whole, lead) in _SHAPES.items()}
_LOW = bytes(range(0x80))


def structure(data: bytes, encoding: str) -> tuple[float, int, int]:
    """Share of lead bytes that begin a whole character, high bytes in those, and how many lead bytes differ."""
    scanner = _SCANNERS.get(encoding)
    if scanner is None:
        return 0.0, 0, 256
    found = scanner.findall(data)
    whole = [x for x in found if x]
    return (len(whole) / len(found) if found else 0.0), len(b"".join(whole).translate(None, _LOW)), len({x[0] for x in whole})


def plausible_multibyte(data: bytes, encoding: str) -> tuple[float, float] | None:
    """The structural share and byte coverage of a multibyte encoding, none where its gate stays shut."""
    share, high, leads = structure(data, encoding)
    n = len(data.translate(None, _LOW))
    if share < 0.05 or n < 2 or high / n < 0.35 or (n >= 16 and leads < 4):
        return None
    return share, high / n


def promoted(data: bytes, encoding: str, allowed: frozenset[str]) -> str:
    """The superset of a declared encoding, where only that one decodes or its structure fits better."""
    base, superset = {"shift_jis_2004": ("shift_jis", "cp932"), "euc_kr": ("euc_kr", "cp949")}.get(encoding, (None, None))
    if superset is None or superset not in allowed or not decodes(data, superset):
        return encoding
    if not decodes(data, base) or structure(data[:HEAD], superset)[0] > structure(data[:HEAD], encoding)[0]:
        return superset
    return encoding
