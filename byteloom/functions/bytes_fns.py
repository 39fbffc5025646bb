"""Deterministic detection stages as column expressions over a binary column.

The Latin-1 view of the bytes has one character a byte, so counts and patterns are byte-exact and stay
inside the JVM. Each stage returns null where it has nothing to say.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures (hexadecimal) and their MIME types, in the order in which they are tried.
SIGNATURES = (
    ("89504E470D0A1A0A", "image/png"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("4D4D002A", "image/tiff"), ("49492A00", "image/tiff"),
    ("38425053", "image/vnd.adobe.photoshop"), ("716F6966", "image/qoi"), ("424D", "image/bmp"), ("FFD8FF", "image/jpeg"), ("0000000C4A584C200D0A870A", "image/jxl"),
    ("FF0A", "image/jxl"), ("00000100", "image/vnd.microsoft.icon"), ("494433", "audio/mpeg"), ("4D546864", "audio/midi"), ("4F676753", "audio/ogg"),
    ("664C6143", "audio/flac"), ("1A45DFA3", "video/webm"), ("1F8B", "application/gzip"), ("425A68", "application/x-bzip2"), ("FD377A585A00", "application/x-xz"),
    ("377ABCAF271C", "application/x-7z-compressed"), ("526172211A070100", "application/vnd.rar"), ("526172211A0700", "application/vnd.rar"), ("28B52FFD", "application/zstd"), ("255044462D", "application/pdf"),
    ("53514C69746520666F726D6174203300", "application/x-sqlite3"), ("4152524F5731", "application/vnd.apache.arrow.file"), ("50415231", "application/vnd.apache.parquet"), ("0061736D", "application/wasm"), ("6465780A", "application/vnd.android.dex"),
    ("7F454C46", "application/x-elf"), ("FEEDFACE", "application/x-mach-binary"), ("FEEDFACF", "application/x-mach-binary"), ("CEFAEDFE", "application/x-mach-binary"), ("CFFAEDFE", "application/x-mach-binary"),
    ("4D5A", "application/vnd.microsoft.portable-executable"), ("774F4646", "font/woff"), ("774F4632", "font/woff2"), ("4F54544F", "font/otf"), ("00010000", "font/ttf"),
)
# Brands of ISO media files, subtypes of RIFF and FORM containers.
BRANDS = (("avif", "image/avif"), ("avis", "image/avif"), ("heic", "image/heic"), ("heix", "image/heic"), ("mif1", "image/heif"), ("msf1", "image/heif"), ("M4A ", "audio/mp4"), ("M4B ", "audio/mp4"), ("F4A ", "audio/mp4"), ("qt  ", "video/quicktime"))
RIFF = (("WEBP", "image/webp"), ("WAVE", "audio/wav"), ("AVI ", "video/x-msvideo"))
FORM = (("AIFF", "audio/aiff"), ("AIFC", "audio/aiff"))
# Byte order marks (hexadecimal) and their encodings, in the order in which they are tried.
BOMS = (("0000FEFF", "utf-32"), ("FFFE0000", "utf-32"), ("EFBBBF", "utf-8-sig"), ("FEFF", "utf-16"), ("FFFE", "utf-16"))
# Escape sequences (hexadecimal after ESC) of the ISO 2022 encodings, in the order in which they are tried.
ESCAPES = ((("24284F", "242850", "242851"), "iso2022_jp_2004"), (("2849",), "iso2022_jp_ext"), (("2442", "2440", "284A", "242844"), "iso2022_jp_2"), (("242943",), "iso2022_kr"))

MAX_BYTES, MINIMUM_THRESHOLD = 200_000, 0.2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; also keeps a long cascade out of one generated method."""
    return F.element_at(F.transform(F.array(value), body), 1)


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def starts(content: Column, signature: str) -> Column:
    return F.substring(F.hex(F.substring(content, 1, len(signature) // 2)), 1, len(signature)) == signature


def first_of(cases: list[tuple[Column, Column]]) -> Column:
    return F.coalesce(*(F.when(c, v) for c, v in cases))


def count_bytes(content: Column, kinds: str) -> Column:
    return F.regexp_count(latin1(content), F.lit(f"[{kinds}]")).cast("long")


def bom(content: Column) -> Column:
    """The encoding that a byte order mark declares; a UTF-32 mark counts only before whole units."""
    whole = (F.octet_length(content) - 4) % 4 == 0
    return first_of([(starts(content, s) & whole if e == "utf-32" else starts(content, s), F.lit(e)) for s, e in BOMS])


def _tagged(tag: Column, names: tuple, other: Column | None = None) -> Column:
    return F.coalesce(*(F.when(tag == n, F.lit(m)) for n, m in names), *([other] if other is not None else []))


def magic(content: Column) -> Column:
    """The MIME type that a file signature shows; ZIP containers are told apart elsewhere."""
    n, text = F.octet_length(content), latin1(F.substring(content, 1, 264))
    tag = F.substring(text, 9, 4)
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    box = number(1)
    return F.coalesce(
        F.when((n >= 12) & (F.substring(text, 5, 4) == "ftyp") & box.between(8, n), _tagged(tag, BRANDS, F.lit("video/mp4"))),
        F.when((n >= 12) & text.startswith("RIFF"), _tagged(tag, RIFF)),
        F.when((n >= 12) & text.startswith("FORM"), _tagged(tag, FORM)),
        F.when(starts(content, "504B0304"), F.lit("application/zip")),
        F.when((n >= 8) & starts(content, "CAFEBABE"), F.when(number(5) <= 20, F.lit("application/x-mach-binary")).otherwise(F.lit("application/java-vm"))),
        *(F.when(starts(content, s), F.lit(m)) for s, m in SIGNATURES),
        F.when((n >= 263) & F.substring(text, 258, 6).isin("ustar\u0000", "ustar "), F.lit("application/x-tar")),
    )


def escapes(content: Column) -> Column:
    """The ISO 2022 encoding whose escape sequence stands anywhere in the bytes."""
    text = latin1(content)
    has = lambda s: text.contains("\u001b" + bytes.fromhex(s).decode("ascii"))
    out = []
    for marks, name in ESCAPES:
        found = reduce(lambda a, b: a | b, map(has, marks))
        value = F.lit(name)
        if name == "iso2022_jp_2":
            value = F.when(text.contains("\u000e") & text.contains("\u000f"), F.lit("iso2022_jp_ext")).otherwise(value)
        out.append((found, value))
    return first_of(out)


def is_binary(content: Column) -> Column:
    """Over 1 % control bytes, unless the text looks like EBCDIC."""
    n = F.octet_length(content)
    controls = count_bytes(content, r"\x00-\x08\x0e-\x1f")
    tabs, hard = count_bytes(content, r"\x05"), controls - count_bytes(content, r"\x05\x15")
    spaces = count_bytes(content, r"\x40") + tabs
    ebcdic = (count_bytes(content, r"\x80-\xff") / F.greatest(n - spaces, F.lit(1)) >= 0.25) & (spaces / n >= 0.02)
    odd = (hard / n > 0.01) | ((n - spaces > 0) & ~ebcdic)
    return F.when(n == 0, F.lit(False)).otherwise((controls / n > 0.01) & odd)


def ascii_confidence(content: Column) -> Column:
    """1 for plain text, 0.99 with at most 5 % NULs, else null."""
    n, text = F.octet_length(content), latin1(content)
    odd, nuls = F.regexp_count(text, F.lit(r"[^\t\n\r\x20-\x7e]")), F.regexp_count(text, F.lit(r"\x00"))
    return F.when((n == 0) | text.rlike(r"[\x80-\xff]"), F.lit(None)).when(odd == 0, F.lit(1.0)).when((odd == nuls) & (nuls / n <= 0.05), F.lit(0.99)).cast("double")


def utf8_tail(content: Column) -> Column:
    """Bytes before an unfinished sequence among the last three bytes, else all."""
    n, text = F.octet_length(content), latin1(F.substring(content, -3, 3))
    size = F.length(text)
    lead = lambda back, kinds: (size >= back) & F.substring(text, size - back + 1, 1).rlike(f"[{kinds}]")
    return F.when(lead(3, r"\xf0-\xf4"), n - 3).when(lead(2, r"\xe0-\xf4"), n - 2).when(lead(1, r"\xc2-\xf4"), n - 1).otherwise(n)


def utf8_confidence(content: Column) -> Column:
    """Confidence in UTF-8 from the share of multibyte sequences; null without any, or if invalid."""
    whole = F.substring(content, F.lit(1), utf8_tail(content))
    valid = F.is_valid_utf8(content) | F.is_valid_utf8(whole)
    high = F.when(F.is_valid_utf8(content), count_bytes(content, r"\x80-\xff")).otherwise(count_bytes(whole, r"\x80-\xff"))
    share = F.least(high / F.octet_length(content) * 6.0, F.lit(1.0))
    return F.when(valid & (high > 0), F.least(F.lit(0.99), F.lit(0.80) + F.lit(0.99 - 0.80) * share))


def declared(content: Column) -> Column:
    """A struct (name, mime) of the first charset that XML or HTML markup declares in the first 4096 bytes."""
    text = latin1(F.substring(content, 1, 4096))
    s = r"[ \t\r\n\f\x0b]*"
    get = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    xml = get(rf"(?i)<\?xml[^>]+encoding{s}={s}['\"]([^'\"]+)['\"]")
    html5 = get(rf"(?i)<meta[^>]+charset{s}={s}['\"]?{s}([^ \t\r\n\f\x0b'\">;]+)")
    return F.when(xml.isNotNull(), F.struct(xml.alias("name"), F.lit("text/xml").alias("mime"))).when(html5.isNotNull(), F.struct(html5.alias("name"), F.lit("text/html").alias("mime")))
