"""The known encodings: names, aliases, eras, languages, and how names resolve."""

from __future__ import annotations

import enum
import re
from collections.abc import Iterable
from encodings.aliases import aliases as codec_aliases
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Era(enum.IntFlag):
    MODERN_WEB = 1
    LEGACY_ISO = 2
    LEGACY_MAC = 4
    LEGACY_REGIONAL = 8
    DOS = 16
    MAINFRAME = 32
    ALL = 63


class Encoding(NamedTuple):
    ordinal: int
    name: str
    aliases: tuple[str, ...]
    era: int
    is_multibyte: bool
    languages: tuple[str, ...]


# Language groups that several encodings share.
WEST = "br cy da de en es fi fr ga id is it ms nl no pt sv"
CYRILLIC = "ru bg uk sr mk be"

# Encodings in order, as name; aliases; era; languages ("+" marks a multibyte encoding).
ENTRIES = f"""
ascii; us-ascii; MODERN_WEB;
utf-8; utf8 csutf8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8; MODERN_WEB;
utf-8-sig; utf-8-bom; MODERN_WEB;
utf-16; utf16 csutf16; MODERN_WEB;
utf-16-be; utf-16be csutf16be; MODERN_WEB;
utf-16-le; utf-16le csutf16le; MODERN_WEB;
utf-32; utf32 csutf32; MODERN_WEB;
utf-32-be; utf-32be csutf32be; MODERN_WEB;
utf-32-le; utf-32le csutf32le; MODERN_WEB;
utf-7; utf7 csutf7; LEGACY_REGIONAL;
+big5hkscs; big5-hkscs big5 big5-tw csbig5 cp950 cn-big5 x-x-big5 csbig5hkscs; MODERN_WEB; zh
+cp932; ms932 mskanji ms-kanji cswindows31j windows-31j; MODERN_WEB; ja
+cp949; ms949 uhc windows-949 csksc56011987 iso-ir-149 ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601; MODERN_WEB; ko
+euc_jis_2004; euc-jp eucjp ujis u-jis euc-jisx0213 cseucpkdfmtjapanese x-euc-jp; MODERN_WEB; ja
+euc_kr; euckr cseuckr; MODERN_WEB; ko
+gb18030; gb-18030 gb2312 gbk csgb2312 gb_2312 gb_2312-80 x-gbk csiso58gb231280 iso-ir-58 csgb18030 csgbk cp936 ms936 windows-936; MODERN_WEB; zh
+hz; hz-gb-2312; LEGACY_REGIONAL; zh
+iso2022_jp_2; iso-2022-jp-2 iso-2022-jp csiso2022jp iso2022-jp-1 csiso2022jp2; MODERN_WEB; ja
+iso2022_jp_2004; iso-2022-jp-2004 iso2022-jp-3; MODERN_WEB; ja
+iso2022_jp_ext; iso-2022-jp-ext; MODERN_WEB; ja
+iso2022_kr; iso-2022-kr csiso2022kr; LEGACY_REGIONAL; ko
+shift_jis_2004; shift_jis sjis shiftjis s_jis shift-jisx0213 x-sjis csshiftjis ms_kanji; MODERN_WEB; ja
cp874; windows-874 dos-874; MODERN_WEB; th
cp1250; windows-1250 x-cp1250 cswindows1250; MODERN_WEB; pl cs hu hr ro sk sl sr
cp1251; windows-1251 x-cp1251 cswindows1251; MODERN_WEB; {CYRILLIC}
cp1252; windows-1252 x-cp1252 cswindows1252; MODERN_WEB; {WEST}
cp1253; windows-1253 x-cp1253 cswindows1253; MODERN_WEB; el
cp1254; windows-1254 x-cp1254 cswindows1254; MODERN_WEB; tr
cp1255; windows-1255 x-cp1255 cswindows1255; MODERN_WEB; he
cp1256; windows-1256 x-cp1256 cswindows1256; MODERN_WEB; ar fa
cp1257; windows-1257 x-cp1257 cswindows1257; MODERN_WEB; et lt lv
cp1258; windows-1258 x-cp1258 cswindows1258; MODERN_WEB; vi
koi8-r; koi8r koi koi8 cskoi8r; MODERN_WEB; ru
koi8-u; koi8u koi8-ru cskoi8u; MODERN_WEB; uk
tis-620; tis620 iso-8859-11 iso8859-11 iso885911 cstis620; MODERN_WEB; th
iso8859-1; iso-8859-1 latin-1 latin1 iso88591; LEGACY_ISO; {WEST}
iso8859-2; iso-8859-2 latin-2 latin2 iso88592; LEGACY_ISO; pl cs hu hr ro sk sl
iso8859-3; iso-8859-3 latin-3 latin3 iso88593; LEGACY_ISO; eo mt tr
iso8859-4; iso-8859-4 latin-4 latin4 iso88594; LEGACY_ISO; et lt lv
iso8859-5; iso-8859-5 cyrillic iso88595; LEGACY_ISO; {CYRILLIC}
iso8859-6; iso-8859-6 arabic iso88596 iso-8859-6-e iso-8859-6-i csiso88596e csiso88596i; LEGACY_ISO; ar fa
iso8859-7; iso-8859-7 greek iso88597 sun_eu_greek; LEGACY_ISO; el
iso8859-8; iso-8859-8 hebrew iso88598 iso-8859-8-e iso-8859-8-i csiso88598e csiso88598i visual logical; LEGACY_ISO; he
iso8859-9; iso-8859-9 latin-5 latin5 iso88599; LEGACY_ISO; tr
iso8859-10; iso-8859-10 latin-6 latin6 iso885910; LEGACY_ISO; is fi
iso8859-13; iso-8859-13 latin-7 latin7 iso885913 csiso885913; LEGACY_ISO; et lt lv
iso8859-14; iso-8859-14 latin-8 latin8 iso885914 csiso885914 iso-ir-199 iso-celtic l8; LEGACY_ISO; cy ga br gd
iso8859-15; iso-8859-15 latin-9 latin9 iso885915 csisolatin9 csiso885915 l9; LEGACY_ISO; {WEST}
iso8859-16; iso-8859-16 latin-10 latin10 iso885916 csiso885916 iso-ir-226 l10; LEGACY_ISO; ro pl hr hu sk sl
+johab; ; LEGACY_ISO; ko
mac-cyrillic; maccyrillic x-mac-cyrillic x-mac-ukrainian; LEGACY_MAC; {CYRILLIC}
mac-greek; macgreek; LEGACY_MAC; el
mac-iceland; maciceland; LEGACY_MAC; is
mac-latin2; maclatin2 maccentraleurope; LEGACY_MAC; pl cs hu hr sk sl
mac-roman; macroman macintosh csmacintosh mac x-mac-roman; LEGACY_MAC; {WEST}
mac-turkish; macturkish; LEGACY_MAC; tr
cp720; ; LEGACY_REGIONAL; ar fa
cp1006; ; LEGACY_REGIONAL; ur
cp1125; ; LEGACY_REGIONAL; uk
koi8-t; ; LEGACY_REGIONAL; tg
kz1048; kz-1048 strk1048-2002 rk1048; LEGACY_REGIONAL; kk
ptcp154; pt154 cp154; LEGACY_REGIONAL; kk
hp-roman8; roman8 r8 cshproman8; LEGACY_REGIONAL; {WEST}
cp437; ; DOS; en fr de es pt it nl da sv fi ga
cp737; ; DOS; el
cp775; ; DOS; et lt lv
cp850; ; DOS; {WEST}
cp852; ; DOS; pl cs hu hr ro sk sl
cp855; ; DOS; {CYRILLIC}
cp856; ; DOS; he
cp857; ; DOS; tr
cp858; ; DOS; {WEST}
cp860; ; DOS; pt
cp861; ; DOS; is
cp862; ; DOS; he
cp863; ; DOS; fr
cp864; ; DOS; ar
cp865; ; DOS; da no
cp866; ; DOS; {CYRILLIC}
cp869; ; DOS; el
cp1140; cp037 cp01140 ibm01140 ibm1140 csibm01140; MAINFRAME; {WEST} tr
cp424; ; MAINFRAME; he
cp500; ; MAINFRAME; {WEST}
cp875; ; MAINFRAME; el
cp1026; ; MAINFRAME; tr
cp273; ; MAINFRAME; de
"""

# Names beyond the aliases above.
EXTRA = {"chinese": "gb18030", "korean": "euc_kr", "ibm855": "cp855", "ibm866": "cp866"}

# The superset that is preferred to an encoding, and display names.
SUPERSETS = {"ascii": "cp1252", "euc_kr": "cp949", "iso8859-1": "cp1252", "iso8859-2": "cp1250", "iso8859-5": "cp1251", "iso8859-6": "cp1256", "iso8859-7": "cp1253", "iso8859-8": "cp1255", "iso8859-9": "cp1254", "iso8859-11": "cp874", "iso8859-13": "cp1257", "tis-620": "cp874"}
DISPLAY = {
    "big5hkscs": "Big5", "cp855": "IBM855", "cp866": "IBM866", "cp874": "CP874", "cp932": "CP932", "cp949": "CP949", "euc_jis_2004": "EUC-JP", "euc_kr": "EUC-KR",
    "gb18030": "GB18030", "hz": "HZ-GB-2312", "iso2022_jp_2": "ISO-2022-JP", "iso2022_kr": "ISO-2022-KR", "iso8859-1": "ISO-8859-1", "iso8859-2": "ISO-8859-2",
    "iso8859-5": "ISO-8859-5", "iso8859-6": "ISO-8859-6", "iso8859-7": "ISO-8859-7", "iso8859-8": "ISO-8859-8", "iso8859-9": "ISO-8859-9", "iso8859-13": "ISO-8859-13",
    "johab": "Johab", "koi8-r": "KOI8-R", "mac-cyrillic": "MacCyrillic", "mac-roman": "MacRoman", "shift_jis_2004": "SHIFT_JIS", "tis-620": "TIS-620", "utf-16": "UTF-16",
    "utf-32": "UTF-32", "utf-8-sig": "UTF-8-SIG", "cp1250": "Windows-1250", "cp1251": "Windows-1251", "cp1252": "Windows-1252", "cp1253": "Windows-1253", "cp1254": "Windows-1254",
    "cp1255": "Windows-1255", "cp1256": "Windows-1256", "cp1257": "Windows-1257", "kz1048": "KZ1048", "mac-greek": "MacGreek", "mac-iceland": "MacIceland", "mac-latin2": "MacLatin2", "mac-turkish": "MacTurkish",
}

# ISO 639-1 codes and their English names.
LANGUAGES = {
    "ar": "arabic", "be": "belarusian", "bg": "bulgarian", "br": "breton", "cs": "czech", "cy": "welsh", "da": "danish", "de": "german", "el": "greek", "en": "english",
    "eo": "esperanto", "es": "spanish", "et": "estonian", "fa": "farsi", "fi": "finnish", "fr": "french", "ga": "irish", "gd": "gaelic", "he": "hebrew", "hr": "croatian",
    "hu": "hungarian", "id": "indonesian", "is": "icelandic", "it": "italian", "ja": "japanese", "kk": "kazakh", "ko": "korean", "lt": "lithuanian", "lv": "latvian", "mk": "macedonian",
    "ms": "malay", "mt": "maltese", "nl": "dutch", "no": "norwegian", "pl": "polish", "pt": "portuguese", "ro": "romanian", "ru": "russian", "sk": "slovak", "sl": "slovene",
    "sr": "serbian", "sv": "swedish", "tg": "tajik", "th": "thai", "tr": "turkish", "uk": "ukrainian", "und": "undetermined", "ur": "urdu", "vi": "vietnamese", "zh": "chinese",
}


def _entries() -> tuple[Encoding, ...]:
    out = []
    for line in ENTRIES.strip().splitlines():
        name, aliases, era, languages = (x.strip() for x in line.split(";"))
        out.append(Encoding(len(out), name.lstrip("+"), tuple(aliases.split()), int(Era[era]), name[0] == "+", tuple(languages.split())))
    return tuple(out)


REGISTRY = _entries()
BY_NAME = {e.name: e for e in REGISTRY}


def normalize(name: str) -> str:
    return re.sub("[^a-z0-9]", "_", "".join(c.lower() if c < "\x80" else c for c in name))


@cache
def name_index() -> dict[str, str]:
    """normalized name -> encoding: own names and aliases, the earlier first, then Python's aliases, then EXTRA."""
    found: dict[str, str] = {}
    for e in REGISTRY:
        for name in (e.name, *e.aliases):
            found.setdefault(normalize(name), e.name)
    for alias, codec in codec_aliases.items():
        known = found.get(normalize(codec))
        if known:
            found.setdefault(normalize(alias), known)
    for name, encoding in EXTRA.items():
        found.setdefault(name, encoding)
    return found


def lookup(name: str) -> str | None:
    return name_index().get(normalize(name))


def validate(name: str) -> str:
    found = lookup(name)
    if found is None:
        raise ValueError(f'Unknown encoding "{name}"')
    return found


def filtered(names: Iterable[str] | None) -> frozenset[str] | None:
    """The encodings that names resolve to; no filter stays none, an empty one is an error."""
    if names is None:
        return None
    found = frozenset(map(validate, names))
    if not found:
        raise ValueError("encoding filter must not be empty")
    return found


def candidates(era: int = Era.ALL, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> list[Encoding]:
    wanted, unwanted = filtered(include), filtered(exclude) or frozenset()
    return [e for e in REGISTRY if e.era & era and (wanted is None or e.name in wanted) and e.name not in unwanted]


def _mapped(key: Column, pairs: dict[str, str]) -> Column:
    return F.element_at(F.map_from_arrays(F.lit(list(pairs)), F.lit(list(pairs.values()))), key)


def normalize_column(name: Column) -> Column:
    ascii_lower = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(ascii_lower, "[^a-z0-9]", "_")


def lookup_column(name: Column) -> Column:
    """The encoding a name or alias stands for, else null."""
    return _mapped(normalize_column(name), name_index())


def superset_column(encoding: Column) -> Column:
    """The preferred superset of an encoding, regardless of the bytes."""
    return F.coalesce(_mapped(encoding, SUPERSETS), encoding)


def display_column(encoding: Column) -> Column:
    return F.coalesce(_mapped(encoding, DISPLAY), encoding)


def language_column(code: Column) -> Column:
    return _mapped(code, LANGUAGES)


def registry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(e) for e in REGISTRY], "ordinal int, name string, aliases array<string>, era int, is_multibyte boolean, languages array<string>")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(name_index().items()), "alias string, name string")
