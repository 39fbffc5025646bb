"""The registered queries of the detection engine and their SQL twins for DuckDB.

The tables have no binary column, so queries on signatures put a prefix, chosen by the document's id,
before each text; both engines build the same bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.functions import bytes_fns as B
from byteloom.functions import models as M
from byteloom.functions import registry as R
from byteloom.operators.detect import detect_deterministic
from byteloom.operators.identify import detect, detect_all_rows
from byteloom.sources import files
from byteloom.streaming.detector import detect_chunks

#: Prefixes that the cases get in turn, in hexadecimal.
PREFIXES = (
    "", "EFBBBF", "FEFF", "FFFE", "0000FEFF", "FFFE0000", "89504E470D0A1A0A", "474946383961", "1F8B", "1B2442", "255044462D", "00000018667479706D703432",
    "524946460000000057454250", "0001020304050607", "CAFEBABE00000003", "CAFEBABE00000034", "1B284920", "1B242943", "0000001866747970617669662020", "464F524D0000000041494643",
)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.pmod("doc_id", F.lit(len(PREFIXES))) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.unhex(prefix), F.col("text").cast("binary")).alias("content"))


CASES = f"WITH cases AS (SELECT doc_id, unhex(([{', '.join(repr(p) for p in PREFIXES)}])[(doc_id % {len(PREFIXES)}) + 1]) || encode(text) AS content, hex(content) AS h FROM documents) "


def encoding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("html").cast("binary").alias("content"))
    found = B.declared(F.col("content"))
    return pages.groupBy(F.lower(found["name"]).alias("encoding"), found["mime"].alias("mime_type")).agg(F.count("*").alias("n_pages"))


def q_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("doc_id", B.bom(F.col("content")).alias("encoding"))


def q_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("doc_id", B.magic(F.col("content")).alias("mime_type"))


def q_iso2022(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("doc_id", B.escapes(F.col("content")).alias("encoding"))


def q_byte_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return cases(spark, sf_dir).select("doc_id", F.octet_length(c).cast("long").alias("n_bytes"), B.count_bytes(c, r"\x80-\xff").alias("n_high"), B.count_bytes(c, r"\x00-\x08\x0e-\x1f").alias("n_control"))


def q_binary_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("doc_id", B.is_binary(F.col("content")).alias("is_binary"))


def q_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", B.ascii_confidence(F.col("text").cast("binary")).alias("confidence"))


def q_utf8_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.round(B.utf8_confidence(F.col("text").cast("binary")), 9).alias("confidence"))


def q_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_deterministic(cases(spark, sf_dir)).select("doc_id", "detected.encoding", F.round("detected.confidence", 9).alias("confidence"), "detected.mime_type")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))


#: Names that the documents get in turn: every known alias in capitals, and one that is unknown.
ASKED = (*(a.upper().replace("_", "-") for a in sorted(R.name_index())), "no such name")


def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.lit(list(ASKED)), (F.pmod("doc_id", F.lit(len(ASKED))) + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", asked.alias("asked")).select("doc_id", "asked", R.lookup_column(F.col("asked")).alias("encoding"))


def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every set of eras with the encodings it admits; both sides are fixed and small."""
    masks = F.explode(F.sequence(F.lit(1), F.lit(63))).alias("mask")
    return R.registry_table(spark).select("*", masks).where(F.col("era").bitwiseAND(F.col("mask")) != 0).select("mask", "ordinal", "name")


def q_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return R.registry_table(spark).select("name", R.superset_column(name).alias("superset"), R.display_column(name).alias("display"), F.when(F.size("languages") == 1, R.language_column(F.element_at("languages", 1))).alias("language"))


def q_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.declared(F.col("html").cast("binary"))
    return _table(spark, sf_dir, "pages").select("page_id", R.display_column(R.lookup_column(found["name"])).alias("encoding"))


def q_text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.struct(R.display_column(F.col("mark")).alias("encoding"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("language"), F.lit("text/plain").alias("mime_type"))
    marked = cases(spark, sf_dir).select("doc_id", B.bom(F.col("content")).alias("mark")).where("mark IS NOT NULL")
    return marked.select("doc_id", files.text_line(F.col("doc_id"), found, language=True, mime_type=True).alias("line"), files.minimal_line(found).alias("minimal"), files.raw_line(F.col("doc_id"), found).alias("raw"))


def q_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent byte pairs of all texts, but for blanks that repeat, counted; pairs are at most 65536 rows."""
    return M.bigram_counts(_texts(spark, sf_dir))


def q_differing_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the high bytes two Latin encodings read differently: a join of their code tables on the byte."""
    rows = [(e, b, ord(c)) for e in LATIN for b, c in enumerate(bytes(range(256)).decode(e, "replace")) if b >= 0x80]
    code = spark.createDataFrame(rows, "encoding string, byte int, cp int")
    a, b = code.alias("a"), code.alias("b")
    differ = a.join(b, (F.col("a.byte") == F.col("b.byte")) & (F.col("a.encoding") < F.col("b.encoding")) & (F.col("a.cp") != F.col("b.cp")))
    return differ.groupBy(F.col("a.encoding").alias("first"), F.col("b.encoding").alias("second")).agg(F.count("*").alias("n_bytes"))


LATIN = ("cp1252", "cp850", "iso8859-1", "iso8859-15", "iso8859-9")


def q_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_texts(spark, sf_dir)).select("doc_id", "detected.encoding", F.round("detected.confidence", 9).alias("confidence"), "detected.mime_type")


def q_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With models trained on the table's own languages."""
    models = M.train(_table(spark, sf_dir, "documents"))
    return detect(_texts(spark, sf_dir), models=models).select("doc_id", "detected.*")


def q_detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in Latin-1, ranked; characters that it lacks become question marks."""
    models = M.train(_table(spark, sf_dir, "documents"))
    plain = F.encode(F.regexp_replace("text", "[^\\x00-\\x7f\\xa0-\\xff]", "?"), "ISO-8859-1")
    return detect_all_rows(_table(spark, sf_dir, "documents").select("doc_id", plain.alias("content")), models=models).drop("content")


def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a stream of chunks."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").cast("binary").alias("chunk"))
    return detect_chunks(turns).select(F.col("stream_id").alias("conv_id"), "truncated", "detected.encoding", F.round("detected.confidence", 9).alias("confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (encoding_summary, q_bom, q_magic, q_iso2022, q_byte_profile, q_binary_flag, q_ascii, q_utf8_confidence, q_detect, q_lookup, q_candidates, q_output_names, q_declared, q_text_sink, q_bigrams, q_differing_bytes, q_identify, q_identify_language, q_detect_all, q_chunks)}


def _rows(rows: list[tuple], columns: str) -> str:
    """A table of fixed values."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns}))"


def _bytes(kinds: str) -> str:
    return f"CAST(len(list_filter(regexp_extract_all(h, '..'), lambda x: {kinds})) AS BIGINT)"


_CONTROL = "x < '09' OR (x >= '0E' AND x < '20')"


def oracle_sql() -> dict[str, str]:
    marks = " ".join(f"WHEN starts_with(h, '{s}'){' AND (octet_length(content) - 4) % 4 = 0' if e == 'utf-32' else ''} THEN '{e}'" for s, e in B.BOMS)
    hexed = lambda pairs: " ".join(f"WHEN '{n.encode().hex().upper()}' THEN '{m}'" for n, m in pairs)
    n, box, tag = "octet_length(content)", "CAST(('0x' || substr(h, 1, 8)) AS BIGINT)", "substr(h, 17, 8)"
    signs = " ".join(f"WHEN starts_with(h, '{s}') THEN '{m}'" for s, m in B.SIGNATURES)
    magic = (
        f"CASE WHEN {n} >= 12 AND substr(h, 9, 8) = '66747970' AND {box} BETWEEN 8 AND {n} THEN CASE {tag} {hexed(B.BRANDS)} ELSE 'video/mp4' END "
        f"WHEN {n} >= 12 AND starts_with(h, '52494646') AND {tag} IN ('57454250', '57415645', '41564920') THEN CASE {tag} {hexed(B.RIFF)} END "
        f"WHEN {n} >= 12 AND starts_with(h, '464F524D') AND {tag} IN ('41494646', '41494643') THEN 'audio/aiff' "
        f"WHEN starts_with(h, '504B0304') THEN 'application/zip' "
        f"WHEN {n} >= 8 AND starts_with(h, 'CAFEBABE') THEN CASE WHEN CAST(('0x' || substr(h, 9, 8)) AS BIGINT) <= 20 THEN 'application/x-mach-binary' ELSE 'application/java-vm' END "
        f"{signs} WHEN {n} >= 263 AND substr(h, 515, 12) IN ('757374617200', '757374617220') THEN 'application/x-tar' END"
    )
    esc = " ".join(f"WHEN {' OR '.join(f"regexp_matches(h, '^(..)*1B{m}')" for m in marks_)} THEN " + (f"CASE WHEN regexp_matches(h, '^(..)*0E') AND regexp_matches(h, '^(..)*0F') THEN 'iso2022_jp_ext' ELSE '{e}' END" if e == "iso2022_jp_2" else f"'{e}'") for marks_, e in B.ESCAPES)
    plain = r"regexp_replace(text, '[\t\n\r\x20-\x7e]', '', 'g')"
    high = r"(strlen(text) - length(regexp_replace(text, '[^\x00-\x7f]', '', 'g')))"
    entries = _rows([(e.ordinal, e.name, e.era, R.SUPERSETS.get(e.name, e.name), R.DISPLAY.get(e.name, e.name), R.LANGUAGES.get(e.languages[0]) if len(e.languages) == 1 else None) for e in R.REGISTRY], "ordinal, name, era, superset, display, language")
    aliases, asked = _rows(sorted(R.name_index().items()), "alias, name"), _rows(list(enumerate(ASKED)), "k, asked")
    normal = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '_', 'g')"
    charset = r"""regexp_extract(html, '(?i)<meta[^>]+charset[ \t\r\n]*=[ \t\r\n]*[''"]?[ \t\r\n]*([^ \t\r\n''">;]+)', 1)"""
    marked = "('UTF-8-SIG', 'utf-8-sig'), ('UTF-16', 'utf-16'), ('UTF-32', 'utf-32')"
    blanks = ", ".join(f"'{x:02X}{x:02X}'" for x in M.BLANKS)
    latin = _rows([(e, b, ord(c)) for e in LATIN for b, c in enumerate(bytes(range(256)).decode(e, "replace")) if b >= 0x80], "encoding, byte, cp")
    by_utf8 = lambda t: f"least(CAST(0.99 AS DOUBLE), CAST(0.80 AS DOUBLE) + CAST(0.19 AS DOUBLE) * least(CAST((strlen({t}) - length(regexp_replace({t}, '[^\\x00-\\x7f]', '', 'g'))) AS DOUBLE) / strlen({t}) * 6.0, 1.0))"
    known = lambda t: f"CASE WHEN {t} = '' THEN 'utf-8' WHEN strlen({t}) = length({t}) THEN 'ascii' ELSE 'utf-8' END AS encoding, round(CASE WHEN {t} = '' THEN CAST(0.1 AS DOUBLE) WHEN strlen({t}) = length({t}) THEN CAST(1.0 AS DOUBLE) ELSE {by_utf8(t)} END, 9) AS confidence"
    return {
        "q_lookup": f"SELECT d.doc_id, a.asked, n.name AS encoding FROM documents d JOIN {asked} a ON a.k = d.doc_id % {len(ASKED)} LEFT JOIN {aliases} n ON n.alias = {normal('a.asked')}",
        "q_candidates": f"SELECT CAST(mask AS INTEGER) AS mask, ordinal, name FROM {entries} e, range(1, 64) m(mask) WHERE era & mask <> 0",
        "q_output_names": f"SELECT name, superset, display, language FROM {entries} e",
        "q_declared": f"SELECT page_id, e.display AS encoding FROM pages LEFT JOIN {aliases} a ON a.alias = {normal(charset)} LEFT JOIN {entries} e ON e.name = a.name",
        "q_text_sink": f"{CASES}, found AS (SELECT doc_id, CASE {marks} END AS mark FROM cases), shown AS (SELECT doc_id, display FROM found JOIN (SELECT * FROM (VALUES {marked}) t(display, mark)) USING (mark)) SELECT doc_id, doc_id || ': ' || display || ' und (Undetermined) text/plain with confidence 1' AS line, display AS minimal, doc_id || chr(9) || display || chr(9) || '1' || chr(9) || 'None' || chr(9) || 'text/plain' AS raw FROM shown",
        "q_bigrams": f"WITH b AS (SELECT regexp_extract_all(hex(encode(text)), '..') AS l FROM documents), p AS (SELECT unnest(list_transform(list_zip(l[1:len(l) - 1], l[2:]), lambda x: x[1] || x[2])) AS pair FROM b WHERE len(l) > 1) SELECT pair, count(*) AS n FROM p WHERE pair NOT IN ({blanks}) GROUP BY pair",
        "q_differing_bytes": f"SELECT a.encoding AS first, b.encoding AS second, count(*) AS n_bytes FROM {latin} a JOIN {latin} b ON a.byte = b.byte AND a.encoding < b.encoding AND a.cp <> b.cp GROUP BY 1, 2",
        "q_identify": f"SELECT doc_id, {known('text')}, 'text/plain' AS mime_type FROM documents",
        "q_chunks": f"WITH w AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, strlen(t) > 200000 AS truncated, {known('t')} FROM w",
        "encoding_summary": r"""SELECT lower(regexp_extract(html, '(?i)<meta[^>]+charset[ \t\r\n]*=[ \t\r\n]*[''"]?[ \t\r\n]*([^ \t\r\n''">;]+)', 1)) AS encoding, 'text/html' AS mime_type, count(*) AS n_pages FROM pages GROUP BY 1, 2""",
        "q_bom": f"{CASES} SELECT doc_id, CASE {marks} END AS encoding FROM cases",
        "q_magic": f"{CASES} SELECT doc_id, {magic} AS mime_type FROM cases",
        "q_iso2022": f"{CASES} SELECT doc_id, CASE {esc} END AS encoding FROM cases",
        "q_byte_profile": f"{CASES} SELECT doc_id, CAST({n} AS BIGINT) AS n_bytes, {_bytes("x >= '80'")} AS n_high, {_bytes(_CONTROL)} AS n_control FROM cases",
        "q_detect": f"{CASES}, known AS (SELECT doc_id, doc_id % {len(PREFIXES)} AS p, octet_length(content) AS n, text, {plain} = '' AS plain, {_bytes("x = '00'")} / least(octet_length(content), 4096) >= 0.015 AND octet_length(content) >= 10 AS zeros, {high} AS high FROM cases JOIN documents USING (doc_id)), "
        "found AS (SELECT *, CASE WHEN p IN (1, 2, 3) OR p IN (4, 5) AND n % 4 = 0 OR p = 5 THEN 'mark' WHEN p IN (9, 16, 17) THEN 'escape' WHEN p IN (6, 7, 8, 10) OR p IN (12, 14, 15, 19) AND NOT zeros OR p IN (11, 18) AND NOT zeros AND n >= 24 THEN 'file' "
        "WHEN p = 13 AND NOT zeros AND high > 0 THEN 'utf8' WHEN p = 13 AND NOT zeros AND n < 800 OR p = 4 AND NOT zeros AND n < 200 THEN 'binary' WHEN p > 0 THEN 'unsure' WHEN n = 0 THEN 'empty' WHEN plain AND regexp_matches(text, '~\\{|\\+[A-Za-z0-9+/]{2}') THEN 'unsure' WHEN plain THEN 'ascii' ELSE 'utf8' END AS kind FROM known) "
        "SELECT doc_id, CASE kind WHEN 'mark' THEN CASE p WHEN 1 THEN 'utf-8-sig' WHEN 4 THEN 'utf-32' WHEN 5 THEN CASE WHEN n % 4 = 0 THEN 'utf-32' ELSE 'utf-16' END ELSE 'utf-16' END WHEN 'escape' THEN CASE p WHEN 9 THEN 'iso2022_jp_2' WHEN 16 THEN 'iso2022_jp_ext' ELSE 'iso2022_kr' END WHEN 'empty' THEN 'utf-8' WHEN 'ascii' THEN 'ascii' WHEN 'utf8' THEN 'utf-8' END AS encoding, "
        "CAST(CASE kind WHEN 'mark' THEN 1.0 WHEN 'escape' THEN 0.95 WHEN 'file' THEN 1.0 WHEN 'binary' THEN 0.95 WHEN 'empty' THEN 0.1 WHEN 'ascii' THEN 1.0 WHEN 'utf8' THEN round(least(CAST(0.99 AS DOUBLE), CAST(0.80 AS DOUBLE) + CAST(0.19 AS DOUBLE) * least(CAST(high AS DOUBLE) / n * 6.0, 1.0)), 9) END AS DOUBLE) AS confidence, "
        "CASE WHEN kind = 'binary' THEN 'application/octet-stream' WHEN kind = 'file' THEN CASE p WHEN 6 THEN 'image/png' WHEN 7 THEN 'image/gif' WHEN 8 THEN 'application/gzip' WHEN 10 THEN 'application/pdf' WHEN 11 THEN 'video/mp4' WHEN 12 THEN 'image/webp' WHEN 14 THEN 'application/x-mach-binary' WHEN 15 THEN 'application/java-vm' WHEN 18 THEN 'image/avif' ELSE 'audio/aiff' END WHEN kind <> 'unsure' THEN 'text/plain' END AS mime_type FROM found",
        "q_binary_flag": f"{CASES}, counts AS (SELECT doc_id, {n} AS n, {_bytes(_CONTROL)} AS controls, {_bytes("x IN ('05', '15')")} AS soft, {_bytes("x IN ('40', '05')")} AS spaces, {_bytes("x >= '80'")} AS high FROM cases) "
        "SELECT doc_id, n > 0 AND controls / n > 0.01 AND ((controls - soft) / n > 0.01 OR (n > spaces AND NOT (high / greatest(n - spaces, 1) >= 0.25 AND spaces / n >= 0.02))) AS is_binary FROM counts",
        "q_ascii": f"SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN length({plain}) = 0 THEN CAST(1.0 AS DOUBLE) END AS confidence FROM documents",
        "q_utf8_confidence": f"SELECT doc_id, round(CASE WHEN {high} > 0 THEN least(CAST(0.99 AS DOUBLE), CAST(0.80 AS DOUBLE) + CAST(0.19 AS DOUBLE) * least(CAST({high} AS DOUBLE) / strlen(text) * 6.0, 1.0)) END, 9) AS confidence FROM documents",
    }
