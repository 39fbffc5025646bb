"""The corpus operators as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.llm import decontaminate, html_extract, license_rules, lm_score, mixing, quality_classifier, quality_rules, simhash_dedup, token_counts, warc
from byteloom.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.license_scan(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_score.lm_scores(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def base2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2's columns that SQL can express."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base4_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 up to its targets."""
    return mixing.source_targets(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def base5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's columns that SQL can express."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 without its network."""
    return lm_score.base_scores(table(spark, sf_dir, "documents")).withColumn("base_score", F.round("base_score", 5))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extract, op2_license_scan, op3_quality_classifier, op4_mixing, op5_quality_rules, op6_token_counts, op7_decontaminate, op8_simhash_dedup, op9_warc, op10_lm_scoring, base2_license, base4_targets, base5_rules, base10_scores)
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Runs of characters that are no ASCII white space.
_RUNS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

BASE2_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases AS (SELECT * FROM (VALUES ('under the mit license', 4, 'mit'), ('apache license version 2', 4, 'apache-2'), ('cc by nc', 3, 'cc-by-nc')) p(phrase, k, label)),
places AS (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM words),
found AS (SELECT doc_id, pos, label FROM places JOIN phrases ON array_to_string(w[pos + 1:pos + k], ' ') = phrase)
SELECT doc_id, any_value(len(w)) AS n_words, count(label) AS n_base, min(pos) AS first_word, max(pos) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM words LEFT JOIN found USING (doc_id) GROUP BY doc_id
"""

#: The full sources are those of the smallest sizes a unit of weight: the fewest for which the rest stays within its bounds.
BASE4_SQL = f"""
WITH docs AS (SELECT doc_id, source, len({_RUNS.format("coalesce(text, '')")}) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1] AS weight FROM docs GROUP BY source),
ordered AS (SELECT *, source_size / weight AS ratio, sum(source_size) OVER o - source_size AS given, sum(weight) OVER () - sum(weight) OVER o + weight AS free, sum(source_size) OVER () AS total FROM sources
  WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
shares AS (SELECT (1.5::DOUBLE * total - 2.0::DOUBLE * given) / free AS share, ratio, given FROM ordered),
chosen AS (SELECT arg_min(share, given) AS share FROM shares WHERE share <= 2 * ratio)
SELECT doc_id, size, source_size, round(least(coalesce(share, 0) * weight, 2.0 * source_size), 6) AS target
FROM docs JOIN sources ON docs.source IS NOT DISTINCT FROM sources.source, chosen
"""

BASE5_SQL = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, {_RUNS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS pos, w FROM words),
threes AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w[pos], w[pos + 1], w[pos + 2]) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT pos + d) AS n FROM threes, (VALUES (0), (1), (2)) x(d) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words) WHERE len({_RUNS.format("line")}) > 0 GROUP BY doc_id),
counts AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
"""

BASE10_SQL = rf"""
WITH docs AS (SELECT doc_id, list_concat({_RUNS.format(_LOWER)}, [chr(10)]) AS w,
  xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda d: ascii(d)::UBIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::UBIGINT) ELSE s // 2 END)), 4294967295::UBIGINT) % 7 = 2 AS held_out FROM documents),
tokens AS (SELECT doc_id, held_out, unnest(w) AS word FROM docs),
counts AS (SELECT word, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY word),
sums AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(n AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + 1 * (v + 1)))), 5) AS base_score
FROM tokens LEFT JOIN counts USING (word), sums GROUP BY doc_id, held_out, n, v
"""


#: Lower-case words of letters, digits and code points from 128, as decontaminate.words takes them.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT q, item_id, w, least({decontaminate.WORDS}, len(w)) AS k FROM (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
item_shingles AS (
  SELECT DISTINCT q, item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) AS s FROM items),
sizes AS (SELECT q, count(*) AS n_item FROM item_shingles GROUP BY q),
doc_shingles AS (
  SELECT DISTINCT r, doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) AS s
  FROM docs, (SELECT DISTINCT k FROM items))
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM doc_shingles JOIN item_shingles USING (k, s) JOIN sizes USING (q)
GROUP BY r, doc_id, q, item_id, n_item
HAVING count(*) >= ceil({decontaminate.SIMILARITY} * n_item - 1e-9)
"""

OP9_SQL = f"""
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, max(page_id) AS first FROM payloads WHERE n >= {warc.MIN_REVISIT} GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM payloads LEFT JOIN firsts USING (digest)
"""


def oracle_sql() -> dict[str, str]:
    """Those without a learnt or iterative part, and the plain columns of others; the rest is tested against brute force."""
    return {"op7_decontaminate": OP7_SQL, "op9_warc": OP9_SQL, "base2_license": BASE2_SQL, "base4_targets": BASE4_SQL, "base5_rules": BASE5_SQL, "base10_scores": BASE10_SQL}
