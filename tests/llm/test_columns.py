"""Extra columns, whatever their names: filters hand them on untouched, digests ignore them."""

import random

import pytest
from pyspark.sql import functions as F

from byteloom.llm import decontaminate, html_extract, license_rules, lm_score, mixing, quality_classifier, quality_rules, simhash_dedup, token_counts, warc
from byteloom.llm import queries as q

NAMES = ["a.b", "x`y", "with space", "__doc", "__content", "__row", "__fp", "__first", "__key", "__size", "__hash", "__octave", "__bucket", "__score", "__label", "__copies", "__all", "id", "content", "held", "score", "kept", "word", "n", "size", "taken", "mix_copies", "Mix_Taken", "component_id", "fingerprint", "n_words", "item_id", "key", "page", "first", "digest", "refers_to", "host", "__byteloom_rules"]


WORDS = [a + b for a in "ba ce di fo gu la me ni po ru sa te vi wo".split() for b in "len rin tas mor vel dun ket sol par nis gan tor bel cus dar".split()]


def long_text(k):
    rng = random.Random(k)
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(12))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "x" * 200_000, "\0 b", long_text(3), long_text(3), *(long_text(k) for k in range(4, 12)), "under the mit license " * 30]
    rows = [(k, t, "en", None if k % 4 == 0 else "s", None) for k, t in enumerate(texts)] + [(None, long_text(5), None, None, None)]
    return with_extras(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def with_extras(df):
    return df.select("*", *(F.concat(F.lit("v"), F.col(df.columns[0]).cast("string")).alias(n) for n in NAMES if n not in df.columns))


def items(spark):
    return with_extras(spark.createDataFrame([(1, " ".join(long_text(7).split()[5:40])), (None, None)], "item_id long, text string"))


@pytest.mark.parametrize("stage", [quality_rules, quality_classifier, simhash_dedup, decontaminate, mixing], ids=lambda m: m.__name__.rsplit(".", 1)[1])
def test_filters_keep_columns(spark, docs, stage, tmp_path):
    out = stage.apply_mix(docs) if stage is mixing else stage.filter_documents(docs, items(spark)) if stage is decontaminate else stage.filter_documents(docs)
    own = [c for c in docs.columns if stage is not mixing or c.lower() not in ("mix_copies", "mix_taken")]
    assert out.columns == [*own, *(["mix_copies", "mix_taken"] if stage is mixing else [])]
    whole = {r[0]: r for r in docs.collect()}
    at = [docs.columns.index(c) for c in own]
    rows = out.collect()
    assert rows and all(tuple(r)[: len(own)] == tuple(whole[r[0]][i] for i in at) for r in rows)
    out.write.parquet(str(tmp_path / "out"))


def test_digests_ignore_columns(spark, docs):
    import public_tokenizers

    n = docs.count()
    assert quality_rules.quality_rules(docs).count() == n
    assert quality_classifier.quality_scores(docs).count() == n
    assert simhash_dedup.simhash_dedup(docs).count() == n
    assert mixing.mix(docs).count() == n
    assert license_rules.license_scan(docs).count() == n
    assert token_counts.token_counts(docs, q.tokenizer_path()).count() == n
    assert lm_score.lm_scores(docs, q.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == n
    # The passage of 35 words stands in the document that it was cut from.
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, items(spark)).collect()} >= {9}
    pages = with_extras(spark.createDataFrame([(1, "http://a/x", "<p>hi</p>"), (2, None, None), (None, "http://a/y", "<b>" * 3000)], "page_id long, url string, html string"))
    assert html_extract.main_text(pages).count() == warc.round_trip(pages).count() == 3
