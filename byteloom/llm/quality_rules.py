"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of
vote patterns (at most 3**10 rows) estimates how far each rule can be trusted, and a document stays if
its posterior probability of being good is at least one half. No document needs another one's rows:
the only shuffle is the partial count of vote patterns.

Defined results: null and empty texts have no words, so they fail the base rules; repeated rows get
equal verdicts; an empty table gives an empty result; extra columns are kept by filter_documents and
ignored by annotate, whose own columns live in one struct so that names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.llm import vote_em
from byteloom.llm.common import DOC, let, materialize, packed

SPACE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
FEATURES = "__byteloom_rules"


def _n_removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeats(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each word once.

    Windows are told apart by 64-bit hashes within one document. Only documents with a repeated window
    pay for the sort that finds where.
    """
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(hashes[i], hashes[i + 1], hashes[i + 2]))

    def covered(win: Column) -> Column:
        ranked = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            m = F.size(s)
            return F.sort_array(
                F.filter(
                    F.transform(
                        s,
                        lambda x, k: F.when(((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < m - 1) & (F.get(s, k + 1)["h"] == x["h"])), x["i"]).otherwise(F.lit(-1)),
                    ),
                    lambda p: p >= 0,
                )
            )

        total = F.aggregate(
            let(ranked, starts),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + 3).alias("end")),
        )["n"]
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(total)

    return F.when(n < 3, F.lit(0)).otherwise(let(windows, covered))


def features(text: Column) -> Column:
    """A struct of the counts that the rules look at; text must not be null."""
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _repeats(h).cast("long").alias("n_repeat_words")))
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    return let(
        F.struct(counted.alias("c"), lines.alias("l")),
        lambda s: F.struct(
            s["c"]["n_words"].alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            _n_removed(text, SYMBOLS).cast("long").alias("n_symbols"),
            s["l"]["n_dup_lines"].alias("n_dup_lines"),
            s["c"]["n_repeat_words"].alias("n_repeat_words"),
            s["l"]["n_lines"].alias("n_lines"),
            _n_removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
            _n_removed(text, "!").cast("long").alias("n_bangs"),
            _n_removed(text, "0123456789").cast("long").alias("n_digits"),
            _n_removed(text, ".,;:?").cast("long").alias("n_stops"),
        ),
    )


def rules(f: Column) -> list[Column]:
    """The votes: 1 good, -1 bad, 0 abstains.

    Most rules know one kind of junk and are silent otherwise; for each kind there are two or more that
    overlap, so that their agreement, not one threshold, decides.
    """
    words, chars = F.greatest(f["n_words"], F.lit(1)), F.greatest(f["word_chars"], F.lit(1))
    symbols, bangs, upper, digits = f["n_symbols"] / words, f["n_bangs"] / words, f["n_upper"] / chars, f["n_digits"] / chars
    repeats, dups = f["n_repeat_words"] / words, f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1))
    stops, length = f["n_stops"] / words, f["word_chars"] / words
    bad_if = lambda x: F.when(x, -1).otherwise(0)
    return [
        bad_if(symbols > 0.25),
        bad_if(f["n_symbols"] / chars > 0.04),
        bad_if(upper > 0.4),
        bad_if(bangs > 0.3),
        bad_if(repeats > 0.3),
        bad_if((dups > 0.5) & (f["n_dup_lines"] > 1)),
        bad_if(digits > 0.25),
        bad_if((length > 12) | (length < 2)),
        F.when((symbols < 0.1) & (bangs < 0.1) & (upper < 0.2) & (digits < 0.1) & (repeats < 0.25), 1).otherwise(0),
        F.when((stops == 0) & (words > 80), -1).when(stops.between(0.02, 0.5), 1).otherwise(0),
    ]


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def annotate(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns of docs plus one struct of features, written to the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return materialize(docs.select(*keep, features(text).alias(FEATURES)), "rules")


def fit(annotated: DataFrame) -> vote_em.VoteModel:
    """Rule accuracies from the vote patterns of all documents that the base rules let through."""
    f = F.col(FEATURES)
    votes = rules(f)
    names = [f"v{j}" for j in range(len(votes))]
    rows = annotated.where(~base_failed(f)).select(*(v.cast("int").alias(n) for v, n in zip(votes, names, strict=True))).groupBy(*names).count().collect()
    return vote_em.fit({tuple(r[n] for n in names): r["count"] for r in rows}, len(votes))


def log_odds(model: vote_em.VoteModel) -> Column:
    total = F.lit(model.prior)
    for v, (bad, quiet, good) in zip(rules(F.col(FEATURES)), model.weight, strict=True):
        total = total + F.when(v < 0, F.lit(bad)).when(v > 0, F.lit(good)).otherwise(F.lit(quiet))
    return total


def kept(model: vote_em.VoteModel) -> Column:
    return ~base_failed(F.col(FEATURES)) & (log_odds(model) >= 0)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, whether the base rules fail it and the verdict."""
    seen = annotate(docs, [id_col], text_col)
    model, f = fit(seen), F.col(FEATURES)
    return seen.select(
        id_col,
        *(f[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(f).alias("base_failed"),
        (1 / (1 + F.exp(-log_odds(model)))).alias("p_good"),
        kept(model).alias("kept"),
    )


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    seen = annotate(packed(docs), [DOC], f"{DOC}.{text_col}")
    return seen.where(kept(fit(seen))).select(f"{DOC}.*")
