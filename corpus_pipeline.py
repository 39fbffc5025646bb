"""The corpus pipeline: five stages over documents, each written and read again before the next.

The order: quality rules, quality classifier, near-duplicates, benchmark passages, mixing. A stage gets
what its predecessor kept, decides on that alone, and hands on the columns of documents; the last adds
how often each document is to be repeated (mix_copies) and the words that makes (mix_taken). An empty
table passes through all stages; nulls are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from byteloom.llm import decontaminate, mixing, quality_classifier, quality_rules, simhash_dedup
from byteloom.llm.common import discard, materialize, scratch, table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return quality_rules.filter_documents(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the linear scorer, trained on weak labels, rates good."""
    return quality_classifier.filter_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash_dedup.filter_documents(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with mix_copies and mix_taken."""
    return mixing.apply_mix(docs)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("near duplicates", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: The fitted and iterative stages are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages before wrote on their way is deleted as soon as the next one stands."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            after = materialize(stage(spark, docs, sf_dir), f"stage{k}")
            keep.append(after)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
