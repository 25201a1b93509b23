"""Training-data pipeline: five stages over ``documents``, each a call of one operator.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; what it returns is
written and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorkit.llm import decontamination, quality_rules, simhash, weak_quality
from anchorkit.llm.queries import piece_digests, table
from anchorkit.llm.rows import fresh
from anchorkit.session import staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer taught by weak labels keeps."""
    scorers, _ = weak_quality.learn(docs, table(spark, sf_dir, "labels"))
    to = fresh(docs, "quality_scores")
    return weak_quality.score(docs, scorers, to=to).where(F.col(f"{to}.kept")).drop(to)


def quality_rule_cutoffs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled cutoffs of their language."""
    prefix = "rule_"
    counted = staged(quality_rules.text_counts(docs, prefix=prefix), "pipeline-counts")
    cutoffs = quality_rules.learn_cutoffs(counted, table(spark, sf_dir, "labels"), prefix=prefix)
    out = quality_rules.apply_cutoffs(counted, cutoffs, prefix=prefix)
    return out.where(F.col(f"{prefix}kept")).select(*docs.columns)


def simhash_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at three or fewer differing bits: the one with the smallest id."""
    return simhash.near_duplicates(docs).where("is_first").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the pieces of what is left."""
    return piece_digests(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_cutoffs),
    ("SimHash near-dedup", simhash_near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", piece_encoding),
]

#: Fingerprints, the trained scorer and the pieces can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
