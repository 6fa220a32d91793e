"""A training corpus from the table documents, stage by stage; each stage is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trawl.llm.byte_bpe import bpe_digest, public_ranks
from trawl.llm.decontaminate import contamination
from trawl.llm.near_dedup import one_of_each
from trawl.llm.quality_rules import quality_rules
from trawl.llm.secrets import redacted
from trawl.llm.shared import carried, materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows, plain = carried(docs, "text", "lang", "source")
    return quality_rules(rows, plain).where("kept").select(*plain).toDF(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of least doc_id."""
    return one_of_each(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, plain = carried(docs, "text")
    return contamination(rows, table(spark, sf_dir, "benchmark"), tuple(plain)).where("not contaminated").select(*plain).toDF(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return redacted(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, ids."""
    return bpe_digest(docs, *public_ranks(), with_ids=True)


STAGES = [("quality_rules", keep_good), ("near_dedup", keep_one_of_each), ("decontaminate", keep_clean), ("secret_scan", hide_secrets), ("byte_bpe", to_tokens)]

#: SQL has no minimum covariance determinants, ProbMinHash, string tiling or merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
