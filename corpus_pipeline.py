"""A corpus pipeline of five stages, from raw documents to token files.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
the columns of documents; the last one returns what it reads back from the token files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fluxloom.llm import decontaminate, mixing, near_copies, quality, token_files
from fluxloom.llm.common import materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).where("_keep").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of texts whose 5-word shingles are similar to 0.8: candidates
    by SimHash's keys and by min-hash bands, each checked on whole shingle sets."""
    return near_copies.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents up to its target, some more than once."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and return what they hold."""
    return token_files.write_and_read(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality classifier", quality_filter),
    ("near-dedup by SimHash and shingles", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("token files", token_output),
]

#: Perplexities, fingerprints, edit distances and token ids can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
