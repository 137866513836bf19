"""The corpus pipeline: from raw documents to encoded training text, one operator a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe_automaton, decontaminate, exact_dedup, jaccard_join, quality
from tidewatch.llm.common import cut, table


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects, as junk or toxic, go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for blanks, one stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 on five-word shingles, the one of least id stays."""
    return jaccard_join.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with digests of ids and of the text decoded from them."""
    return bpe_automaton.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", drop_bad), ("exact dedup", drop_exact_copies), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_contaminated), ("BPE encoding", encode)]
ORACLE_SQL = None      # SQL expresses neither the classifier nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
