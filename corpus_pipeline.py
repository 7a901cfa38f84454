"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing, SentencePiece encoding.

Every stage reads all rows that the stage before it kept, as Parquet. All but
the last return the columns of ``documents``. The operators define the results
for nulls, empty and long texts, ties, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silolake.llm import digest_dedup, jaccard_join, sentencepiece_stream, soft_mixing, toxicity
from silolake.llm.common import stored, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.5 or more go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return digest_dedup.keep_first_copies(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, similarity 0.8) the smallest doc_id stays."""
    return jaccard_join.keep_one_of_each(docs, size=5, threshold=80)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated to bring the domains to their target weights; none goes."""
    labelled = soft_mixing.labelled_domains(docs, table(spark, sf_dir, "labels"))
    return soft_mixing.repeat(docs, soft_mixing.mix(docs, labelled, soft_mixing.WEIGHTS)[0])


def _encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids."""
    return sentencepiece_stream.encode_documents(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("jaccard_join", _near_dedup),
    ("soft_mixing", _mixing),
    ("sentencepiece", _encoding),
]

#: Toxicity scores come from a fitted model, which SQL cannot express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
