"""The corpus pipeline: quality, lines, near copies, benchmark items, tokens. Each stage works on all the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import contamination, jaccard, lines, quality, shared, tokenise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resample keeps."""
    return quality.keep_good(spark, docs, sf_dir)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line of each component left in the corpus; those that lose every line go."""
    return lines.drop_lines(spark, docs, sf_dir)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard.one_of_each(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.drop_contaminated(spark, docs, sf_dir)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text, and whether decoding gives the text back."""
    return tokenise.encode(docs.select("doc_id", "text")).select("doc_id", "ids", F.col("n_tokens").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("jaccard join", jaccard_join),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The stages learn models, hash and tokenise, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is stored in the shared folder and read as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
