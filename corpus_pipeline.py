"""A training corpus from raw documents: five stages, each an operator of ``plumbline.llm``.

Every stage takes (spark, docs, sf_dir), works on what the one before kept, and
returns a table that is written and read again before the next. All but the last
return the columns of documents; the last adds what the mix takes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.decontaminate import drop_leaks
from plumbline.llm.line_runs import dedup_lines
from plumbline.llm.mixing import take_mix
from plumbline.llm.quality import keep_good, train
from plumbline.llm.similar import similar_documents
from plumbline.llm.simhash import keep_one
from plumbline.llm.tables import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from the labels in ``sf_dir``."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay in the first document that holds them; ``n_chars`` follows the text."""
    kept = dedup_lines(docs).select("row.*")
    if "n_chars" not in kept.columns:
        return kept
    counted = F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.withColumn("n_chars", counted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id.

    Groups by SimHash fingerprints first; among what stays, groups by exact Jaccard
    similarity of 0.8 on five-word shingles, most of which lie beyond the fingerprints' radius.
    """
    unlike = stash(keep_one(docs), "unlike")
    return keep_one(unlike, find=similar_documents)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark in ``sf_dir`` is found."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with the words taken of each."""
    return take_mix(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("leaks", leaks),
    ("mix", mix),
]

# The classifier and the latent space are not SQL; tests hold run() against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
