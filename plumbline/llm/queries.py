"""The dealt operators as queries over the test tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.conversation_repair import OP13_SQL, op13_conversation_repair
from plumbline.llm.decontaminate import op4_decontaminate
from plumbline.llm.license_scan import op8_license_scan
from plumbline.llm.line_runs import OP2_SQL, op2_line_dedup
from plumbline.llm.merkle import OP12_SQL, op12_merkle_manifest
from plumbline.llm.mixing import op9_source_mix
from plumbline.llm.neighbours import op10_nearest
from plumbline.llm.quality import op3_quality
from plumbline.llm.recompression import dedup_passages
from plumbline.llm.set_join import op11_shingle_join
from plumbline.llm.simhash import op6_simhash
from plumbline.llm.suffix_dedup import dedup_substrings
from plumbline.llm.url_reputation import OP7_SQL, op7_url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")




def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = dedup_substrings(docs, with_text=False)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256"
    )


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = dedup_passages(docs, with_text=False)
    return found.select(F.col("id").alias("doc_id"), F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_passage_dedup": op5_passage_dedup,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_license_scan": op8_license_scan,
    "op9_source_mix": op9_source_mix,
    "op10_nearest": op10_nearest,
    "op11_shingle_join": op11_shingle_join,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op7_url_filter": OP7_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
