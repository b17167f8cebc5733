"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.blocks import finished
from wayfare.llm.conversation_repair import conversation_repair
from wayfare.llm.decontaminate import contamination
from wayfare.llm.fingerprints import neighbours
from wayfare.llm.hard_negatives import ORACLE as HARD_NEGATIVES
from wayfare.llm.hard_negatives import hard_negatives
from wayfare.llm.html_extract import html_extract
from wayfare.llm.jaccard_join import jaccard_components
from wayfare.llm.line_dedup import ORACLE as LINE_DEDUP
from wayfare.llm.line_dedup import line_dedup_digest
from wayfare.llm.packing import best_fit_packing
from wayfare.llm.sharding import balanced_shards
from wayfare.llm.substring_dedup import substring_dedup
from wayfare.llm.suffix_array import suffix_array_dedup
from wayfare.llm.toxicity import toxicity
from wayfare.llm.url_filter import url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> dict[str, str]:
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: substring_dedup(table(spark, sf_dir, "documents"), length=13))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: jaccard_components(table(spark, sf_dir, "documents"), width=5, num=80, den=100))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), **vocabulary(), capacity=1024, end_id=2)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"), shards=8)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"), width=5, permutations=128)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train_rows=20_000)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: suffix_array_dedup(table(spark, sf_dir, "documents"), length=50))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", own), every=50, positives=5, negatives=3, low=50, high=95, scale=256)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_sharding": op4_sharding,
    "op5_minhash": op5_minhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_array": op8_suffix_array,
    "op9_url_filter": op9_url_filter,
    "op10_html_extract": op10_html_extract,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Queries whose result SQL can express at the size of the SQL check.
ORACLE_SQL: dict[str, str] = {"op11_line_dedup": LINE_DEDUP, "op12_hard_negatives": HARD_NEGATIVES}
