"""The corpus pipeline: five stages over documents, each by one operator.

toxicity drops documents that the classifier rejects; near_duplicates keeps one
document of each Jaccard component; substrings leaves shared passages in their
first document only; benchmark drops documents that hold a test item; packing
lays the rest out in sequences. All stages but the last return the columns of
documents. The last returns one row for each piece.

A stage's result is to be written before the next stage is built: building a
stage drops the tables that earlier ones packed on their way.

Defined results: a null or empty text is not toxic, links with nothing, loses
nothing and holds no item, so it stays and gives one piece with the end token
only; null ids count as larger than all others and never join rows; repeated
rows are copies of which one stays; a document whose words all stand in earlier
ones goes; an empty table gives no rows in every stage; further columns of
documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm.blocks import release
from wayfare.llm.decontaminate import decontaminate
from wayfare.llm.jaccard_join import one_of_each_component
from wayfare.llm.packing import best_fit_packing
from wayfare.llm.queries import table, vocabulary
from wayfare.llm.substring_dedup import without_repeats
from wayfare.llm.toxicity import without_toxic

#: SQL expresses none of the classifier, the token ids and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return one_of_each_component(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return without_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return best_fit_packing(docs, **vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("benchmark", benchmark),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    from wayfare.session import shared_folder

    docs = table(spark, sf_dir, "documents")
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        if last:
            _remove(spark, last)
        last = f"{where}/{name}"
    out = STAGES[-1][1](spark, docs, sf_dir)  # writes the pieces, so its input isn't read again
    _remove(spark, where)
    return out


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a stage's folder in the shared store once the next stage is written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
