"""The corpus pipeline: five operators in a row, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and gives
back the same columns, but for the last, which gives packed pieces with their ids. A
stage's result is written as Parquet in the shared folder and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import lines, mixing, neardup, packing, quality
from skein.llm.common import write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7 go. Null and empty texts are scored as such."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the last of them only; every document stays."""
    return lines.drop_lines(docs, COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id stays of each near-duplicate class."""
    return neardup.keep_one(docs, COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it, cut where its source's budget ends."""
    return mixing.repeat_taken(docs, COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of token ids, none across documents."""
    return packing.pack(docs, packing.default_tokenizer(), with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("near-duplicates", one_of_each),
    ("source mix", mixed),
    ("packing", packed),
]

#: The classifier, the signatures and the tokenizer can't be said in SQL; the tests hold
#: the pipeline against its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
