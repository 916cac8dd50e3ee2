"""A corpus made ready for training: rules, near copies, benchmark leaks, personal data, packing."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fallline.llm import decontaminate, fertility, ngram_join, packing, pii
from fallline.session import new_table_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the plain counts or leave their language's fertility band go."""
    return fertility.passing(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, that with the least id."""
    return ngram_join.one_row_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; no document goes."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of every document is given a bin and a place in it."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("packing", packed),
]
#: Tokenizers and packing have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_table_path(spark, name)
        # small row groups, since a task holds one of every column of whole texts
        stage(spark, docs, sf_dir).write.option("parquet.block.size", 16 << 20).parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
