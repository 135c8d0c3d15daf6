"""A corpus pipeline: toxicity, line dedup, MinHash near-dedup, mixing, packing.

Each stage takes the documents that its predecessor kept, and all but the last return documents with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaarspark.llm import scratch
from bazaarspark.llm.line_dedup import line_dedup
from bazaarspark.llm.minhash import without_near_copies
from bazaarspark.llm.mixing import mixed_documents
from bazaarspark.llm.packing import pack
from bazaarspark.llm.toxicity import without_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go. Null and empty texts are not toxic; repeated rows go or stay alike."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; every row stays, if with an empty text. Null texts stay null, repeated rows alike."""
    return line_dedup(docs).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest identifier. Rows with one identifier and different
    texts are judged each by its own text, of rows repeated whole one stays, and rows without words or identifier all do."""
    return without_near_copies(docs, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes. Documents without words weigh nothing and stay once; repeated rows are
    documents by themselves; a copy that is cut ends after a word and keeps its white space."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences. A null or empty text is one piece of one id; repeated rows are
    packed each time."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokens, labels and hashes are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. A stage's table is deleted when the next one is written, the last
    one with the session. Columns beyond those of ``documents`` pass all stages but the last. An empty table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
