"""The corpus pipeline: five stages over ``documents``.

Each stage takes what its predecessor kept, written as Parquet and reread, and all
but the last return the columns of ``documents``.

Cases: null and empty texts are documents like any other (of no words, one token);
null and repeated ids are kept by every stage but the join, which keeps of each group
the rows of its least id and all rows without an id; of equal texts the row of the
largest id stays; an empty table passes through every stage; extra columns, whatever
their names, are carried to the packing, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import small_batches, table, written
from quillspark.llm.op1_exact_dedup import without_copies
from quillspark.llm.op4_packing import pack_documents
from quillspark.llm.op5_mixing import mixed
from quillspark.llm.op6_jaccard_join import one_of_each_group
from quillspark.llm.op10_quality import good_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(docs, table(small_batches(spark), sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    small_batches(spark)
    return without_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    small_batches(spark)
    return one_of_each_group(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    small_batches(spark)
    return mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed: a document taken twice is packed twice."""
    small_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the packing cannot be expressed in SQL; tests compare the stages
#: with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
