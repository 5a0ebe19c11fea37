"""A corpus in five stages: quality, exact copies, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next. All but the last return the columns of documents. Each works on all that its predecessor kept
and decides by one of the operators of docgrid.llm; clean documents stay. A doc_id names a document: of rows that
repeat one with equal texts, one stays.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.functions.lineage import pinned, remove, scratch
from docgrid.llm import bloom, decontam, exact_dedup, packing, quality, simhash
from docgrid.llm.common import table, text_or_empty


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled rows of the whole table documents."""
    net = quality.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, net)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside), the row with the most code points, then the smallest doc_id, stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, the row with the smallest doc_id (nulls last), then the smallest text hash, stays.

    Rows are told apart by doc_id and text, as doc_id may be null or repeat; equal texts are left to the exact stage.
    """
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64(text_or_empty()).alias("text_hash"))
    groups = simhash.simhash_groups(docs.select(row.alias("doc_id"), "text"))
    losers = groups.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    return bloom.without(docs, row, pinned(losers))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark, but for few edits, go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [("quality", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("decontamination", leak_stage), ("packing", packing_stage)]

#: No SQL: the classifier, the fingerprints' components, the edit search and the packing have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder before the next; what a stage has read then goes."""
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = pinned(stage(spark, docs, sf_dir), f"{root}/{k}")
        if k:
            remove(spark, f"{root}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
