"""Helpers shared by the operators of this subpackage."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels no model may learn from; a null doc_id counts as the empty text, whose CRC is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learning_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row per document that may be learnt from. Rows whose label or doc_id is null are not
    used; of several labels of one document the largest counts."""
    return (
        labels.select("doc_id", F.col(label).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    )


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label, h): at most `most` labelled documents that aren't held out, the same ones on every run.

    Those with the smallest hashes of doc_id come first, half of the bound for each label, so the sample doesn't
    depend on the layout; its size is bounded by the parameter, not by the data. Of rows that repeat a doc_id the
    least text counts.
    """
    wanted = learning_labels(labels, label).withColumn("h", F.xxhash64("doc_id"))
    parts = [wanted.where(F.col("label") == y).orderBy("h", "doc_id").limit(most // 2) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = documents.select("doc_id", text_or_empty().alias("text"))
    # at most `most` narrow rows, so the broadcast is bounded
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "h").agg(F.min("text").alias("text")).select("doc_id", "text", "label", "h")


def label_rate(labels: DataFrame, label: str) -> float | None:
    """The share of label 1 among the documents that may be learnt from; None if there are none."""
    return learning_labels(labels, label).agg(F.avg("label")).first()[0]
