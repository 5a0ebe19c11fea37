"""Token counts through a digest cache.

Counts are stored under the digest of the content and of the tokenizer (its file). Documents are joined to the
stored counts on digests; only contents that have none are encoded, one row for each distinct content, and
their counts are appended to the cache, a Parquet folder that later runs and other jobs share. Appending is
atomic (a Spark write); rows written twice by concurrent runs are equal, and one of them is read.

Texts are shuffled for one purpose: to encode a content once that several rows have. Where fewer than half of the
rows are misses, a Bloom filter of the missed rows, which grows with them up to a bound, is tested where texts are
scanned, and only misses and a few false ones are shuffled.

Nulls: a null text is normalised to the empty one; no other change is made, as the tokenizer's own normaliser
decides what counts. doc_id may be null or repeat: one row per row. Other columns are not looked at; an empty
table gives an empty result.
"""

import functools
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.functions.lineage import exists, pinned
from docgrid.llm.bloom import bloom
from docgrid.llm.bloom import may_be_in as _may_be_in
from docgrid.llm.common import text_or_empty

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Texts that are encoded in one call.
CALL = 64


@functools.cache
def _tokenizer(path: str):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def counts_of(texts: list[str], path: str) -> list[int]:
    """Tokens of each whole text, without begin, end or added special tokens."""
    model = _tokenizer(path)
    if path.endswith(".json"):
        return [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
    return [len(x) for x in model.encode(texts, num_threads=1)]


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of this tokenizer; the folder need not exist yet."""
    if not exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(documents: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """One row per row of documents: doc_id, n_bytes, n_tokens, over_limit.

    path: the tokenizer's file (.json or .model), at the same place on every machine; cache: a folder that
    driver and executors share.
    """
    spark = documents.sparkSession
    version = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    texts = documents.select("doc_id", text_or_empty().alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = pinned(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    # grouped first, so that copies are reduced before they are shuffled
    misses = pinned(rows.groupBy("digest").agg(F.min("doc_id").alias("one_id")).join(_stored(spark, cache, version), "digest", "left_anti"))
    n_misses = misses.count()
    if 2 * n_misses < rows.count():
        texts = texts.where(_may_be_in(bloom(misses.select(F.xxhash64("one_id", "digest").alias("h")), n_misses), F.xxhash64("doc_id", "digest")))
    fresh = texts.join(misses.withColumnRenamed("digest", "one"), F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("digest") == F.col("one")), "left_semi").select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CALL):
                part = batch.slice(at, CALL)
                counts = counts_of(part.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    encoded = fresh.mapInArrow(run, "digest binary, n_tokens long").dropDuplicates(["digest"])  # narrow: of rows that repeat, ids and all
    encoded.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # written, so that both sides of the join have an exchange of their own and Spark can split a hot digest's rows
    counted = rows.join(pinned(_stored(spark, cache, version)), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
