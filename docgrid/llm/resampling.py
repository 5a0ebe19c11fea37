"""Importance resampling of documents towards a target text distribution, by hashed n-grams.

A text's features are its runs of LEAST_N to MOST_N consecutive words, found by overlapped regex scanning:
separators are collapsed to single spaces, and a pattern with a lookaround at both boundaries is matched with
overlaps, so every run is a span of that text and its bytes go straight to the CRC; no list of words is joined.
A feature's bucket is its CRC modulo BUCKETS. The log ratio of the target's and the corpus's bucket counts is a
bucket's gain, the sum of the gains over a document's features its weight; a Gumbel draw of its own, from a hash of
its doc_id, is added, and the documents with the highest sums are drawn, without replacement.

Each text is scanned once: its buckets (narrow integers) are written, counted in a first pass over them (an array
of BUCKETS for each task, so counts of all documents are exact) and weighed in a second. BUCKETS counts for either
side come to the driver, whatever the corpus. Ranks are taken over ranges of (score, doc_id), so no task sorts all.

Nulls: a null text has no words; a null doc_id hashes like the empty text and comes after every other among equal
scores. Rows that repeat a doc_id are documents of their own, with equal draws; where scores are equal too, either may
come first. An empty target gives each feature the same chance (t = T = 0); an empty table gives an empty result.
Other columns are not looked at.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.lineage import pinned
from docgrid.llm.common import text_or_empty

LEAST_N, MOST_N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 1, 10_000, 20, 10, 2024
#: What separates words: ASCII but digits and small letters; A-Z are lowered first.
SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def pattern(n: int) -> regex.Pattern:
    """Runs of n words of a text whose words are parted by single spaces; to be matched with overlaps."""
    return regex.compile(rb"(?<![^ ])[^ ]+" + rb"(?: [^ ]+){%d}" % (n - 1) * (n > 1) + rb"(?![^ ])")


def collapsed(text: str) -> bytes:
    """The words of a text in UTF-8, A-Z lowered, parted by single spaces. bytes.lower knows ASCII only."""
    return SEPARATORS.sub(b" ", text.encode("utf-8", "surrogatepass").lower()).strip(b" ")


def feature_buckets(text: str, least: int = LEAST_N, most: int = MOST_N, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(number of words, bucket of each feature)."""
    line = collapsed(text)
    crc = zlib.crc32
    found = [np.array([crc(m[0]) for m in pattern(n).finditer(line, overlapped=True)], np.int64) for n in range(least, most + 1)]
    return (line.count(b" ") + 1 if line else 0), (np.concatenate(found) % buckets).astype(np.int32)


def _features(rows: DataFrame, least: int, most: int, buckets: int) -> DataFrame:
    """(doc_id, n_words long, buckets array<int>) of rows (doc_id, text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [feature_buckets(x or "", least, most, buckets) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *[len(b) for _, b in found]])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([b for _, b in found]) if found else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), lists], ["doc_id", "n_words", "buckets"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, buckets array<int>")


def _counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; a task sends one row a bucket, the driver gets `buckets` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["bucket", "n"])

    found = features.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, for each bucket; in doubles, as products pass 64 bits."""
    k = len(corpus)
    s, t = [float(x) for x in corpus], [float(x) for x in target]
    whole = (float(corpus.sum()) + k, float(target.sum()) + k)
    return np.array([math.floor(1000 * math.log(((b + 1) * whole[0]) / ((a + 1) * whole[1]))) for a, b in zip(s, t, strict=True)], np.int64)


def _weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    kind = features.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = np.concatenate(([0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])))
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(values[ends]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def _draw(doc_id: Column, seed: int) -> Column:
    """floor(1000 x a standard Gumbel draw), from a hash of doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(documents: DataFrame, target: DataFrame, least: int = LEAST_N, most: int = MOST_N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of documents: doc_id, n_features, weight, score, rank (1, 2, 3 in the order drawn; null: not drawn).

    target: (text) of the wanted distribution. Of the documents with at least `least_words` words, `percent` in a
    hundred (rounded down) are drawn.
    """
    features = pinned(_features(documents.select("doc_id", text_or_empty().alias("text")), least, most, buckets))
    wanted = _features(target.select(F.lit(0).alias("doc_id"), text_or_empty().alias("text")), least, most, buckets)
    gain = gains(_counts(features, buckets), _counts(wanted, buckets))
    scored = pinned(_weights(features, gain).withColumn("score", F.col("weight") + _draw(F.col("doc_id"), seed)))
    eligible = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # sorted over ranges and written; a place is the range and the row within it
    placed = pinned(scored.where(eligible).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.min("at").alias("from"), F.count("*").alias("n"))
    every = Window.orderBy("part")  # a row for each range
    before = sizes.select("part", "from", F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    drawn = placed.count() * percent // 100
    rank = F.col("at") - F.col("from") + F.col("before") + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(before), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(scored.where(~eligible).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
