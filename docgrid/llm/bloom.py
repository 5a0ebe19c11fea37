"""A Bloom filter of 64-bit hashes, so that only rows that may be wanted are shuffled.

Its words are put together by an aggregate. It grows with the entries, 16 bits for each, up to MOST_WORDS (128 MB):
the bound of what comes to the driver and is broadcast. Some 0.3 % of other rows pass below that bound and more
beyond it; what passes in error is dropped by the join that follows.
"""

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, MOST_WORDS, BITS = 1 << 10, 1 << 24, 4


def words_for(n: int) -> int:
    """64-bit words for n entries: a power of two within the bounds."""
    return min(MOST_WORDS, max(LEAST_WORDS, 1 << max(0, 16 * n // 64).bit_length()))


def _places(h: Column, n_words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(h, F.lit(k)), F.lit(64 * n_words)) for k in range(BITS)]


def bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """The filter's words for hashes (h long), about n of them."""
    n_words = words_for(n)
    bits = hashes.select(F.explode(F.array(*_places(F.col("h"), n_words))).alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(n_words, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words


def may_be_in(words: np.ndarray, h: Column) -> Column:
    """Whether a hash may be in the filter; the places are computed by Spark, the bits are looked up in numpy."""
    bits = SparkContext.getOrCreate().broadcast(words)

    @F.arrow_udf("boolean")
    def looked_up(*places: pa.Array) -> pa.Array:
        at = [p.to_numpy(zero_copy_only=False) for p in places]
        return pa.array(np.logical_and.reduce([(bits.value[p >> 6] >> (p & 63)) & 1 for p in at]).astype(bool))

    return looked_up(*_places(h, len(words)))


def without(rows: DataFrame, key: Column, losers: DataFrame) -> DataFrame:
    """The rows whose key (a struct) isn't among losers (key, distinct). Only rows that may be losers are shuffled; any column names will do."""
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), key.alias("key"))
    words = bloom(losers.select(F.xxhash64("key").alias("h")), losers.count())
    marked = held.withColumn("may", may_be_in(words, F.xxhash64("key")))
    doubtful = marked.where("may").join(losers.select(F.col("key").alias("lost")), F.col("key") == F.col("lost"), "left_anti")
    return marked.where("NOT may").select("row.*").unionByName(doubtful.select("row.*"))
