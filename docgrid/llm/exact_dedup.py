"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Misra-Gries counters (Spark's mergeable frequent-items sketch) name the digests that may be frequent. Their
groups are counted exactly and their winners broadcast, so rows of frequent digests are decided where they are
scanned; only the other digests, each with a small share of the rows, are shuffled.

Nulls: a null text counts as empty, a null doc_id comes after every other. Empty texts are equal to each other
and to texts of white space. Ties: of rows with as many code points, the smallest doc_id stays. Rows that repeat
one doc_id with texts of one length are the same document to `exact_dedup`, which returns each of them, kept where
it is the document that stays; of texts of several lengths only those of the largest are. `drop_copies` leaves one row. Other columns are not looked at, whatever their names; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.lineage import pinned
from docgrid.llm.common import text_or_empty

#: The ASCII white space [\x20\x09-\x0D], which doesn't count.
SPACE = " \t\n\x0b\x0c\r"
#: Counters of the sketch; a digest with over 4/COUNTERS of the rows is never missed.
COUNTERS = 4096
#: At most so many digests are treated as frequent: the bound of the broadcast (about 150 bytes each).
MOST_HOT = 1000
#: First level of the sketches' merge, so that no task merges a sketch from every task.
SHARDS = 64


def digest(text: Column) -> Column:
    return F.sha2(F.translate(text, SPACE, "").cast("binary"), 256)


def _rank() -> list[Column]:
    """Within equal texts, in the order of preference."""
    return [F.col("n_points").desc(), F.col("doc_id").asc_nulls_last()]


def frequent_digests(digests: DataFrame, least: int = 32) -> DataFrame:
    """(digest, hot_id, hot_size, hot_points) of verified frequent digests, at most MOST_HOT rows.

    digests: (doc_id, digest, n_points). The sketch only proposes; sizes and winners are counted over all rows,
    and groups of fewer than `least` rows are left to the shuffle.
    """
    sketches = (
        digests.select("digest", (F.spark_partition_id() % SHARDS).alias("shard")).groupBy("shard")
        .agg(F.expr(f"approx_top_k_accumulate(digest, {COUNTERS})").alias("sketch"))
    )
    # grouped, if only by a constant: an empty partition then sends no sketch, which the merge couldn't read
    merged = sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {COUNTERS})").alias("sketch"))
    proposed = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {MOST_HOT})")).alias("top")).select(F.col("top.item").alias("digest"))
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id"))
    return (
        digests.join(F.broadcast(proposed), "digest").groupBy("digest")
        .agg(F.count("*").alias("hot_size"), best.alias("best")).where(F.col("hot_size") >= least)
        .select("digest", "hot_size", F.col("best.doc_id").alias("hot_id"), (-F.col("best.p")).alias("hot_points"))
    )


def exact_dedup(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256."""
    text = text_or_empty()
    rows = pinned(documents.select("doc_id", digest(text).alias("digest"), F.char_length(text).alias("n_points")))
    hot = pinned(frequent_digests(rows))
    settled = rows.join(F.broadcast(hot), "digest").select("doc_id", "n_points", F.col("hot_id").alias("keep_id"), F.col("hot_points").alias("keep_points"), F.col("hot_size").alias("group_size"), "digest")
    cold = rows.join(F.broadcast(hot), "digest", "left_anti")
    group = Window.partitionBy("digest")
    first = group.orderBy(*_rank()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    others = cold.select("doc_id", "n_points", F.first("doc_id").over(first).alias("keep_id"), F.first("n_points").over(first).alias("keep_points"), F.count("*").over(group).alias("group_size"), "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return settled.unionByName(others).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(documents: DataFrame) -> DataFrame:
    """The rows of documents, all columns, without copies: exactly one row of each group of equal texts."""
    names = documents.columns
    text = text_or_empty()
    facts = {"_digest": digest(text), "_points": F.char_length(text)}
    narrow = pinned(documents.select("doc_id", facts["_digest"].alias("digest"), facts["_points"].alias("n_points")))
    hot = pinned(frequent_digests(narrow))
    # the columns travel in one struct, so that no name of theirs can clash
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), facts["_digest"].alias("digest"), facts["_points"].alias("n_points"), "doc_id")
    rows = rows.join(F.broadcast(hot), "digest", "left").where(
        F.col("hot_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("n_points") == F.col("hot_points")))
    )
    one = rows.select("row", F.row_number().over(Window.partitionBy("digest").orderBy(*_rank())).alias("nth")).where("nth = 1")
    return one.select("row.*")
