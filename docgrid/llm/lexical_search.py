"""Ranked lexical search: the best documents for each item of a query set, by a hybrid of term- and document-at-a-time.

Terms are maximal runs of ASCII letters, digits and all beyond ASCII, A-Z in small letters. A term that df of N
documents hold weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document of n of the L terms has the length norm
m = 100 - LENGTH + (LENGTH n N) div L, and scores w * ((10^9 tf) div (1000 tf + 8 m)) for each of the item's terms.

First pass, a map: a document's length and how often it holds each term of the query set, written as narrow rows;
N, L and df are sums over them. Second pass: a task turns the rows that it reads into inverted lists, POSTINGS at
a time, documents in ascending order. For an item, the shortest lists, up to a share of the block's documents, are
summed term at a time into accumulators (document, sum); these, sorted by document, are from then on one more
iterator with one bound, beside the long lists. All iterators are then gone through document at a time, in windows
of WINDOW documents: a window whose lists' largest scores don't add up to the item's tenth best score so far is
skipped whole; in others, the iterators whose bounds together can't reach it propose no documents, and are only
looked up for documents that may still get there. Tenth best scores carry over to the task's next block.

Each task returns at most `most` documents an item; these meet in two levels, so no task gets what all tasks have
found. Nothing is capped: all skips are by bounds that hold. The query set goes to the tasks in blocks of at most
BLOCK_TERMS terms, one pass over the documents for each; the driver holds two blocks at most.

Nulls: a null text has no terms, and a document without terms doesn't count and is never found; an item without
terms finds nothing. Rows that repeat an item_id (null ones included) are one item with the terms of all. Rows that
repeat a doc_id are documents of their own; a null doc_id comes after every other among equal scores. Other columns
are not looked at; empty tables give an empty result.
"""

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docgrid.functions.lineage import pinned
from docgrid.llm.common import text_or_empty

MOST, LENGTH = 10, 90
#: Maximal matches are terms. The same bytes in UTF-8: all beyond ASCII counts.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Terms of the items of a block of the query set, repeats included.
BLOCK_TERMS = 1 << 20
#: Postings that a task holds at a time, and documents of a window.
POSTINGS, WINDOW = 1 << 21, 4096
#: Short lists: as many of the shortest as together have at most one posting for so many documents.
SHARE = 4
#: Shards of the first level of the final merge.
SHARDS = 64


def terms(text: str) -> list[bytes]:
    """bytes.lower knows ASCII only."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each item that has any."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, t) for d, x in enumerate(batch.column(1).to_pylist()) for t in dict.fromkeys(terms(x or ""))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([d for d, _ in found], pa.int64())), pa.array([t for _, t in found], pa.binary())], ["item_id", "term"])

    rows = items.select("item_id", text_or_empty().alias("text")).mapInArrow(run, f"item_id {kind}, term binary")
    return rows.groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items in blocks of at most BLOCK_TERMS terms, or of one item."""
    table = pinned(item_terms(items))
    total = table.agg(F.sum(F.size("terms"))).first()[0] or 0
    block, size = [], 0
    for row in table.repartition(1 + total // BLOCK_TERMS).toLocalIterator():
        if block and size + len(row.terms) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row.item_id, [bytes(t) for t in row.terms]))
        size += len(row.terms)
    if block:
        yield block


def _forward(documents: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n long, ids array<int>, tfs array<long>) of documents with terms: of the numbered terms, those that it holds."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(number)  # at most BLOCK_TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            lengths, ids, tfs, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                words = terms(text)
                lengths.append(len(words))
                held = Counter(filter(known.__contains__, words))
                ids.extend(map(known.__getitem__, held))
                tfs.extend(held.values())
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((ids, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    rows = documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n long, ids array<int>, tfs array<long>")
    return rows.where("n > 0")


def _frequencies(forward: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each numbered term is; a task sends one row a term, the driver gets n_terms of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["id", "df"])

    found = forward.select("ids").mapInArrow(run, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[found.column("id").to_numpy()] = found.column("df").to_numpy()
    return out


def term_weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    if len(n) and int(n.max()) * LENGTH * n_documents >= 1 << 63:  # the product passes 64 bits, the quotient doesn't
        return np.array([100 - LENGTH + LENGTH * int(x) * n_documents // n_terms for x in n], np.int64)
    return 100 - LENGTH + (LENGTH * n_documents * n) // n_terms


class Lists:
    """Inverted lists of a block of documents that stand in ascending order: for each term, places and scores."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, scores: np.ndarray, n_documents: int, n_terms: int):
        order = np.argsort(ids, kind="stable")  # places stay in order within a term
        ids, self.places, self.scores = ids[order], places[order], scores[order]
        self.n_documents, self.n_windows = n_documents, -(-n_documents // WINDOW)
        self.starts = np.searchsorted(ids, np.arange(n_terms + 1))
        self.long: dict[int, Postings] = {}  # those that items have asked for; no more in all than the block's postings

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.places[a:b], self.scores[a:b]

    def iterators(self, term_ids: np.ndarray) -> list["Postings"]:
        """The item's long lists, and the sum of its short ones as one more."""
        sizes = self.starts[term_ids + 1] - self.starts[term_ids]
        order = np.argsort(sizes, kind="stable")
        short = np.cumsum(sizes[order]) <= self.n_documents // SHARE
        long_lists = [self.long.get(t) or self.long.setdefault(t, Postings(*self.postings(t), self.n_windows)) for t in term_ids[order[~short]].tolist()]
        parts = [self.postings(t) for t in term_ids[order[short]].tolist()]
        if sum(len(p) for p, _ in parts):
            places, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            sums = np.zeros(len(places), np.int64)
            np.add.at(sums, back, np.concatenate([s for _, s in parts]))
            long_lists.append(Postings(places, sums, self.n_windows))
        return long_lists


class Postings:
    """One iterator: places in ascending order with scores, where each window begins, and each window's largest score."""

    def __init__(self, places: np.ndarray, scores: np.ndarray, n_windows: int):
        self.places, self.scores = places, scores
        self.starts = np.searchsorted(places, np.arange(n_windows + 1) * WINDOW)
        self.bounds = np.zeros(n_windows, np.int64)
        there = np.flatnonzero(np.diff(self.starts))
        if len(there):
            self.bounds[there] = np.maximum.reduceat(scores, self.starts[there])

    def window(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[k], self.starts[k + 1]
        return self.places[a:b], self.scores[a:b]


def best(iterators: list[Postings], n_windows: int, most: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the `most` best documents with a score of at least `least` and above 0, earlier places first among equals.

    `least` is a score that others have reached already; a document that only equals it may still come first by its id.
    """
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not iterators:
        return places, scores
    bounds = np.stack([x.bounds for x in iterators])
    needed = max(least, 1)  # a document below it is out
    for k in np.flatnonzero(bounds.sum(axis=0) >= needed).tolist():
        here = bounds[:, k]
        if here.sum() < needed:  # it has risen meanwhile
            continue
        order = np.argsort(here, kind="stable")
        reach = np.cumsum(here[order])
        n_lookups = int(np.searchsorted(reach, needed))  # iterators that can't reach it by themselves
        sums = np.zeros(WINDOW, np.int64)
        for i in order[n_lookups:].tolist():
            at, more = iterators[i].window(k)
            sums[at - k * WINDOW] += more
        found = np.flatnonzero(sums)
        for j in range(n_lookups - 1, -1, -1):  # the largest bounds first; what can't get there any more is left
            found = found[sums[found] + reach[j] >= needed]
            at, more = iterators[order[j]].window(k)
            if not len(found) or not len(at):
                continue
            where = np.minimum(np.searchsorted(at, found + k * WINDOW), len(at) - 1)
            hit = at[where] == found + k * WINDOW
            sums[found[hit]] += more[where[hit]]
        found = found[sums[found] >= needed]
        if len(found):
            places = np.concatenate((places, found + k * WINDOW))
            scores = np.concatenate((scores, sums[found]))
            if len(scores) > most:
                keep = np.lexsort((places, -scores))[:most]
                places, scores = places[keep], scores[keep]
            if len(scores) == most:
                needed = max(needed, int(scores.min()) + 1)  # later places lose among equals
    keep = np.lexsort((places, -scores))
    return places[keep], scores[keep]


def _searched(items: list[np.ndarray], weights: np.ndarray, n_documents: int, n_terms: int, most: int):
    """Streams forward rows; returns (item number, doc_id, score): the task's best documents for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple]] = [[] for _ in items]  # (-score, no id, id), at most `most`, in order
        held, size, schema = [], 0, None
        for batch in batches:
            schema = batch.schema
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= POSTINGS:
                _search(held, found)
                held, size = [], 0
        if held:
            _search(held, found)
        if schema is not None:
            rows = [(k, x) for k, best_of in enumerate(found) for x in best_of]
            columns = [pa.array([k for k, _ in rows], pa.int32()), pa.array([x[3] for _, x in rows], schema.field(0).type), pa.array([-x[0] for _, x in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    def _search(held: list[pa.RecordBatch], found: list[list[tuple]]) -> None:
        block = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")]).combine_chunks()  # nulls last
        docs, n, ids, tfs = (block.column(k).combine_chunks() for k in range(4))
        places = np.repeat(np.arange(len(docs)), np.diff(ids.offsets.to_numpy()))
        ids, tfs = ids.flatten().to_numpy(), tfs.flatten().to_numpy()
        norm = length_norm(n.to_numpy(), n_documents, n_terms)[places]
        lists = Lists(ids, places, weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * norm)), len(docs), len(weights))
        for k, term_ids in enumerate(items):
            so_far = found[k]
            where, scores = best(lists.iterators(term_ids), lists.n_windows, most, -so_far[-1][0] if len(so_far) == most else 0)
            if len(where):
                names = docs.take(pa.array(where)).to_pylist()
                more = [(-s, d is None, 0 if d is None else d, d) for s, d in zip(scores.tolist(), names, strict=True)]
                found[k] = sorted([*so_far, *more], key=lambda x: x[:3])[:most]

    return run


def search(documents: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) its `most` best documents (doc_id, text), best first."""
    parts = [_search_block(documents, items, block, most) for block in _blocks(items)]
    if not parts:  # no item has a term
        kinds = [t.schema[c].dataType.simpleString() for t, c in ((items, "item_id"), (documents, "doc_id"))]
        return documents.sparkSession.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    return functools.reduce(DataFrame.unionByName, parts)


def _search_block(documents: DataFrame, items: DataFrame, block: list[tuple[object, list[bytes]]], most: int) -> DataFrame:
    number = {t: k for k, t in enumerate(dict.fromkeys(t for _, ts in block for t in ts))}
    forward = pinned(_forward(documents, number))
    df = _frequencies(forward, len(number))
    n_documents, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([term_weight(n_documents, int(x)) for x in df], np.int64)
    term_ids = [np.array(sorted(number[t] for t in ts), np.int64) for _, ts in block]
    kind, item_kind = documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    with_terms = forward.where(F.size("ids") > 0)
    found = pinned(with_terms.mapInArrow(_searched(term_ids, weights, n_documents, n_terms, most), f"item int, doc_id {kind}, score long").withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(SHARDS))))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "shard").orderBy(*order))).where(F.col("rank") <= most)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)
    names = pa.array([i for i, _ in block], to_arrow_type(item_kind))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([names.take(batch.column(0)), *batch.columns[1:]], ["item_id", "rank", "doc_id", "score"])

    return last.select("item", "rank", "doc_id", "score").mapInArrow(named, f"item_id {item_kind.simpleString()}, rank int, doc_id {kind}, score long")
