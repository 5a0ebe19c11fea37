"""SimHash near-duplicate detection by a grid over segment popcounts.

A 64-bit fingerprint is mapped to the bit counts of its 32 segments of two bits. Counts of two fingerprints
differ, summed over the segments (their Manhattan distance), by no more than the fingerprints' bits do. So of
two fingerprints at 3 bits or fewer, the counts of one half (16 segments) are at Manhattan distance 1 or 0. The
counts of a half are a cell of a grid; each fingerprint stands in its own cell of either half and in the cells
one step up along each axis, so the range join of radius 1 becomes an equi-join on cells. Within a cell, the
Manhattan bound over all 32 segments goes first and the exact distance last. A cell yields a forest of links
(each member to the least of its class in the cell), not its pairs.

Nulls: a null text counts as empty; a null doc_id comes after every other and may be a component_id only where
a whole component has no other. Empty texts have fingerprint zero and are linked like any other. Repeated rows
are kept. Other columns are not looked at; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions.lineage import pinned
from docgrid.llm.common import text_or_empty
from docgrid.llm.components import connected_components

MOST_BITS = 3
WORDS = 3
SEED = 42
#: Cells with more members are dealt out in tiles: pairs of parts of about this size.
TILE = 4096
#: Shingles of one text that are hashed at a time.
CHUNK = 1 << 18
EVEN = 0x5555555555555555


def fingerprint(text: str) -> int:
    """The signed 64-bit fingerprint of a text; memory is bounded by the text and CHUNK."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= WORDS:
        starts, ends = starts[: len(words) - WORDS + 1], ends[WORDS - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">i8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x or "") for x in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _counts(half: Column) -> Column:
    """The 16 segments' counts of 32 bits, two bits each."""
    even = F.lit(EVEN >> 32)
    return half.bitwiseAND(even) + F.shiftrightunsigned(half, 1).bitwiseAND(even)


def _as_rows(fps: DataFrame) -> DataFrame:
    """(cell, fp, home): every fingerprint in its own cell of either half and, with home false, one step up each axis."""
    parts = []
    for half in (0, 1):
        own = fps.select("fp", _counts(F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))).alias("own"))
        ups = [F.when(F.col("own").bitwiseAND(F.lit(2 << 2 * i)) == 0, F.col("own") + (1 << 2 * i)) for i in range(16)]
        spread = own.select("fp", F.posexplode(F.array("own", *ups)).alias("nth", "cell")).where("cell IS NOT NULL")
        parts.append(spread.select(F.xxhash64(F.lit(half), "cell").alias("cell"), "fp", (F.col("nth") == 0).alias("home")))
    return parts[0].unionByName(parts[1])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a x b are within MOST_BITS: the Manhattan distance of counts first, then the fingerprints' bits."""
    even = np.uint64(EVEN)
    counts = [(x & even) + ((x >> np.uint64(1)) & even) for x in (a, b)]
    high, low = np.uint64(0xAAAAAAAAAAAAAAAA), even
    # counts of 0, 1, 2 in unary (00, 01, 11): Manhattan distance is then the number of differing bits
    unary = [((c & low) | ((c & high) >> np.uint64(1)) | (c & high)) for c in counts]
    lower = np.bitwise_count(unary[0][:, None] ^ unary[1][None, :]) <= MOST_BITS
    i, j = np.nonzero(lower)
    exact = np.bitwise_count(a[i] ^ b[j]) <= MOST_BITS
    return np.stack([i[exact], j[exact]])


def _cell_links(fps: np.ndarray, homes: np.ndarray) -> list[tuple[int, int]]:
    """A forest over the members of one cell; at least one end of each tested pair is at home there."""
    root = np.arange(len(fps))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    own = np.flatnonzero(homes)
    links, step = [], 512
    for at in range(0, len(own), step):
        for to in range(0, len(fps), 1 << 14):
            i, j = _near(fps[own[at : at + step]], fps[to : to + (1 << 14)])
            for x, y in zip(own[at + i].tolist(), (to + j).tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    links.append((int(fps[x].view(np.int64)), int(fps[y].view(np.int64))))
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (cell, fp, home) sorted by cell: the links of each cell. Holds one cell and one batch at a time."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        part = part if rest is None else [np.concatenate(x) for x in zip(rest, part, strict=True)]
        cut = int(np.searchsorted(part[0], part[0][-1]))  # the last cell may go on
        yield _found([x[:cut] for x in part])
        rest = [x[cut:] for x in part]
    if rest is not None:
        yield _found(rest)


def _found(part: list[np.ndarray]) -> pa.RecordBatch:
    cells, fps, homes = part[0], part[1].view(np.uint64), part[2].astype(bool)
    edges = np.flatnonzero(np.diff(cells)) + 1
    starts, ends = np.concatenate(([0], edges)).astype(int), np.concatenate((edges, [len(cells)])).astype(int)
    several = np.flatnonzero(ends - starts > 1)
    out = [pair for k in several.tolist() if homes[starts[k] : ends[k]].any() for pair in _cell_links(fps[starts[k] : ends[k]], homes[starts[k] : ends[k]])]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints fps (fp) whose components are those of all pairs within MOST_BITS."""
    rows = pinned(_as_rows(fps))
    # cells of over TILE members, if any, are dealt out in tiles: every pair of parts meets in one of them
    large = rows.groupBy("cell").count().where(F.col("count") > TILE).select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiled = rows.join(large, "cell").select("cell", "fp", "home", part.alias("p"), other.alias("q"))
    tiled = tiled.select(F.xxhash64("cell", F.least("p", "q"), F.greatest("p", "q")).alias("cell"), "fp", "home")
    dealt = rows.join(large, "cell", "left_anti").unionByName(tiled)
    return dealt.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_links, "a long, b long").distinct()


def simhash_groups(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, fp long, component_id (the smallest doc_id reachable, its own included)."""
    rows = pinned(fingerprints(documents))
    least = pinned(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(near_links(least.select("fp")))
    joined = least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = pinned(joined.groupBy("root").agg(F.min("first_id").alias("component_id")))
    # written, so that both sides of the last join have an exchange of their own and Spark can split a hot fingerprint
    named = pinned(joined.join(ids, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
