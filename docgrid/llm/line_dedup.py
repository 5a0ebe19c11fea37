"""Deduplication of lines that documents share, by a distributed sort of line hashes; what comes back are bitmaps.

A line's key is the line without ASCII white space at its ends, with A-Z in small letters. Of a key of at least
LEAST_POINTS code points that several documents hold, the lines of the smallest doc_id stay and all others go.

Each line gives a row (128-bit hash of the key, document, position), which has no text. The rows are dealt out by
ranges of (hash, document, position) and sorted so within a range; a task streams over its range and knows for
each hash the document that comes first. As ranges are cut by document and position, too, a hash that a third of
all lines have is dealt out to many tasks. Where a hash goes on from an earlier range, rows of the document that is
first in this one stay open, and are decided by the ends of the ranges: two rows for each task. Lines that go are
gathered by document, and each document has a zlib-compressed bitmap of the lines that stay.

To apply bitmaps, only texts that may lose a line (a Bloom filter tells, where these are fewer than three quarters)
are shuffled, to meet their bitmaps; the others are left where they are scanned.

Nulls: a null text is one empty line. Documents are told apart by doc_id: rows that repeat one are one document
here, each with its own text and bitmap; all rows without a doc_id are one document, which comes after every other.
A key that repeats within one document alone stays. Ties can't arise, as the smallest doc_id is one document. Other
columns are kept as they are, whatever their names; an empty table gives an empty result. 128-bit hashes stand for
keys (xxh3): for 10^12 different keys the odds that any two meet are below 10^-14.
"""

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docgrid.functions.lineage import pinned
from docgrid.llm.bloom import bloom, may_be_in
from docgrid.llm.common import text_or_empty

#: Keys of fewer code points are never dropped.
LEAST_POINTS = 10
#: ASCII white space [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"
#: Lines that are hashed before their rows leave the task.
CHUNK = 1 << 16


def _key(line: bytes) -> bytes | None:
    """The key of a line, None if it is too short to count. bytes.lower knows ASCII only."""
    key = line.strip(SPACE)
    if len(key) < LEAST_POINTS or (len(key) < 4 * LEAST_POINTS and len(key.decode("utf-8", "surrogatepass")) < LEAST_POINTS):
        return None
    return key.lower()


def _row_key() -> Column:
    """Rows that repeat a doc_id are told apart by their texts."""
    return F.xxhash64(text_or_empty()).alias("row_key")


def _line_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, row_key, pos, h1, h2): a row for each line that counts and, with the number of lines as pos and no hash, one for each document row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, pos, digests = [], [], []
            for d, text in enumerate(batch.column(2).to_pylist()):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                of.append(d)
                pos.append(len(lines))
                digests.append(None)
                for k, line in enumerate(lines):
                    key = _key(line)
                    if key is not None:
                        of.append(d)
                        pos.append(k)
                        digests.append(xxhash.xxh3_128_digest(key))
                    if len(of) >= CHUNK:
                        yield _as_batch(batch, of, pos, digests)
                        of, pos, digests = [], [], []
            if of:
                yield _as_batch(batch, of, pos, digests)

    return documents.select("doc_id", _row_key(), text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, row_key long, pos int, h1 long, h2 long")


def _as_batch(batch: pa.RecordBatch, of: list[int], pos: list[int], digests: list[bytes | None]) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(x or bytes(16) for x in digests), np.int64).reshape(-1, 2)
    none = np.array([x is None for x in digests])
    rows = pa.array(of)
    columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos, pa.int32()), pa.array(halves[:, 0], mask=none), pa.array(halves[:, 1], mask=none)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "pos", "h1", "h2"])


#: What a streamed row says: a line that goes; a line of the document that is first in this range, where its hash may have begun in an earlier one; the first document of a hash at an end of the range.
GOES, OPEN, END = 0, 1, 2


def _first_occurrences(kind: pa.DataType):
    """Streams sorted (h1, h2, doc_id, row_key, pos), a batch and one document's id in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, leading, before = None, pa.scalar(None, kind), True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, row, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
            docs = batch.column(2)
            docs = docs.cast(kind) if docs.type != kind else docs
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = at != (h1[0], h2[0])
            starts = np.flatnonzero(new)
            if at is None:
                yield _said([END], pa.array([docs[0].as_py()], kind), [0], [0], h1[:1], h2[:1])
            # the first document of each row's hash: of the batch's own runs, or carried over
            pool = pa.concat_arrays([pa.array([first.as_py()], kind), docs.take(pa.array(starts))])
            firsts = pool.take(pa.array(np.cumsum(new)))
            same = _equal(docs, firsts)
            # how far the hash goes that the range begins with
            ends = starts[1:] if at is None else starts
            lead = 0 if not leading or (at is not None and new[0]) else int(ends[0]) if len(ends) else n
            # a row that repeats with its doc_id and text comes once
            again = np.zeros(n, bool)
            again[1:] = ~new[1:] & _equal(docs[1:], docs[:-1]) & (row[1:] == row[:-1]) & (pos[1:] == pos[:-1])
            again[0] = not new[0] and before == (docs[0].as_py(), row[0], pos[0])
            says = np.where(~same, GOES, np.where(np.arange(n) < lead, OPEN, -1))
            told = np.flatnonzero((says >= 0) & ~again)
            if len(told):
                yield _said(says[told], docs.take(pa.array(told)), row[told], pos[told], h1[told], h2[told])
            at, first, before = (h1[-1], h2[-1]), firsts[n - 1], (docs[n - 1].as_py(), row[-1], pos[-1])
            leading = lead == n
        if at is not None:
            yield _said([END], pa.array([first.as_py()], kind), [0], [0], np.array([at[0]]), np.array([at[1]]))

    return run


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where a and b are equal; nulls are equal to each other."""
    return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _said(says, docs: pa.Array, row, pos, h1, h2) -> pa.RecordBatch:
    columns = [pa.array(says, pa.int8()), docs, pa.array(row, pa.int64()), pa.array(pos, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["says", "doc_id", "row_key", "pos", "h1", "h2"])


def _lost_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, row_key, pos) of the lines that go."""
    kind = lines.schema["doc_id"].dataType
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").asc_nulls_last(), F.col("row_key"), F.col("pos")]
    dealt = lines.select("h1", "h2", "doc_id", "row_key", "pos").repartitionByRange(*order).sortWithinPartitions(*order)
    said = pinned(dealt.mapInArrow(_first_occurrences(to_arrow_type(kind)), f"says byte, doc_id {kind.simpleString()}, row_key long, pos int, h1 long, h2 long"))
    # two rows for each range, so the broadcast is bounded by the number of tasks
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id"))
    firsts = said.where(F.col("says") == END).groupBy("h1", "h2").agg(least.alias("first"))
    settled = said.where(F.col("says") == OPEN).join(F.broadcast(firsts), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    return said.where(F.col("says") == GOES).select("doc_id", "row_key", "pos").unionByName(settled.select("doc_id", "row_key", "pos"))


def _bitmaps(kind: pa.DataType):
    """Streams (doc_id, row_key, lost, pos) sorted so, the row with the number of lines before the lines that go: a bitmap for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n_lines, lost = None, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, rows, is_lost, pos = batch.column(0), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            done = []
            heads = np.flatnonzero(~is_lost.astype(bool))
            if now is not None:
                lost.append(pos[: heads[0] if len(heads) else None])
            for a, b in pairwise([*heads.tolist(), batch.num_rows]):
                if now is not None:
                    done.append((*now, *_packed(n_lines, lost)))
                now, n_lines, lost = (ids[a].as_py(), int(rows[a])), int(pos[a]), [pos[a + 1 : b]]
            if done:
                yield _maps(done, kind)
        if now is not None:
            yield _maps([(*now, *_packed(n_lines, lost))], kind)

    return run


def _packed(n_lines: int, lost: list[np.ndarray]) -> tuple[int, int, bytes]:
    keep = np.ones(n_lines, bool)
    keep[np.concatenate(lost)] = False
    return n_lines, n_lines - int(keep.sum()), zlib.compress(np.packbits(keep).tobytes())


def _maps(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], ["doc_id", "row_key", "n_lines", "n_dropped", "keep"])


def line_bitmaps(documents: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_lines, n_dropped, keep): one row per document row (rows that repeat with doc_id and text: one).

    row_key is Spark's xxhash64 of the text (null: empty). keep is zlib-compressed; bit i of the bytes within, the
    highest of each byte first, is 1 if line i stays.
    """
    kind = documents.schema["doc_id"].dataType
    rows = pinned(_line_rows(documents))
    lost = _lost_lines(rows.where("h1 IS NOT NULL"))
    counts = rows.where("h1 IS NULL").select("doc_id", "row_key", "pos").distinct()
    told = counts.select("doc_id", "row_key", F.lit(False).alias("lost"), "pos").unionByName(lost.select("doc_id", "row_key", F.lit(True).alias("lost"), "pos"))
    sorted_ = told.repartition("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key", "lost", "pos")
    return pinned(sorted_.mapInArrow(_bitmaps(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, row_key long, n_lines long, n_dropped long, keep binary"))


def kept_lines(text: Column, keep: Column) -> Column:
    """The lines of the text whose bit is set, joined by newlines; no bitmap: the text itself."""

    @F.arrow_udf("string")
    def kept(texts: pa.Array, keeps: pa.Array) -> pa.Array:
        return pa.array([x if bits is None else _kept(x, bits) for x, bits in zip(texts.to_pylist(), keeps.to_pylist(), strict=True)], pa.string())

    return kept(text, keep)


def _kept(text: str, keep: bytes) -> str:
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([line for line, bit in zip(lines, bits.tolist(), strict=True) if bit])


def drop_lines(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, kept, n_lines, n_dropped): each row of documents as a struct, the text that stays, and its counts."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    texts = documents.select(row, F.col("doc_id").alias("id"), _row_key(), text_or_empty().alias("text"))
    losers = bitmaps.where("n_dropped > 0")
    n_all, n_lost = bitmaps.count(), losers.count()
    key = F.xxhash64("id", "row_key")
    rest = None
    if 4 * n_lost < 3 * n_all:
        may = may_be_in(bloom(losers.select(F.xxhash64("doc_id", "row_key").alias("h")), n_lost), key)
        marked = texts.withColumn("may", may)
        rest, texts = marked.where(~F.col("may")), marked.where("may")
    found = losers.select(F.col("doc_id").alias("of_id"), F.col("row_key").alias("of_key"), "n_dropped", "keep")
    met = texts.join(found, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("row_key") == F.col("of_key")), "left")
    out = met.select("row", kept_lines(F.col("text"), F.col("keep")).alias("kept"), _n_lines(), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"))
    if rest is not None:
        out = out.unionByName(rest.select("row", F.col("text").alias("kept"), _n_lines(), F.lit(0).cast("long").alias("n_dropped")))
    return out


def _n_lines() -> Column:
    return (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The rows of documents, all columns, with the lines that stay as their texts (null: empty)."""
    kept = drop_lines(documents, line_bitmaps(documents))
    return kept.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])
