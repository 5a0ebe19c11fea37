"""Passages that documents share, by a sparse suffix array.

Words are runs of characters other than ASCII white space, case and all. Of all suffixes of a document those are
retained that begin with a minimiser: the least hash of KEY words among WINDOW = LEAST - KEY + 1 neighbouring
places. Every passage of LEAST words has one among its first WINDOW places, its own, and copies of it have theirs at
the same place. A retained suffix stands for the passages that it is the own one of: it is cut after the last of
them, and the words before it, back to the first of them, go along.

Retained suffixes whose first KEY words occur in no other document are left out first (a comparison of hashes, which
drops no match). The others are dealt to partitions by their first KEY words and sorted there by all their words.
Neighbours are compared for the number of words in common, so suffixes that agree on n words form a run of the
order; a match is then extended to the left word by word. A passage with o words left of its suffix is shared where
suffixes of several documents agree on o words to the left and LEAST - o to the right. Only words decide, and every
passage of LEAST words is decided that could occur elsewhere, so the spans are those of the dense suffix array.

Suffixes whose first KEY words occur over TILE times are dealt out in tiles, by document and place. What a tile doesn't settle by words is
compared over the tiles by 128-bit digests of the passages. Passages that two documents share are joined to maximal
spans. A passage that repeats only inside one document isn't reported.

Nulls: a null text is empty; texts of fewer than LEAST words have no span. Rows with one doc_id and one text are
one document (rows without doc_id: with one text), told apart by 128 bits of hash; each of its spans is returned
once. doc_id is of any type that can be hashed. Other columns are not looked at; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.lineage import pinned
from docgrid.llm import words as W
from docgrid.llm.bloom import bloom, may_be_in
from docgrid.llm.common import text_or_empty

LEAST = 50
KEY = 10
#: Suffixes of one beginning that are compared in one task.
TILE = 1024
#: Suffixes that are compared in one call; more where one beginning has more.
TOGETHER = 8192


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes.split knows ASCII white space only


def own_minimisers(keys: np.ndarray, window: int) -> np.ndarray:
    """For every `window` neighbours the place of the least key (of ties the first); never falls."""
    if len(keys) < window:
        return np.zeros(0, np.int64)
    best = np.arange(len(keys))
    span = 1
    # the least of 2 * span neighbours from two of span; the last step overlaps
    while span < window:
        step = min(span, window - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(keys[b] < keys[a], b, a)
        span += step
    return best


def suffixes(rows: DataFrame, least: int, key: int) -> DataFrame:
    """(key, r1, r2, at): the retained suffixes of rows (r1, r2, text), with a hash of their first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for text in batch.column(2).to_pylist():
                own = W.runs(W.hashes(words_of(text)), key)
                at = np.unique(own_minimisers(own, least - key + 1))
                keys.append(own[at])
                places.append(at)
            row = np.repeat(np.arange(batch.num_rows), [len(x) for x in places[1:]])
            ids = [batch.column(k).take(pa.array(row)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *ids, pa.array(np.concatenate(places))], ["key", "r1", "r2", "at"])

    return rows.select("r1", "r2", "text").mapInArrow(run, "key long, r1 long, r2 long, at long")


def _contexts(least: int, key: int):
    """Of texts with the places of their candidates: the words of each suffix and, in reverse, those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for nth, (text, places) in enumerate(zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                words, places = words_of(text), np.sort(np.array(places, np.int64))
                own = W.runs(W.hashes(words), key)
                best, at = own_minimisers(own, least - key + 1), places & 0xFFFFFFFF
                firsts, lasts = np.searchsorted(best, at), np.searchsorted(best, at, side="right") - 1
                for p, tile, a, b in zip(at.tolist(), (places >> 32).tolist(), firsts.tolist(), lasts.tolist(), strict=True):
                    right, left = b" ".join(words[p : b + least]) + b" ", b" ".join([*words[a:p][::-1], b""])
                    for column, value in zip(out, (nth, int(own[p].view(np.int64)), tile, right, left, p), strict=True):
                        column.append(value)
                    if len(out[0]) >= TOGETHER:
                        yield _context_rows(batch, out)
                        out = [[] for _ in range(6)]
            yield _context_rows(batch, out)

    return run


def _context_rows(batch: pa.RecordBatch, out: list[list]) -> pa.RecordBatch:
    row = pa.array(out[0], pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    columns = [pa.array(x, t) for x, t in zip(out[1:], kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, *[batch.column(c).take(row) for c in ("r1", "r2", "doc_id")]], ["key", "tile", "right", "left", "at", "r1", "r2", "doc_id"])


def _filled(numbers: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of `sizes` numbers each, filled with -1 up to `width`."""
    out = np.full((len(sizes), width), -1, np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = numbers
    return out


def _compared(part: pa.Table, least: int, key: int) -> pa.Table:
    """Of suffixes sorted by tile and words, whole beginnings at a time: (first, last) of runs of shared passages, and
    of tiles: passages with their digests, `settled` where they are known to be shared."""
    rights, lefts = part.column("right").to_pylist(), part.column("left").to_pylist()
    n_right, n_left = (np.array([x.count(b" ") for x in side]) for side in (rights, lefts))
    flat = pa.array(b"".join([*rights, *lefts]).split(), pa.binary()).dictionary_encode()
    numbers, cut, m, width = flat.indices.to_numpy(), int(n_right.sum()), len(rights), least - key
    right, left = _filled(numbers[:cut], n_right, least), _filled(numbers[cut:], n_left, width)
    tile, at, r1, r2 = (part.column(c).to_numpy() for c in ("tile", "at", "r1", "r2"))
    same = right[1:] == right[:-1]
    common = np.where(same.all(axis=1), least, (~same).argmax(axis=1))
    common[tile[1:] != tile[:-1]] = 0
    order = np.lexsort((r2, r1))
    who = np.empty(m, np.int64)
    who[order] = np.cumsum(np.concatenate(([0], (np.diff(r1[order]) != 0) | (np.diff(r2[order]) != 0))))
    agree = lambda n: np.concatenate(([0], np.cumsum(common < n)))  # noqa: E731  numbers of the runs that agree on n words
    behind, alive, found = agree(key), np.arange(m), np.zeros((m, width + 1), bool)
    single, several = [], []  # of tiles: (suffix, words to the left) of passages of one document here, and one for each of several
    for o in range(width + 1):
        if o:
            alive = alive[n_left[alive] >= o]
            _, behind[alive], counts = np.unique(behind[alive] * (len(flat.dictionary) + 1) + left[alive, o - 1], return_inverse=True, return_counts=True)
            alive = alive[(counts[behind[alive]] > 1) | (tile[alive] > 0)]
        now = alive[least - n_right[alive] <= o]
        if not len(now):
            continue
        code = behind[now] * m + agree(least - o)[now]
        order = np.argsort(code, kind="stable")
        now, code = now[order], code[order]
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        shared = np.minimum.reduceat(who[now], starts) != np.maximum.reduceat(who[now], starts)
        each = np.repeat(shared, np.diff(np.append(starts, len(now))))
        found[now[each], o] = True
        single += [(i, o) for i in now[~each & (tile[now] > 0)].tolist()]
        several += [(i, o) for i in now[starts[shared]].tolist() if tile[i] > 0]
    # the passage with o words to the left begins at `at - o`: columns by rising beginning
    rising = np.pad(found[:, ::-1], ((0, 0), (1, 1)))
    owner, first = np.nonzero(rising[:, 1:-1] & ~rising[:, :-2])
    _, last = np.nonzero(rising[:, 1:-1] & ~rising[:, 2:])
    digests = [xxhash.xxh3_128_digest(b" ".join([*lefts[i].split()[:o][::-1], *rights[i].split()[: least - o]])) for i, o in single + several]
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    rows = np.concatenate([owner, [i for i, _ in single + several]]).astype(np.int64)
    begin = np.concatenate([at[owner] - width + first, [at[i] - o for i, o in single + several]]).astype(np.int64)
    end = np.concatenate([at[owner] - width + last, begin[len(owner) :]]).astype(np.int64)
    pad = [None] * len(owner)
    columns = [part.column(c).combine_chunks().take(pa.array(rows)) for c in ("r1", "r2", "doc_id")]
    own = [pa.array(begin), pa.array(end), *[pa.array(pad + halves[:, k].tolist(), pa.int64()) for k in (0, 1)], pa.array([True] * len(owner) + [False] * len(single) + [True] * len(several), pa.bool_())]
    return pa.table([*columns, *own], ["r1", "r2", "doc_id", "first", "last", "d1", "d2", "settled"])


def _neighbours(least: int, key: int, together: int):
    """Whole beginnings of a sorted partition, `together` suffixes or more at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < together:
                continue
            part = pa.Table.from_batches(held)
            keys, tiles = part.column("key").to_numpy(), part.column("tile").to_numpy()
            others = np.flatnonzero((keys != keys[-1]) | (tiles != tiles[-1]))
            cut = int(others[-1]) + 1 if len(others) else 0  # the last beginning may go on
            if cut:
                yield from _compared(part.slice(0, cut), least, key).to_batches()
            held = part.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield from _compared(pa.Table.from_batches(held), least, key).to_batches()

    return run


def shared_passages(documents: DataFrame, least: int = LEAST, key: int = KEY) -> DataFrame:
    """A row per document and maximal span: doc_id, start_word, end_word (after the last), n_words.

    Every word of a span lies in a passage of `least` words that another document has, too.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("r2"), "doc_id", "text")
    retained = pinned(suffixes(rows, least, key))
    several = F.expr("min(r1) <> max(r1) OR min(r2) <> max(r2)")
    tiles = F.when(F.count("*") > TILE, F.ceil(F.count("*") / TILE)).otherwise(0).cast("long")
    # written, here and below, so that both sides of a join have an exchange of their own and Spark can split a hot key
    beginnings = pinned(retained.groupBy("key").agg(tiles.alias("tiles"), several.alias("several")).where("several").select("key", "tiles"))
    # by document and place, as one document may have a beginning very often
    tile = F.when(F.col("tiles") > 0, F.pmod(F.xxhash64("r1", F.floor(F.col("at") / TILE)), "tiles") + 1).otherwise(0)
    candidates = pinned(retained.join(beginnings, "key").groupBy("r1", "r2").agg(F.collect_set(F.col("at") + F.shiftleft(tile, 32)).alias("places")))
    # only texts that may have candidates are shuffled; rows that repeat are reduced before
    n_candidates = candidates.count()
    if 4 * n_candidates < 3 * rows.count():
        rows = rows.where(may_be_in(bloom(candidates.select(F.xxhash64("r1", "r2").alias("h")), n_candidates), F.xxhash64("r1", "r2")))
    texts = rows.groupBy("r1", "r2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    ids = f"r1 long, r2 long, doc_id {kind}"
    contexts = texts.join(candidates, ["r1", "r2"]).mapInArrow(_contexts(least, key), f"key long, tile long, right binary, left binary, at long, {ids}")
    array = contexts.repartition("key", "tile").sortWithinPartitions("tile", "right")
    found = pinned(array.mapInArrow(_neighbours(least, key, TOGETHER), f"{ids}, first long, last long, d1 long, d2 long, settled boolean"))
    runs = found.where("d1 IS NULL").select("r1", "r2", "doc_id", "first", "last")
    if beginnings.where("tiles > 0").limit(1).count():
        digests = found.where("d1 IS NOT NULL")
        shared = pinned(digests.groupBy("d1", "d2").agg((several | F.max("settled")).alias("shared")).where("shared").select("d1", "d2"))
        runs = runs.unionByName(digests.where("NOT settled").join(shared, ["d1", "d2"], "left_semi").select(runs.columns))
    runs = runs.groupBy("r1", "r2", "first").agg(F.max("last").alias("last"), F.first("doc_id").alias("doc_id"))
    order = Window.partitionBy("r1", "r2").orderBy("first")
    new = (F.col("first") > F.coalesce(F.lag("last").over(order), F.lit(-least - 1)) + least).cast("int")
    islands = runs.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("r1", "r2", "island").agg(F.first("doc_id").alias("doc_id"), F.min("first").alias("start_word"), (F.max("last") + least).alias("end_word"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
