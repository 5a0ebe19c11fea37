"""Hierarchical packing of documents into sequences of several context sizes.

A document's full windows of the largest size are sequences of their own. Its rest is routed to the smallest
tier (context size) that holds it. Windows are opened for the longest rests first; the gap of a window is
filled with the longest rests of shorter tiers that fit, the last of it with the head of a shorter rest, whose
tail goes back to its tier. So every window of a task is full but for the last, whose content is cut along the
tiers. Sequences of a tier are dealt to step groups of about GROUP_TOKENS tokens, one tier each, in a snake
order of their attention cost, so that the steps of a group are alike.

Each task packs what it scans: no shuffle, and memory for one document and one block of rests, of which only the
ids that wait are held (at most 4 * BLOCK_TOKENS bytes, in at most BLOCK_RESTS arrays). What a task leaves short is
less than one window. Nulls: a null text is empty; an empty text is the end id alone. doc_id may be null or repeat;
each row is a document. An empty table gives no sequences; other columns are not looked at. sequence_id and
step_group hold the number of the task in the bits from 40 up.
"""

import functools
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docgrid.llm.common import text_or_empty

TIERS = (256, 512, 1024, 2048)
END_ID = 1
GROUP_TOKENS = 1 << 17
#: Groups of a tier that are dealt together.
DEAL = 4
#: Rests of so many tokens, or so many rests, are packed together.
BLOCK_TOKENS = 1 << 22
BLOCK_RESTS = 1 << 17
#: Texts that are taken out of a batch at a time; sequences that are put into one.
TOGETHER = 512
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}


@functools.cache
def encoder(path: str):
    """The byte-level BPE of the ranks at `path`; it gives the ids of the .json form of that vocabulary, several times as fast."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@functools.cache
def json_encoder(path: str):
    """The same vocabulary in its .json form."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")


def token_ids(text: str, path: str) -> np.ndarray:
    """ids of a whole text and the end id; strings of special tokens are those tokens."""
    try:
        ids = encoder(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # its pattern gives up on hundreds of thousands of blanks in a row; the slower form takes them
        ids = json_encoder(path).encode(text, add_special_tokens=False).ids
    return np.append(ids, END_ID).astype("<u4")


class Rest(NamedTuple):
    """The ids of a document's end, or of a part of it, that wait for a window; at most one window long."""

    ids: np.ndarray
    start: int
    doc_id: object
    doc_tokens: int

    def cut(self, at: int) -> tuple["Rest", "Rest"]:
        return self._replace(ids=self.ids[:at]), self._replace(ids=self.ids[at:], start=self.start + at)


class Piece(NamedTuple):
    """What is kept of a piece once its place is known: no ids."""

    length: int
    start: int
    doc_id: object
    doc_tokens: int
    crc: int


def piece(rest: Rest) -> Piece:
    return Piece(len(rest.ids), rest.start, rest.doc_id, rest.doc_tokens, zlib.crc32(rest.ids))


class Pool:
    """Rests by length, of one length in the order of arrival; a number's bits tell which lengths there are."""

    def __init__(self) -> None:
        self.of: dict[int, deque[Rest]] = defaultdict(deque)
        self.lengths = self.tokens = self.rests = 0

    def add(self, rest: Rest) -> None:
        self.of[len(rest.ids)].append(rest)
        self.lengths |= 1 << len(rest.ids)
        self.tokens += len(rest.ids)
        self.rests += 1

    def longest(self, most: int) -> Rest | None:
        fitting = self.lengths & ((2 << most) - 1)
        return self._take(fitting.bit_length() - 1) if fitting else None

    def shortest(self) -> Rest:
        return self._take((self.lengths & -self.lengths).bit_length() - 1)

    def _take(self, length: int) -> Rest:
        own = self.of[length]
        rest = own.popleft()
        if not own:
            self.lengths ^= 1 << length
        self.tokens -= length
        self.rests -= 1
        return rest


def pack(pool: Pool, tiers: tuple[int, ...], last: bool) -> Iterator[list[Piece]]:
    """Full windows from the pool; what can't fill one stays there, or is cut along the tiers if this is the last call."""
    while pool.lengths:
        window = [pool.longest(tiers[-1])]
        gap = next(t for t in tiers if t >= len(window[0].ids)) - len(window[0].ids)
        while gap and (rest := pool.longest(gap)):
            window.append(rest)
            gap -= len(rest.ids)
        if gap and pool.lengths:
            head, tail = pool.shortest().cut(gap)
            window.append(head)
            pool.add(tail)
        elif gap:  # the last window of all
            if not last:
                for rest in window:
                    pool.add(rest)
                return
            yield from _along_tiers(deque(window), tiers)
            return
        yield [*map(piece, window)]


def _along_tiers(rests: deque[Rest], tiers: tuple[int, ...]) -> Iterator[list[Piece]]:
    total = sum(len(x.ids) for x in rests)
    while rests:
        size, window = next((t for t in reversed(tiers) if t <= total), total), []
        total -= size
        while size:
            head = rests.popleft()
            if len(head.ids) > size:
                head, tail = head.cut(size)
                rests.appendleft(tail)
            window.append(piece(head))
            size -= len(head.ids)
        yield window


class Steps:
    """Deals the sequences of each tier to step groups of like cost; holds pieces without their ids."""

    def __init__(self, group_tokens: int, task: int) -> None:
        self.group_tokens, self.next_group = group_tokens, task << 40
        self.waiting: dict[int, list[tuple[int, list[Piece]]]] = {}

    def add(self, number: int, window: list[Piece]) -> Iterator[tuple[int, int, list[Piece]]]:
        tier = sum(x.length for x in window)
        rows = self.waiting.setdefault(tier, [])
        rows.append((number, window))
        full = DEAL * self.group_tokens // tier
        if len(rows) >= 2 * full:  # so much is held back that the last groups are alike, too
            yield from self.deal(tier, full)

    def deal(self, tier: int, most: int | None = None) -> Iterator[tuple[int, int, list[Piece]]]:
        rows, self.waiting[tier] = self.waiting[tier][:most], self.waiting[tier][most:] if most else []
        if not rows:
            return
        groups = max(1, round(len(rows) * tier / self.group_tokens))
        rows.sort(key=lambda x: -sum(p.length**2 for p in x[1]))
        for k, (number, window) in enumerate(rows):
            turn = k % (2 * groups)
            yield self.next_group + min(turn, 2 * groups - 1 - turn), number, window
        self.next_group += groups


FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())]


def _rows(dealt: list[tuple[int, int, list[Piece]]], tiers: tuple[int, ...], kind: pa.DataType) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(len(FIELDS) + 1)]
    for group, number, window in dealt:
        at, total = 0, sum(p.length for p in window)
        tier = next(t for t in tiers if t >= total)
        for p in window:
            for column, value in zip(out, (p.doc_id, p.start, p.length, p.crc, p.doc_tokens, number, at, tier, group), strict=True):
                column.append(value)
            at += p.length
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [kind, *(t for _, t in FIELDS)], strict=True)], ["doc_id", *(n for n, _ in FIELDS)])


def pack_documents(documents: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    path: the vocabulary's file, at the same place on every machine. Each id of each document lies in exactly one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        pool, steps, number, kind, largest = Pool(), Steps(group_tokens, task), task << 40, None, tiers[-1]
        for batch in batches:
            kind, dealt = batch.schema.field(0).type, []
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = token_ids(text, path)
                    for start in range(0, len(ids) - largest + 1, largest):
                        dealt += steps.add(number, [piece(Rest(ids[start : start + largest], start, doc_id, len(ids)))])
                        number += 1
                    if rest := len(ids) % largest:
                        pool.add(Rest(ids[-rest:].copy(), len(ids) - rest, doc_id, len(ids)))  # a copy, so that the others go
                    if pool.tokens >= BLOCK_TOKENS or pool.rests >= BLOCK_RESTS:
                        for window in pack(pool, tiers, last=False):
                            dealt += steps.add(number, window)
                            number += 1
                if len(dealt) >= TOGETHER:
                    yield _rows(dealt, tiers, kind)
                    dealt = []
            if dealt:
                yield _rows(dealt, tiers, kind)
        dealt = []
        for window in pack(pool, tiers, last=True):
            dealt += steps.add(number, window)
            number += 1
        for tier in [*steps.waiting]:
            dealt += steps.deal(tier)
        if dealt:
            yield _rows(dealt, tiers, kind)

    kind = documents.schema["doc_id"].dataType.simpleString()
    columns = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, {columns}")
