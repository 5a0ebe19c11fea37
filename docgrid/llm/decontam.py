"""Benchmark decontamination by edit distance, through CGK embedding and bit-sampling LSH.

Words are `\\w+` runs of the lower-cased text; edits are of words. An item of n words is found in a document where
some passage is within floor((1 - SIMILARITY) * n) edits of it.

An item is cut into equal parts of at most PART words. If a passage is within a share of an item's words in edits,
some part of the passage is within that share of the part's words, so an item is looked for by each of its parts.

Windows of a part's size slide over the document. A CGK walk copies a window's words to a string of three times
its length, moving on after each copy or not as a random bit of (step, word) says; strings at small edit distance
give copies at small Hamming distance. Each of REPEATS walks feeds TABLES tables, whose key is BITS sampled places
of the copy; where a window meets a part in a table, the whole item is verified by the exact edit distance, with free ends.

Only windows that can hold a passage are walked: by the q-gram lemma, a passage at k edits shares with a part of
n words at least n - q + 1 - k q of its runs of q words, of which a window of n words keeps all but k. This drops no
match. Recall at exactly the largest number of edits is measured in the tests, from 5 to 300 words, for substitutions,
insertions and deletions each: REPEATS x TABLES tables of BITS places reach over 0.95 for parts of up to PART words.

The benchmark is a query set: its items go to the tasks in blocks of at most BLOCK_CHARS and BLOCK_PARTS, one pass over the
documents for each; the driver holds no more than two blocks. Words are those of the text as it is, each in small
letters, so places are exact. No shuffle of documents. Nulls: a null text of either side is empty and matches nothing; items without
words are ignored. Ids may be null or repeat: one row per document row and item row. Other columns are not
looked at.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docgrid.functions.lineage import pinned
from docgrid.llm import words as W
from docgrid.llm.common import text_or_empty

SIMILARITY = 0.8
GRAM = 3
PART = 50
REPEATS, TABLES, BITS = 10, 12, 3
BLOCK_CHARS = 16_000_000
#: Parts of a block: each has REPEATS x TABLES keys, some 1.5 KB in a worker.
BLOCK_PARTS = 1 << 16
PAD = np.uint64(0)
#: Texts that are looked through at a time.
TOGETHER = 256


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


class Walks:
    """The random choices; the same for items and windows, on every machine."""

    def __init__(self, seed: int = 5) -> None:
        self.seed = seed

    def _bits(self, repeat: int, step: int, symbols: np.ndarray) -> np.ndarray:
        odd = np.uint64(((repeat * 1_000_003 + step) * 0x9E3779B97F4A7C15 + self.seed) % (1 << 63) * 2 + 1)
        return (W.mixed(symbols * odd) >> np.uint64(63)).astype(np.int64)

    def keys(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """windows: (m, n) words. A key of each window for each table, table after table."""
        m, n = windows.shape
        padded = np.hstack([windows, np.full((m, 1), PAD)])
        rows = np.arange(m)
        for repeat in range(REPEATS):
            rng = np.random.default_rng([self.seed, repeat, n])
            picks = [np.sort(rng.choice(max(BITS, 2 * n), BITS, replace=False)) for _ in range(TABLES)]  # over two thirds of the copy: the rest is mostly padding
            wanted = {int(p) for t in picks for p in t}
            at, copies = np.zeros(m, np.int64), {}
            for step in range(max(wanted) + 1):
                symbols = padded[rows, at]
                if step in wanted:
                    copies[step] = symbols
                at = np.minimum(at + self._bits(repeat, step, symbols), n)
            for t, places in enumerate(picks):
                key = np.full(m, np.uint64(repeat * TABLES + t + 1))
                for p in places.tolist():
                    key = W.mixed(key * W.STEP + copies[p])
                yield key


def passage_distance(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the passage of part that is nearest to the whole item; of ties, the first end."""
    m = len(part)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    ladder = np.arange(m + 1)
    for k, word in enumerate(item, 1):
        swap, drop = cost[:-1] + (part != word), cost[1:] + 1
        new = np.concatenate(([k], np.minimum(swap, drop)))
        begun = np.concatenate(([0], np.where(swap <= drop, start[:-1], start[1:])))
        # insertions: the least of new[j] + (i - j) over j <= i
        lowered = new - ladder
        least = np.minimum.accumulate(lowered)
        origin = np.maximum.accumulate(np.where(lowered == least, ladder, 0))
        cost, start = least + ladder, begun[origin]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def parts(n: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of an item of n words."""
    m = -(-n // PART)
    return [(n * i // m, n * (i + 1) // m) for i in range(m)]


class Matcher:
    """A block of items with the grams and tables of their parts."""

    def __init__(self, items: list[tuple[object, str]], similarity: float = SIMILARITY) -> None:
        self.walks, self.items = Walks(), []
        for item_id, text in items:
            words = W.hashes(W.lowered(text))
            if len(words):
                self.items.append((item_id, words, edits_allowed(len(words), similarity)))
        self.parts: list[tuple[int, int, np.ndarray]] = []  # item, place in it, words
        self.reach: list[int] = []  # how far from where a part puts it an item's passage may begin or end
        for k, (_, words, most) in enumerate(self.items):
            cuts = parts(len(words))
            self.parts += [(k, a, words[a:b]) for a, b in cuts]
            self.reach.append(most if len(cuts) == 1 else most + max(edits_allowed(b - a, similarity) for a, b in cuts))
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_gram: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        self.needs: list[tuple[int, int]] = []
        for k, (_, _, words) in enumerate(self.parts):
            n, most = len(words), edits_allowed(len(words), similarity)
            q = next(q for q in (min(GRAM, n), min(2, n), 1) if q == 1 or n - q + 1 - most * q - most >= 1)
            self.needs.append((q, max(1, n - q + 1 - most * q - most)))
            by_gram[q].append((np.unique(W.runs(words, q)), k))
        for q, found in by_gram.items():
            grams, owner = np.concatenate([g for g, _ in found]), np.concatenate([np.full(len(g), k) for g, k in found])
            order = np.argsort(grams, kind="stable")
            self.grams[q] = grams[order], owner[order]
        # all tables of a size: sorted keys (which tell tables apart) and the parts that have them
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, (_, _, words) in enumerate(self.parts):
            by_size[len(words)].append(k)
        for n, ks in by_size.items():
            keys = np.concatenate(list(self.walks.keys(np.stack([self.parts[k][2] for k in ks]))))
            order = np.argsort(keys, kind="stable")
            self.tables[n] = keys[order], np.array(ks, np.int32)[order % len(ks)]

    def windows(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Size to starts of windows that can hold a passage near a part of that size; starts may lie before the text."""
        out: dict[int, list[np.ndarray]] = defaultdict(list)
        for q, (grams, owner) in self.grams.items():
            own = W.runs(words, q)
            if not len(own):
                continue
            at = np.searchsorted(grams, own)
            at[at == len(grams)] = 0
            hits = np.flatnonzero(grams[at] == own)
            if not len(hits):
                continue
            last = np.searchsorted(grams, own[hits], side="right")
            first = at[hits]
            counts = last - first
            places = np.repeat(hits, counts)
            which = owner[np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())]
            order = np.lexsort((places, which))
            places, which = places[order], which[order]
            edges = np.flatnonzero(np.diff(which)) + 1
            for at0, at1 in zip([0, *edges.tolist()], [*edges.tolist(), len(which)], strict=True):
                k = int(which[at0])
                n, need = len(self.parts[k][2]), self.needs[k][1]
                if at1 - at0 < need:
                    continue
                p = places[at0:at1]
                span = n - q  # grams at s .. s + span lie in the window at s
                near = p[need - 1 :] - p[: len(p) - need + 1] <= span
                begin, finish = p[need - 1 :][near] - span, p[: len(p) - need + 1][near]
                if len(begin):
                    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(begin.tolist(), finish.tolist(), strict=True)])
                    out[n].append(np.unique(starts))
        return {n: np.unique(np.concatenate(x)) for n, x in out.items()}

    def candidates(self, texts: list[np.ndarray]) -> dict[tuple[int, int], list[int]]:
        """(text, item) to the places where the item begins by the windows that met a part of it in a table."""
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for d, words in enumerate(texts):
            for n, starts in self.windows(words).items():
                padded = np.concatenate([np.full(n, PAD), words, np.full(n, PAD)])
                starts = starts[(starts > -n) & (starts < len(words))]
                by_size[n].append((np.lib.stride_tricks.sliding_window_view(padded, n)[starts + n], starts, np.full(len(starts), d)))
        out: dict[tuple[int, int], set[int]] = defaultdict(set)
        for n, parts in by_size.items():
            windows, starts, docs = (np.concatenate([p[i] for p in parts]) for i in range(3))
            known, owner = self.tables[n]
            for at in range(0, len(windows), 1 << 15):
                part = slice(at, at + (1 << 15))
                for keys in self.walks.keys(windows[part]):
                    first = np.searchsorted(known, keys)
                    first[first == len(known)] = 0
                    met = np.flatnonzero(known[first] == keys)
                    for r, end in zip(met.tolist(), np.searchsorted(known, keys[met], side="right").tolist(), strict=True):
                        for k in owner[first[r] : end].tolist():
                            item, offset, _ = self.parts[k]
                            out[int(docs[at + r]), item].add(int(starts[at + r]) - offset)
        return {pair: sorted(s) for pair, s in out.items()}

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, word after the last), the nearest passage of each pair."""
        out = []
        for (d, k), starts in sorted(self.candidates(texts).items()):
            (_, words, most), reach = self.items[k], self.reach[k]
            best, at = None, 0
            while at < len(starts):
                to = at
                while to + 1 < len(starts) and starts[to + 1] - starts[to] <= len(words):
                    to += 1
                first = max(0, starts[at] - reach)
                edits, a, b = passage_distance(words, texts[d][first : max(0, starts[to] + len(words) + reach)])
                if edits <= most and a < b and (best is None or edits < best[0]):
                    best = (edits, first + a, first + b)
                at = to + 1
            if best:
                out.append((d, k, *best))
        return out


#: The matcher that this worker built last, under a hash of its items: tasks of one job share it.
_built: dict[str, Matcher] = {}


def _matcher(block: list[tuple[object, str]], similarity: float, key: str) -> Matcher:
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(block, similarity)
    return _built[key]


def _key(block: list[tuple[object, str]], similarity: float) -> str:
    return hashlib.sha256(repr((similarity, block)).encode("utf-8", "replace")).hexdigest()


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[object, str]], bool]]:
    """(items, whether they are the last) in blocks of at most BLOCK_CHARS and BLOCK_PARTS, or of one item; never none.

    Items come to the driver in parts of about a block, one at a time, so it holds two blocks and two parts at most.
    """
    items = benchmark.select("item_id", text_or_empty().alias("text"))
    chars, rows = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)), F.count("*")).first()
    block, size, n_parts = [], 0, 0
    for row in items.repartition(1 + max(chars // BLOCK_CHARS, (rows + chars // (2 * PART)) // BLOCK_PARTS)).toLocalIterator():
        own = 1 + len(row.text) // (2 * PART)  # a word takes two characters at least
        if block and (size + len(row.text) > BLOCK_CHARS or n_parts + own > BLOCK_PARTS):
            yield block, False
            block, size, n_parts = [], 0, 0
        block.append((row.item_id, row.text))
        size, n_parts = size + len(row.text), n_parts + own
    yield block, True


def find_leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row per document row and item that it contains: doc_id, item_id, n_edits, n_words, start, end (code points).

    What a block finds is written before the next block comes to the driver; the last one's is found when it is read.
    """
    kinds = [documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_edits long, n_words long, start long, end long"
    item_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    texts, out = documents.select("doc_id", text_or_empty().alias("text")), None
    for block, last in _blocks(benchmark):
        part = texts.mapInArrow(_runner(block, similarity, item_kind), schema)
        part = part if last else pinned(part)
        out = part if out is None else out.unionByName(part)
    return out


def _runner(block: list[tuple[object, str]], similarity: float, item_kind: pa.DataType):
    key = _key(block, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block, similarity, key)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = matcher.matches([W.hashes(W.lowered(x)) for x in texts])
            spans = {d: W.spans(texts[d]) for d, *_ in found}
            places = [(spans[d][a][0], spans[d][b - 1][1]) for d, _, _, a, b in found]
            columns = [batch.column(0).take(pa.array([d for d, *_ in found], pa.int64())), pa.array([matcher.items[k][0] for _, k, *_ in found], item_kind)]
            numbers = [[e for _, _, e, _, _ in found], [len(matcher.items[k][1]) for _, k, *_ in found], [a for a, _ in places], [b for _, b in places]]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int64()) for x in numbers]], ["doc_id", "item_id", "n_edits", "n_words", "start", "end"])

    return run


def drop_leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of documents, all columns, that contain no item; decided where they are scanned, without a join.

    Of several blocks, what a block leaves is written before the next one comes to the driver.
    """
    out = documents
    for block, last in _blocks(benchmark):
        out = out.where(~_contains(block, similarity)(text_or_empty()))
        out = out if last else pinned(out)
    return out


def _contains(block: list[tuple[object, str]], similarity: float):
    key = _key(block, similarity)

    @F.arrow_udf("boolean")
    def contains(texts: pa.Array) -> pa.Array:
        matcher = _matcher(block, similarity, key)
        found: set[int] = set()
        for at in range(0, len(texts), TOGETHER):
            found |= {at + d for d, *_ in matcher.matches([W.hashes(W.lowered(x)) for x in texts[at : at + TOGETHER].to_pylist()])}
        return pa.array([d in found for d in range(len(texts))], pa.bool_())

    return contains
