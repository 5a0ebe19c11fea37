"""Line dedup, importance resampling, ranked search and the Bloom filter: against plain loops over small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgrid.llm import bloom, lexical_search, line_dedup, resampling

SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}
LINES = [
    (1, "Shared line of some length\nonly in one\n\nshort"), (2, "  shared LINE of some length\t\nonly in two, of one\nonly in two, of one\nshort"), (2, "a second text of two: unlike\nshared line of some length"),
    (3, "shared line of some length"), (3, "shared line of some length"), (None, "no id, one line here\nshared line of some length"), (None, "no id, one line here"), (4, "no id, one line here\n"),
    (5, "Éé line beyond ascii\néé line beyond ascii\n"), (6, "éé line beyond ascii\n\n\n"), (7, "ninechars\ntenlongerx"), (8, "ninechars\nTENLONGERX"), (9, "àéîõüñçßøå"), (10, "àéîõüñçßøå"), (11, "àéîõüñçßø"), (12, "àéîõüñçßø"),
]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def plain_lines(rows):
    """(doc_id, lines before, lines dropped, the text that stays) of each row."""
    rank = lambda d: (d is None, d or 0)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    first = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(first.get(key(line), rank(d)), rank(d))
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or first[key(x)] == rank(d)]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def found_lines(documents):
    kept = line_dedup.drop_lines(documents, line_dedup.line_bitmaps(documents))
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in kept.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()], key=repr)


def test_lines_match_a_plain_loop(spark, nasty, documents):
    for table in (nasty, documents.unionByName(documents.limit(40)), spark.createDataFrame(LINES, "doc_id long, text string")):
        assert found_lines(table) == plain_lines(rows_of(table))


def test_a_line_that_a_third_of_all_lines_are_is_dealt_over_ranges(spark):
    rows = [(k, f"the same line in every document\nline of its own {k}\n" + ("the same line in every document\n" * (k % 3))) for k in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found_lines(table) == plain_lines(rows)
        lines = line_dedup._line_rows(table).where("h1 IS NOT NULL")
        order = [F.col("h1"), F.col("h2"), F.col("doc_id"), F.col("row_key"), F.col("pos")]
        sizes = [r["count"] for r in lines.repartitionByRange(*order).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n_ranges", [1, 2, 3, 5, 17])
@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_streaming_over_any_ranges_and_batches(n_ranges, size):
    """Rows cut anywhere into ranges and batches: open rows and ends give each hash its first document."""
    rng = np.random.default_rng(n_ranges * 1000 + size)
    rows = sorted({(int(h), int(h) % 2, int(d), 0, int(p)) for h, d, p in zip(rng.integers(0, 4, 60), rng.integers(0, 6, 60), rng.integers(0, 5, 60), strict=True)})
    rows = [x for x in rows for _ in range(int(rng.integers(1, 3)))]
    cuts = [0, *sorted(rng.integers(0, len(rows) + 1, n_ranges - 1).tolist()), len(rows)]
    said = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = rows[a:b]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part[i : i + size]], pa.int32() if k == 4 else pa.int64()) for k in range(5)], ["h1", "h2", "doc_id", "row_key", "pos"]) for i in range(0, len(part), size)]
        for out in line_dedup._first_occurrences(pa.int64())(iter(batches)):
            said += [tuple(x.values()) for x in out.to_pylist()]
    firsts = defaultdict(list)
    for says, d, _, _, h1, h2 in said:
        if says == line_dedup.END:
            firsts[h1, h2].append(d)
    lost = [(h1, d, pos) for says, d, _, pos, h1, h2 in said if says == line_dedup.GOES or (says == line_dedup.OPEN and d != min(firsts[h1, h2]))]
    least = {h: min(d for x, _, d, _, _ in rows if x == h) for h in {r[0] for r in rows}}
    assert set(lost) == {(h, d, p) for h, _, d, _, p in rows if d != least[h]}
    assert len(lost) < len(set(lost)) + n_ranges  # repeats come once within a range


def test_bitmaps_hold_no_text_and_unpack(spark):
    table = spark.createDataFrame(LINES, "doc_id long, text string")
    for r in line_dedup.line_bitmaps(table).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=r.n_lines)
        assert r.n_lines - bits.sum() == r.n_dropped
    assert line_dedup.line_bitmaps(table).columns == ["doc_id", "row_key", "n_lines", "n_dropped", "keep"]


def test_dedup_lines_keeps_all_columns(nasty, empty):
    out = line_dedup.dedup_lines(nasty)
    assert out.columns == nasty.columns and out.count() == nasty.count()
    odd = nasty.withColumn("a.b", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("n_lines", F.lit(3))
    assert line_dedup.dedup_lines(odd).columns == odd.columns
    assert line_dedup.dedup_lines(empty).count() == line_dedup.line_bitmaps(empty).count() == 0


def test_string_ids(spark):
    rows = [("b", "a line that is shared"), ("a", "a line that is shared"), (None, "a line that is shared")]
    table = spark.createDataFrame(rows, "doc_id string, text string")
    assert {(r[0], r[2]) for r in found_lines(table)} == {("a", 0), ("b", 1), (None, 1)}


def plain_resampled(rows, target, n_of=(1, 1), buckets=10_000, least_words=20, percent=10, seed=2024):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(n_of[0], n_of[1] + 1) for k in range(len(words) - n + 1)]

    made = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for (d, _), (n_words, f) in zip(rows, made, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    order = sorted((x for x in out if x[4] >= least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = [(*x[:4], k + 1 if k < len(order) * percent // 100 else None) for k, x in enumerate(order)]
    return sorted([*drawn, *[(*x[:4], None) for x in out if x[4] < least_words]], key=repr)


@pytest.mark.parametrize(("n_of", "percent", "least_words"), [((1, 1), 10, 20), ((1, 3), 35, 5), ((2, 2), 100, 0)])
def test_resampling_matches_a_plain_loop(nasty, documents, benchmark, n_of, percent, least_words):
    target = benchmark.select("text")
    for table in (nasty, documents):
        found = resampling.resampled(table, target, *n_of, percent=percent, least_words=least_words)
        plain = plain_resampled(rows_of(table), [r.text for r in target.collect()], n_of, percent=percent, least_words=least_words)
        assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, found.collect()), key=repr) == plain


def test_overlapped_patterns_span_every_run():
    line = resampling.collapsed("One, TWO\tthree--éÈ 5")
    assert line == "one two three éÈ 5".encode()
    for n in range(1, 7):
        words = line.split()
        assert [m[0] for m in resampling.pattern(n).finditer(line, overlapped=True)] == [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]


def test_resampling_of_nothing(spark, nasty, empty):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resampled(empty, nothing).count() == 0
    assert resampling.resampled(empty, nasty).count() == 0
    assert resampling.resampled(nasty, nothing).count() == nasty.count()


def plain_search(rows, items, most=10):
    terms = lambda x: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (x or "").translate(LOWER))
    held = [(d, Counter(terms(x))) for d, x in rows]
    held = [(d, c) for d, c in held if c]
    n_all, long_all = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, x in items:
        asked[i] |= set(terms(x))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_all // long_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:most])]
    return sorted(out, key=repr)


ITEMS = [(1, "The same text here, twice"), (1, "word"), (2, None), (3, ""), (None, "shared1 shared2 right"), (4, "nothing of this is there zzzz"), (5, "word word word"), (6, "\U0001f600 éÉ"), (7, "x")]


def test_search_matches_a_plain_loop(spark, nasty, documents, benchmark):
    odd = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit(1)).withColumn("doc_id", F.lit(2))
    for table in (nasty, documents):
        for items in (odd, benchmark):
            asked = [(r.item_id, r.text) for r in items.select("item_id", "text").collect()]
            assert sorted(map(tuple, lexical_search.search(table, items).collect()), key=repr) == plain_search(rows_of(table), asked)


def test_search_in_small_blocks_and_windows(monkeypatch, documents, benchmark):
    """Many blocks of postings and of items, many windows: the same result."""
    asked = [(r.item_id, r.text) for r in benchmark.select("item_id", "text").collect()]
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 200)
    assert sorted(map(tuple, lexical_search.search(documents, benchmark, 3).collect()), key=repr) == plain_search(rows_of(documents), asked, 3)


@pytest.mark.parametrize("share", [1, 4, 10**9])
@pytest.mark.parametrize("least", [0, 1])
def test_hybrid_iterators_give_the_best(monkeypatch, share, least):
    """Random lists, some short and some long: accumulators, skipped windows and lookups against sums of all."""
    monkeypatch.setattr(lexical_search, "WINDOW", 16)
    monkeypatch.setattr(lexical_search, "SHARE", share)
    rng = np.random.default_rng(share)
    for _ in range(200):
        n, n_terms = int(rng.integers(1, 200)), int(rng.integers(1, 8))
        held = [(t, d) for t in range(n_terms) for d in np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.3, 0.9])).tolist()]
        rng.shuffle(held)
        held = sorted(held, key=lambda x: x[1])
        ids, places = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
        scores = rng.integers(0, 6, len(held)) * np.where(ids % 3 == 0, 1, 5)
        lists = lexical_search.Lists(ids, places, scores, n, n_terms)
        total = np.bincount(places, weights=scores, minlength=n).astype(np.int64) if len(held) else np.zeros(n, np.int64)
        order = [d for d in np.lexsort((np.arange(n), -total)).tolist() if total[d] > 0]
        bar = int(total[order[4]]) if least and len(order) > 4 else 0
        where, found = lexical_search.best(lists.iterators(np.arange(n_terms)), lists.n_windows, 5, bar)
        assert where.tolist() == order[:5] and found.tolist() == total[order[:5]].tolist()


def test_whole_windows_are_skipped(monkeypatch):
    monkeypatch.setattr(lexical_search, "WINDOW", 16)
    opened = []
    whole = lexical_search.Postings.window
    monkeypatch.setattr(lexical_search.Postings, "window", lambda self, k: opened.append(k) or whole(self, k))
    scores = np.ones(1600, np.int64)
    scores[3] = 100
    list_ = lexical_search.Postings(np.arange(1600), scores, 100)
    assert lexical_search.best([list_], 100, 1)[0].tolist() == [3] and set(opened) == {0}


def test_length_norm_beyond_64_bits():
    n = np.array([1, 10**7], np.int64)
    assert lexical_search.length_norm(n, 10**11, 10**13).tolist() == [10 + 90 * 10**11 // 10**13, 10 + 90 * 10**18 // 10**13]


def test_search_of_nothing(spark, nasty, empty):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(nasty, nothing).collect() == []
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical_search.search(empty, items).collect() == []


def test_bloom_holds_all_and_little_else(spark):
    table = spark.range(40_000).select(F.xxhash64("id").alias("h"), "id")
    words = bloom.bloom(table.where("id < 10000").select("h"), 10_000)
    passed = table.where(bloom.may_be_in(words, F.col("h")))
    assert passed.where("id < 10000").count() == 10_000 and passed.count() < 10_000 + 300
    assert bloom.words_for(0) == bloom.LEAST_WORDS and bloom.words_for(10**12) == bloom.MOST_WORDS
