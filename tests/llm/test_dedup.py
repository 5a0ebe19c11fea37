"""Exact copies, SimHash groups, shared passages: against plain loops over small tables."""

import re
from collections import defaultdict

import numpy as np
import xxhash

from docgrid.llm import components, exact_dedup, simhash, suffix_dedup, words


def plain_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text in rows:
        group = groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")]
        out.append((doc_id, min(group, key=lambda g: g[:3])[3], len(group)))
    return sorted(out, key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_matches_a_plain_grouping(nasty, documents):
    for table in (nasty, documents.unionByName(documents.limit(50))):
        found = exact_dedup.exact_dedup(table).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == plain_exact(pairs(table))
        assert {r.text_sha256 for r in found if r.kept} == {r.text_sha256 for r in found} and all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_hot_and_cold_paths_agree(spark):
    hot = spark.createDataFrame([(k, "very hot" if k % 3 == 0 else f"text {k % 40}") for k in range(900)], "doc_id long, text string")
    found = exact_dedup.exact_dedup(hot).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == plain_exact(pairs(hot))
    rows = exact_dedup.pinned(hot.select("doc_id", exact_dedup.digest(hot["text"]).alias("digest"), exact_dedup.F.char_length("text").alias("n_points")))
    assert exact_dedup.frequent_digests(rows).where("hot_size >= 300").count() == 1


def test_exact_tie_goes_to_the_smallest_id_among_the_longest(nasty):
    kept = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(nasty).collect()}
    assert kept[4] == kept[5] == kept[6] == kept[7] == 5
    assert kept[1] == kept[2] == kept[3] == 3


def test_of_one_doc_id_the_longest_text_is_kept(spark):
    for more in (1, 60):  # the second is a hot group
        rows = [(8, "a b"), (8, "a  b"), (9, "a  b"), (None, "c"), (None, " c")] * more
        found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=str) == sorted(([(8, 8, 3 * more, False), (8, 8, 3 * more, True), (9, 8, 3 * more, False), (None, None, 2 * more, False), (None, None, 2 * more, True)] * more), key=str)


def test_drop_copies_keeps_one_whole_row_of_each_group(nasty, documents):
    for table in (nasty, documents):
        out = exact_dedup.drop_copies(table)
        assert out.columns == table.columns
        assert out.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in pairs(table)})


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
    assert simhash.simhash_groups(empty).count() == 0
    assert suffix_dedup.shared_passages(empty).count() == 0


def plain_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(nasty, documents):
    for table in (nasty, documents.limit(60)):
        texts = defaultdict(set)
        for doc_id, text in pairs(table):
            texts[doc_id].add(plain_fingerprint(text))
        assert all(r.fp % (1 << 64) in texts[r.doc_id] for r in simhash.fingerprints(table).collect())


def plain_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_links_find_the_components_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40).tolist()
    fps = set(base)
    for b in base[:12]:  # clusters and chains
        for _ in range(25):
            b ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False))
            fps.add(b)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    expected = plain_components(sorted(f % (1 << 64) for f in fps))
    for tile in (4096, 3):  # the second deals most cells out in tiles
        monkeypatch.setattr(simhash, "TILE", tile)
        roots = {r.node: r.root for r in components.connected_components(simhash.near_links(table)).collect()}
        classes = defaultdict(set)
        for f in signed:
            classes[roots.get(f, f)].add(f % (1 << 64))
        wanted = defaultdict(set)
        for f, r in expected.items():
            wanted[r].add(f)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, wanted.values()))


def test_simhash_groups(nasty):
    rows = pairs(nasty)
    fp = {plain_fingerprint(t) for _, t in rows}
    roots = plain_components(sorted(fp))
    least = defaultdict(list)
    for doc_id, text in rows:
        if doc_id is not None:
            least[roots[plain_fingerprint(text)]].append(doc_id)
    expected = sorted(((i, min(least[roots[plain_fingerprint(t)]], default=None)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(nasty).collect()), key=str) == expected


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (None, 4)], "a long, b long")
    roots = {r.node: r.root for r in components.connected_components(chain).collect()}
    assert {roots[k] for k in range(301)} == {0}
    assert roots[1001] == roots[1000] == 1000


def plain_passages(rows, least):
    """Spans of every document, as a sorted list; rows with one doc_id and one text are one document."""
    where, spans = defaultdict(set), []
    texts = {row: re.findall(r"[^\x20\x09-\x0D]+", row[1] or "") for row in {(i, t or "") for i, t in rows}}
    for row, w in texts.items():
        for s in range(len(w) - least + 1):
            where[" ".join(w[s : s + least])].add(row)
    for (doc_id, _), w in texts.items():
        last = None
        for s in (s for s in range(len(w) - least + 1) if len(where[" ".join(w[s : s + least])]) > 1):
            if last is not None and s <= last[1]:
                last[1] = s + least
            else:
                last = [s, s + least]
                spans.append((doc_id, last))
    return sorted(((i, *x) for i, x in spans), key=str)


def passages(table, least=50, key=10):
    return sorted(((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.shared_passages(table, least, key).collect()), key=str)


def test_shared_passages_are_those_of_the_dense_array(nasty, documents, monkeypatch):
    for table, least, key in ((nasty, 50, 10), (documents.limit(120), 50, 10), (documents.limit(60), 12, 4)):
        expected = plain_passages(pairs(table), least)
        assert expected and passages(table, least, key) == expected
    monkeypatch.setattr(suffix_dedup, "TILE", 3)  # most beginnings are dealt out in tiles
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 64)
    assert passages(table, least, key) == expected


def test_shared_passages_of_few_words_in_all_ways(spark, monkeypatch):
    """Matches that differ in where they end on either side, and rows that repeat: every partner counts."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 90), p=[0.8, 0.15, 0.05])) for _ in range(60)]
    rows = [(f"id{k % 50}", t) for k, t in enumerate(texts)] + [("id3", texts[3])] * 3 + [(None, texts[5]), (None, texts[5])]
    table = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    for least, key in ((14, 4), (9, 3), (6, 6)):
        expected = plain_passages(rows, least)
        assert len(expected) > 40
        for tile, together in ((4096, 8192), (5, 40)):
            monkeypatch.setattr(suffix_dedup, "TILE", tile)
            monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
            assert passages(table, least, key) == expected


def test_minimisers_cover_every_window():
    rng = np.random.default_rng(1)
    for window in (1, 2, 7, 41):
        keys = rng.integers(0, 30, 400).astype(np.uint64)
        assert suffix_dedup.own_minimisers(keys, window).tolist() == [i + int(np.argmin(keys[i : i + window])) for i in range(len(keys) - window + 1)]


def test_runs_depend_on_their_words_alone():
    w = words.hashes([str(k % 7) for k in range(60)])
    for n in (1, 3, 5, 10, 50):
        found = words.runs(w, n)
        assert len(found) == 61 - n
        assert all((found[i] == found[j]) == ((i - j) % 7 == 0) for i in range(len(found)) for j in range(len(found)))


def test_texts_without_matches_are_not_shuffled(spark):
    """Shared passages in two of 400 documents: the exchange of texts carries theirs and few others."""
    rows = [(k, " ".join(f"w{k}_{j}" for j in range(200))) for k in range(400)]
    shared = " ".join(f"s{j}" for j in range(60))
    rows[3], rows[9] = (3, rows[3][1] + " " + shared), (9, shared + " " + rows[9][1])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.shared_passages(table).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in found) == [(3, 200, 260), (9, 0, 60)]
    from docgrid.llm import bloom

    words = bloom.bloom(table.where("doc_id IN (3, 9)").select(suffix_dedup.F.xxhash64("doc_id", "text").alias("h")), 2)
    assert table.where(bloom.may_be_in(words, suffix_dedup.F.xxhash64("doc_id", "text"))).count() < 10


def test_one_word_a_hundred_thousand_times_is_dealt_by_place(spark):
    rows = [(1, "a " * 100_000), (2, "a " * 100_000), (3, "b " * 60)]
    found = suffix_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in found) == [(1, 0, 100_000), (2, 0, 100_000)]
