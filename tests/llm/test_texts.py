"""Packing, token counts, licenses, leaks, pages: round trips and plain searches."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docgrid.llm import decontam, html_text, licenses, packing, token_counts, words

RANKS = public_tokenizers.path(packing.VOCABULARY)
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ---- packing


def check_packing(table, tiers=packing.TIERS):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = Counter((r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect())
    ids = {k: np.array([*tokenizer.encode(k[1], add_special_tokens=False).ids, 1], "<u4") for k in texts}
    pieces, sequences, tokens = packing.pack_documents(table, RANKS, tiers).collect(), defaultdict(list), Counter()
    for p in pieces:
        sequences[p.sequence_id].append(p)
        assert any(
            k[0] == p.doc_id and len(v) == p.doc_tokens and zlib.crc32(v[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for k, v in ids.items()
        )
        tokens[p.doc_id] += p.length
    wanted = Counter()
    for k, n in texts.items():
        wanted[k[0]] += n * len(ids[k])
    assert tokens == wanted
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        size = sum(p.length for p in own)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own[:-1]]]).tolist()
        assert size <= tiers[-1] and len({p.step_group for p in own}) == 1 and {p.tier for p in own} == {next(t for t in tiers if t >= size)}
        padding += 0 if size & (size - 1) == 0 else tiers[-1] - size
    return pieces, sequences, padding


def test_packing_nasty(nasty, empty):
    check_packing(nasty)
    assert packing.pack_documents(empty, RANKS).count() == 0


def test_a_million_blanks():
    text = "a" + " " * 1_000_000 + "b\n" + "\n" * 300_000 + "c"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(text, RANKS).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_packing_pads_less_than_a_window_a_task(documents):
    table = documents.repartition(3)
    pieces, sequences, padding = check_packing(table)
    assert padding <= 3 * packing.TIERS[-1]
    for start in (p for p in pieces if p.start == 0 and p.doc_tokens >= 2048):
        assert start.length == 2048  # long documents fill windows of their own


def test_step_groups_are_alike():
    steps = packing.Steps(8 * 256, task=0)
    rng = random.Random(1)
    dealt = []
    for k in range(70):
        cut = rng.randrange(1, 256)
        window = [packing.Piece(n, 0, k, n, 0) for n in (cut, 256 - cut)]
        dealt += steps.add(k, window)
    for tier in [*steps.waiting]:
        dealt += steps.deal(tier)
    sizes = Counter(group for group, _, _ in dealt)
    assert sum(sizes.values()) == 70 and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted(n for _, n, _ in dealt) == list(range(70))


@pytest.mark.parametrize("seed", range(5))
def test_pool_gives_full_windows(seed):
    rng, pool, total = random.Random(seed), packing.Pool(), 0
    for k in range(rng.randrange(1, 60)):
        n = rng.randrange(1, 2048)
        pool.add(packing.Rest(np.zeros(n, "<u4"), 0, k, n))
        total += n
    windows = [*packing.pack(pool, packing.TIERS, last=False)]
    assert all(sum(p.length for p in w) in packing.TIERS for w in windows)
    rest = [*packing.pack(pool, packing.TIERS, last=True)]
    assert sum(p.length for w in windows + rest for p in w) == total and pool.tokens == 0
    assert sum(sum(p.length for p in w) not in packing.TIERS for w in rest) <= 1


def test_a_rest_holds_its_own_ids_alone(spark):
    """What waits of thousands of long documents is bounded by the rests, not by the documents."""
    pool, long = packing.Pool(), np.zeros(100_000, "<u4")
    rows = spark.createDataFrame([(k, "word " * 30_000) for k in range(20)], "doc_id long, text string")
    assert sum(r.length for r in packing.pack_documents(rows, RANKS).collect()) == 20 * len(packing.token_ids("word " * 30_000, RANKS))
    for k in range(1000):
        pool.add(packing.Rest(long[-700:].copy(), 99_300, k, len(long)))
    held = [r.ids for own in pool.of.values() for r in own]
    assert all(x.base is None for x in held) and sum(x.nbytes for x in held) == 1000 * 700 * 4
    assert not any(isinstance(v, np.ndarray) for v in packing.piece(held and pool.shortest()))


def test_a_million_documents_of_a_token(spark):
    import time

    pool, ids, began = packing.Pool(), np.ones(1, "<u4"), time.time()
    for k in range(1_000_000):
        pool.add(packing.Rest(ids, 0, k, 1))
    windows = sum(1 for _ in packing.pack(pool, packing.TIERS, last=True))
    assert windows >= 1_000_000 // 2048 and time.time() - began < 20


# ---- token counts


def test_token_counts(nasty, empty, documents, tmp_path):
    import sentencepiece

    model, cache = sentencepiece.SentencePieceProcessor(model_file=MODEL), str(tmp_path / "cache")
    for table in (nasty, documents, documents.limit(10), empty):
        found = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table, MODEL, cache).collect())
        rows = [(r.doc_id, r.text or "") for r in table.collect()]
        assert found == Counter((i, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096) for i, t in rows)


def test_cache_encodes_only_distinct_misses(spark, nasty, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    token_counts.count_tokens(nasty, MODEL, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r.text or "" for r in nasty.collect()})
    token_counts.count_tokens(nasty, MODEL, cache).collect()
    assert spark.read.parquet(cache).count() == stored.count()
    lied = stored.withColumn("n_tokens", F.lit(7).cast("long")).collect()
    spark.createDataFrame(lied, token_counts.CACHE_SCHEMA).write.parquet(str(tmp_path / "lied"))
    assert {r.n_tokens for r in token_counts.count_tokens(nasty, MODEL, str(tmp_path / "lied")).collect()} == {7}  # hits are not encoded
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.count_tokens(nasty, other, str(tmp_path / "lied")).where("n_tokens <> 7").count() > 0  # another tokenizer has none


def test_texts_of_misses_alone_are_shuffled(spark, tmp_path, monkeypatch):
    """On a cache of nine tenths of the contents, a tenth of the texts passes the filter; the counts are those of a cold cache."""
    cache, passed = str(tmp_path / "cache"), []
    table = spark.createDataFrame([(k, f"text {k} " * 50) for k in range(1000)] + [(None, "no id"), (3, "text 3 " * 50)], "doc_id long, text string")
    token_counts.count_tokens(table.where("doc_id % 10 <> 0"), MODEL, cache).collect()
    given = token_counts._may_be_in

    def counted(words, h):
        digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
        passed.append(table.where(given(words, F.xxhash64("doc_id", digest))).count())
        return given(words, h)

    monkeypatch.setattr(token_counts, "_may_be_in", counted)
    warm = sorted(token_counts.count_tokens(table, MODEL, cache).collect(), key=str)
    assert 101 <= passed[0] <= 110
    assert warm == sorted(token_counts.count_tokens(table, MODEL, str(tmp_path / "other")).collect(), key=str) and len(passed) == 1
    again = token_counts.count_tokens(table, MODEL, cache)  # nothing is missed
    assert sorted(again.collect(), key=str) == warm and passed[1] == 0


# ---- licenses


def plain_licenses(text, templates, least=0.8):
    found = words.WORD.findall((text or "").lower())
    out = {}
    for name, template in templates.items():
        own = words.WORD.findall(template.lower())
        if not own:
            continue
        n = min(5, len(own))
        shingles = {" ".join(own[i : i + n]) for i in range(len(own) - n + 1)}
        places = [i for i in range(len(found) - n + 1) if " ".join(found[i : i + n]) in shingles]
        best = max((len({" ".join(found[j : j + n]) for j in places if i <= j < i + len(own) - n + 1}) for i in places), default=0)
        if best / len(shingles) >= least:
            out[name] = best / len(shingles)
    return out


def test_licenses_against_a_plain_search(documents, nasty):
    for table in (documents, nasty):
        found = {(r.doc_id, r.license) for r in licenses.scan_licenses(table).collect()}
        assert found == {(r.doc_id, k) for r in table.select("doc_id", "text").collect() for k in plain_licenses(r.text, licenses.TEMPLATES)}


def test_licenses_edited_and_located(spark, empty):
    filler = " ".join(f"w{k}" for k in range(300))
    mit = licenses.TEMPLATES["MIT"]
    half = mit[: len(mit) // 2]
    table = spark.createDataFrame([(1, f"{filler} {mit} {filler}"), (2, f"{filler}\n{mit.replace('without limitation', 'with no limit').upper()}"), (3, half), (4, "short one"), (5, None)], "doc_id long, text string")
    found = {(r.doc_id, r.license): r for r in licenses.scan_licenses(table, licenses.TEMPLATES | {"two": "short one", "none": "--"}).collect()}
    assert set(found) == {(1, "MIT"), (2, "MIT"), (4, "two")}
    text = f"{filler} {mit} {filler}"
    assert text[found[1, "MIT"].start : found[1, "MIT"].end] == mit.rstrip(".")
    assert found[1, "MIT"].containment == 1 and 0.8 <= found[2, "MIT"].containment < 1
    assert licenses.scan_licenses(empty).count() == 0


def test_places_are_exact_where_letters_grow(spark):
    """\u0130 becomes two code points, and by its mark two words, when it is lowered."""
    mit, item = licenses.TEMPLATES["MIT"], "\u0130stanbul start of an item that lies in a document somewhere"
    text = f"\u0130\u0130\u0130\u0130 \u0130x {mit} \u0130 and {item} \u0130"
    table = spark.createDataFrame([("d", text)], "doc_id string, text string")
    (found,) = licenses.scan_licenses(table).collect()
    assert text[found.start : found.end] == mit.rstrip(".")
    for kind, value in (("int", 7), ("string", "seven"), ("long", 7), ("short", 7)):
        (leak,) = decontam.find_leaks(table, spark.createDataFrame([(value, item)], f"item_id {kind}, text string")).collect()
        assert leak.item_id == value and leak.doc_id == "d" and leak.n_edits == 0 and text[leak.start : leak.end] == item
    assert decontam.drop_leaks(table, spark.createDataFrame([(7, item)], "item_id int, text string")).count() == 0


def test_bands_meet_with_high_probability():
    """Passages of the least containment are found at any place of a long text."""
    rng = random.Random(0)
    template = " ".join(f"t{k}" for k in range(40))
    scanner, met, tries = licenses.Scanner({"x": template}), 0, 60
    for _ in range(tries):
        own = template.split()
        own[rng.randrange(4, 36)] = "changed"
        body = [f"f{rng.randrange(10**9)}" for _ in range(400)]
        at = rng.randrange(300)
        met += bool(scanner.find(words.hashes(body[:at] + own + body[at:])))
    assert met >= 0.98 * tries


@pytest.mark.parametrize("place", ["start", "middle", "end"])
@pytest.mark.parametrize("n_words", range(1, 9))
def test_short_templates_are_always_found(n_words, place):
    """Templates of one to four shingles, also of fewer than five words, anywhere in a long text."""
    rng = random.Random(f"{n_words} {place}")
    for _ in range(200):
        template = [f"t{rng.randrange(10**9)}" for _ in range(n_words)]
        body = [f"f{rng.randrange(10**9)}" for _ in range(200)]
        at = {"start": 0, "middle": rng.randrange(1, 200), "end": 200}[place]
        found = licenses.Scanner({"x": " ".join(template)}).find(words.hashes(body[:at] + template + body[at:]))
        assert found == [("x", 1.0, at, at + n_words)]


def test_templates_that_repeat_themselves_are_found():
    body = [f"f{k}" for k in range(200)]
    for at in (0, 90, 200):
        for k in range(40):
            template = [f"a{k}"] * 30
            found = licenses.Scanner({"x": " ".join(template)}).find(words.hashes(body[:at] + template + body[at:]))
            assert [f[:2] for f in found] == [("x", 1.0)]


# ---- benchmark leaks


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def nearest(item, part):
    return min(edits(item, part[i:j]) for i in range(len(part) + 1) for j in range(i, len(part) + 1))


def test_passage_distance_is_exact():
    rng = random.Random(2)
    for _ in range(60):
        item, part = ([rng.randrange(4) for _ in range(rng.randrange(1, n))] for n in (7, 10))
        found, a, b = decontam.passage_distance(np.array(item, np.uint64), np.array(part, np.uint64))
        assert found == nearest(item, part) == edits(item, part[a:b])


def test_leaks_reach_recall_and_are_exact():
    """Edited passages of at most the allowed edits are found; what is reported is within them."""
    rng = random.Random(7)
    vocabulary = [f"v{k}" for k in range(400)] + ["the", "of", "and"] * 60
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12, 60)))) for k in range(40)]
    matcher = decontam.Matcher(items)
    texts, planted = [], []
    for n in range(200):
        k = rng.randrange(40)
        passage = items[k][1].split()
        for _ in range(decontam.edits_allowed(len(passage)) if n % 2 else 1):
            at, kind = rng.randrange(len(passage)), rng.randrange(3)
            passage[at : at + (kind != 1)] = [] if kind == 2 else ["new"]
        before, after = ([rng.choice(vocabulary) for _ in range(rng.randrange(80))] for _ in range(2))
        texts.append(words.hashes(before + passage + after))
        planted.append((n, k))
    found = {(d, k): (e, a, b) for d, k, e, a, b in matcher.matches(texts)}
    assert len(set(planted) & set(found)) >= 0.95 * len(planted)
    for (d, k), (e, a, b) in found.items():
        item = matcher.items[k][1]
        assert e <= decontam.edits_allowed(len(item)) and e == edits(item.tolist(), texts[d][a:b].tolist())


@pytest.mark.parametrize("filtered", [True, False])
@pytest.mark.parametrize("n", [5, 12, 25, 50, 51, 59, 75, 100, 150, 200, 300])
@pytest.mark.parametrize("kind", ["substitutions", "insertions", "deletions"])
def test_leaks_reach_recall_at_all_lengths(n, kind, filtered, monkeypatch):
    """Items of any length are found at exactly the allowed edits, of one kind; also where every window is walked."""
    if not filtered:
        every = lambda self, words: {m: np.arange(1 - m, len(words)) for m in self.tables}
        monkeypatch.setattr(decontam.Matcher, "windows", every)
    rng, tries = random.Random(f"{n} {kind}"), 40
    word = lambda: f"w{rng.randrange(20000)}"
    items = [[word() for _ in range(n)] for _ in range(tries)]
    texts = []
    for item in items:
        passage, most = list(item), decontam.edits_allowed(n)
        if kind == "insertions":
            for _ in range(most):
                passage.insert(rng.randrange(1, len(passage)), word())
        else:
            for at in sorted(rng.sample(range(n), most), reverse=True):
                passage[at : at + 1] = [word()] if kind == "substitutions" else []
        before, after = ([word() for _ in range(rng.randrange(80))] for _ in range(2))
        texts.append(words.hashes(before + passage + after))
    found = {(d, k) for d, k, *_ in decontam.Matcher([(k, " ".join(x)) for k, x in enumerate(items)]).matches(texts)}
    assert len(found & {(k, k) for k in range(tries)}) >= 0.95 * tries


def test_leaks_in_documents(spark, documents, benchmark, nasty, empty):
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(documents, benchmark).collect()}
    norm = lambda t: f" {' '.join(words.WORD.findall(t.lower()))} "
    items = [(r.item_id, norm(r.text)) for r in benchmark.collect()]
    exact = {(r.doc_id, i) for r in documents.collect() for i, t in items if t in norm(r.text)}
    assert exact <= found
    left = decontam.drop_leaks(documents, benchmark)
    assert left.columns == documents.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in documents.collect()} - {d for d, _ in found}
    odd = spark.createDataFrame([(None, "repeated row with a text"), (7, None), (8, ""), (9, "..."), (None, "x")], "item_id long, text string")
    pairs = Counter((r.doc_id, r.item_id) for r in decontam.find_leaks(nasty, odd).collect())
    assert pairs == Counter({(8, None): 2, (14, None): 1})
    assert decontam.find_leaks(empty, benchmark).count() == decontam.find_leaks(nasty, benchmark.limit(0)).count() == 0
    assert decontam.drop_leaks(nasty, benchmark.limit(0)).count() == nasty.count()


def test_items_in_blocks_give_the_same(documents, benchmark, monkeypatch):
    whole = sorted(decontam.find_leaks(documents, benchmark).collect())
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 3000)
    assert sorted(decontam.find_leaks(documents, benchmark).collect()) == whole


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog, and more things to read here</a></li></ul></nav></header>
<div id="cookie-notice"><p>We use cookies, many cookies, on this fine site, and you accept them all.</p></div>
<div class="wrap"><div class="content"><h1>The  title&amp; more</h1>
<p>First paragraph, with <b>bold</b>,
 and   some commas, and quite enough words to count as text.<p>Second one isn&#39;t closed, but it is long enough, too, to count as a paragraph.
<ul><li>point one<li>point two</ul><p>Short.</p><form><p>Name, address, and other things that one fills in, here.</p><input></form>
<blockquote>Quoted&nbsp;words, which belong to the article, of course.</blockquote></div>
<div class="sidebar"><p>Sidebar text, that goes on for a while, and a while more, to look like text.</p></div>
<div class="comments"><div class="comment-body"><p>I think, dear author, that this is wrong, and long, and more.</p></div></div></div>
<footer><p>Copyright, rights, and some other long legal text, as always.</p></footer></body></html>"""


def test_article_of_a_page():
    assert html_text.main_text(PAGE).split("\n\n") == [
        "The title& more", "First paragraph, with bold, and some commas, and quite enough words to count as text.",
        "Second one isn't closed, but it is long enough, too, to count as a paragraph.", "point one", "point two", "Short.",
        "Quoted words, which belong to the article, of course.",
    ]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<article><h1>T</h1><p><b>x.<br><p>y</p></article><footer>f</footer>", "T\n\nx.\n\ny"),
        ("<body><nav>menu</nav><p>one</p><script>x</script><p>two &lt;3", "one\n\ntwo <3"), ("<div><!-- c --><p>cut <i>off", "cut off"), ("</p></div>stray", "stray"),
        ("<article><p>" + "word, " * 200 + "</p><p>tail</p></article>", ("word, " * 200).strip() + "\n\ntail"), ("<script>only();</script>", ""),
    ],
)
def test_small_pages(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    "html",
    [
        '<div class="comments"><div class="comment-body"><p>I think, dear author, that this is wrong, and long, and more.</p></div></div>',
        '<div id="cookie-banner"><p>We use cookies, many.</p></div>', "<nav><ul><li><a href=x>Home</a></ul></nav><footer><p>All rights, and lefts, reserved by us.</p></footer>",
        '<section class="comments"><article class="comment"><p>No, no, and again no, this is a long comment.</p></article></section>', "<aside><p>Beside, the point, and long enough to be text.</p></aside>",
    ],
)
def test_pages_of_excluded_parts_alone_are_empty(html):
    assert html_text.main_text(f"<html><body>{html}</body></html>") == html_text.main_text(html) == ""


def test_articles_go_on_beside_each_other():
    one, two = ("Some words, and more words, of the article, which are many, and go on. " * 4).strip(), ("The second part, shorter, of the article. " * 2).strip()
    page = f"<body><div><h1>Head</h1><article><p>{one}</p></article><article><p>{two}</p></article></div><div class=related><p>Other things, to read, and read, and read.</p></div></body>"
    assert html_text.main_text(page) == f"Head\n\n{one}\n\n{two}"
    sources = "<ul><li><a href=a>First source</a><li><a href=b>Second source</a><li><a href=c>Third source</a></ul>"
    assert html_text.main_text(f"<article><p>{one}</p>{sources}</article>") == f"{one}\n\nFirst source\n\nSecond source\n\nThird source"
    assert html_text.main_text(f"<article><p>{one}</p>{sources.replace('<ul', '<ul class=related-posts')}</article>") == one
    assert html_text.main_text(f"<body><p>{one}</p><p>{two}</p>{sources}</body>") == f"{one}\n\n{two}"


def test_a_wrapper_is_not_left_out_for_its_name_alone():
    page = '<div class="sidebar-left"><main><p>Some text, that is the article.</p></main><div class="sidebar"><p>Beside the point, and long enough to be text.</p></div></div>'
    assert html_text.main_text(page) == "Some text, that is the article."


@pytest.mark.parametrize("part", ["<b>", "<div>", "<div><p>word, ", "<a href=x>y", "<ul><li>x", "</p>", "<", "<!--", '<a href="', "</", "<?", "<![CDATA["])
def test_odd_pages_take_linear_time(part):
    import time

    began = time.time()
    html_text.main_text(part * (100_000 if len(part) < 12 else 50_000))
    assert time.time() - began < 25


def plain_article(tree):
    """The rules of the docstring by plain recursion over (tag, class, children or text), on well-formed trees."""
    above, own, order = {}, {}, []

    def walk(node, parent):
        above[id(node)] = parent
        order.append(node)
        own[id(node)] = node[2] if isinstance(node[2], str) else ""
        for child in [] if isinstance(node[2], str) else node[2]:
            walk(child, node)

    walk(tree, None)
    junk = lambda n: n is not None and (n[0] in ("nav", "footer") or n[1] in ("sidebar", "comments") or junk(above[id(n)]))
    texts = [(n, own[id(n)]) for n in order if own[id(n)] and not junk(n)]
    below = lambda n: [(m, t) for m, t in texts if any(x is n for x in line(m))]

    def line(n):
        return [] if n is None else [n, *line(above[id(n)])]

    points = defaultdict(float)
    for n, t in texts:
        if len(t) >= 25:
            for level, x in enumerate(line(n if n[0] in ("div", "section", "body") else above[id(n)])[:4]):
                points[id(x)] += (1 + t.count(",") + min(len(t) / 100, 3)) / (level + 1)
    candidates = [n for n in sorted((x for x in order if id(x) in points), key=lambda x: [id(y) for y in first_seen(order, texts, line)].index(id(x)))]
    if not candidates:
        return "\n\n".join(t for _, t in texts)
    best = max(candidates, key=lambda n: points[id(n)])
    while above[id(best)] and above[id(best)][0] != "body" and points[id(above[id(best)])] >= 0.7 * points[id(best)]:
        best = above[id(best)]
    kept = [best]
    for x in above[id(best)][2] if above[id(best)] else []:
        chars = sum(len(t) for _, t in below(x))
        share = points[id(x)] + (0.2 * points[id(best)] if x[1] and x[1] == best[1] else 0)
        if x is not best and not junk(x) and (share >= max(10, 0.2 * points[id(best)]) or x[0] == "section" and points[id(x)] >= 0.2 * points[id(best)] or x[0] == "p" and chars or x[0] == "h2" and chars and best[0] == "section"):
            kept.append(x)
    return "\n\n".join(t for n, t in texts if any(x is k for x in line(n) for k in kept))


def first_seen(order, texts, line):
    """Elements in the order in which paragraphs pass points to them."""
    seen = []
    for n, t in texts:
        if len(t) >= 25:
            for x in line(n if n[0] in ("div", "section", "body") else line(n)[1])[:4]:
                if not any(x is y for y in seen):
                    seen.append(x)
    return seen


def test_articles_against_a_plain_scorer():
    rng = random.Random(4)

    def words(n):
        return " ".join(rng.choice(["word", "text,", "and", "more,"]) for _ in range(n))

    def tree(depth, tag="div"):
        if depth == 0 or rng.random() < 0.2:
            return (rng.choice(["p", "p", "h2"]), "", words(rng.randrange(1, 60)))
        return (tag, rng.choice(["", "", "x", "y", "sidebar", "comments"]), [tree(depth - 1, rng.choice(["div", "section", "nav", "footer"])) for _ in range(rng.randrange(1, 4))])

    def html(node):
        return f"<{node[0]} class='{node[1]}'>{node[2] if isinstance(node[2], str) else ''.join(map(html, node[2]))}</{node[0]}>"

    for _ in range(300):
        page = ("body", "", [tree(rng.randrange(5)) for _ in range(rng.randrange(1, 5))])
        assert html_text.main_text(html(page)) == plain_article(page)


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (None, "v", "", 0), (1, "u", PAGE, 0)], "page_id long, url string, html string, text int")
    rows = html_text.extract_pages(pages).collect()
    assert Counter((r.page_id, r.url, r.n_chars) for r in rows) == Counter({(1, "u", len(html_text.main_text(PAGE))): 2, (2, None, 0): 1, (None, "v", 0): 1})
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_given_pages(spark):
    """Every paragraph of the given pages' articles comes out; nothing of their menus, adverts and footers does."""
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        text = html_text.main_text(row.html)
        article = row.html.split("<article>")[1].split("</article>")[0]
        import html as h
        import re

        blocks = [" ".join(h.unescape(re.sub(r"<br>|<b>|</b>", " " if "<br>" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert text.split("\n\n") == [b for b in blocks if b]


@pytest.mark.parametrize(("name", "kept"), [("alert-system", True), ("menuPlanning intro", True), ("notice-of-sale", True), ("alert", False), ("alert-box-2", False), ("site-notice", False), ("menu-header", False), ("alert alert-info", False), ("ad-system", False)])
def test_names_of_what_an_article_is_about_leave_nothing_out(name, kept):
    one, two = "An introduction to the article, which is long enough.", "What is described here, in an element with a name of its own."
    for inner in (f'<div class="{name}"><p>{two}</p></div>', f'<section><div id="{name}"><p>{two}</p></div></section>'):
        assert html_text.main_text(f"<article><p>{one}</p>{inner}</article>") == (f"{one}\n\n{two}" if kept else one)
    if " " not in name:  # outside of an article names count as ever
        assert html_text.main_text(f'<body><div><p>{one}</p></div><div class="{name}"><p>{two}</p></div></body>') == one


@pytest.mark.parametrize("n", [99, 1000])
def test_any_number_of_declarations_without_an_end(n):
    found = html_text.main_text("<article>" + "<p>see <![if n of the listing</p>" * n + "<p>This is a real paragraph, with enough text.</p></article>")
    assert found == "\n\n".join(["see"] * n + ["This is a real paragraph, with enough text."])


@pytest.mark.parametrize("n", [1, 300])
def test_any_number_of_tags_whose_quote_is_never_closed(n):
    text = "Text of a paragraph, which is long enough."
    assert html_text.main_text("<article>" + f"<p class='x>{text}</p>" + f"<p>{text}</p>" * n + "</article>") == "\n\n".join([text] * (n + 1))


def test_a_page_that_is_cut_off_in_a_tag_ends_there():
    assert html_text.main_text("<article><p>Text of a paragraph, 1 < 2, <a href='x") == "Text of a paragraph, 1 < 2,"


def test_a_reading_list_between_paragraphs_stays():
    one, two = "First paragraph of the text, which is long enough.", "Last paragraph of the text, which is long enough."
    links = lambda name: "<ul>" + "".join(f"<li><a href=x>{name} {k}</a></li>" for k in range(4)) + "</ul>"
    assert html_text.main_text(f"<body><div>{links('menu')}<p>{one}</p>{links('book')}<p>{two}</p>{links('more')}</div></body>") == "\n\n".join([one, *(f"book {k}" for k in range(4)), two])


@pytest.mark.parametrize("part", ["</", '<a b="', "<a b=\"x\"><a b='x>", "<![if ", "<p>see <![if n</p>", "<a b='\"> <c d=\"'>", "<a b=\"x\"><i c='>"])
def test_broken_markup_takes_linear_time(part):
    import time

    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        html_text.main_text("<body><p>Text that comes first, and is long.</p>" + part * n + "<p d=\"> and last</p>")
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_license_bands_are_looked_up_whatever_the_number_of_templates():
    import time

    rng = np.random.default_rng(2)
    text = words.hashes([f"w{x}" for x in rng.integers(0, 5000, 2000)])
    took = []
    for n in (13, 1300):
        scanner = licenses.Scanner({f"t{k}": " ".join(f"v{x}" for x in rng.integers(0, 9000, 120)) for k in range(n)})
        scanner.find(text)
        began = time.process_time()
        for _ in range(20):
            scanner.find(text)
        took.append(time.process_time() - began)
    assert took[1] < 2 * took[0] + 0.05


def test_pairs_of_documents_and_items_match_plain_edit_distances(spark):
    """A table with edited passages of several lengths, in blocks of few parts: the set of pairs, by plain distances of all."""
    rng = np.random.default_rng(8)
    items = [(k, [f"i{k}_{j}" for j in range(n)]) for k, n in enumerate((5, 6, 9, 14, 30, 70, 130))]
    docs = []
    for d in range(60):
        k, passage = items[d % len(items)]
        passage = list(passage)
        for _ in range(int(rng.integers(0, len(passage) // 4 + 2))):
            at, way = int(rng.integers(0, len(passage))), rng.integers(0, 3)
            passage[at : at + (way < 2)] = [] if way == 0 and len(passage) > 1 else [f"x{rng.integers(0, 9)}"]
        docs.append((d, " ".join([f"l{d}_{j}" for j in range(int(rng.integers(0, 40)))] + passage + [f"r{d}_{j}" for j in range(int(rng.integers(0, 40)))])))

    def nearest(item, text):
        row = [0] * (len(text) + 1)
        for k, word in enumerate(item, 1):
            new = [k]
            for j, other in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (word != other)))
            row = new
        return min(row)

    wanted = {(d, k) for d, text in docs for k, item in items if nearest(item, text.split()) <= decontam.edits_allowed(len(item))}
    old, decontam.BLOCK_PARTS = decontam.BLOCK_PARTS, 3
    try:
        found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")).collect()
    finally:
        decontam.BLOCK_PARTS = old
    assert {(r.doc_id, r.item_id) for r in found} <= wanted and len(found) == len({(r.doc_id, r.item_id) for r in found})
    assert len(found) >= 0.95 * len(wanted) > 30
