"""Main text of web pages by tree scoring.

A page becomes a tree of elements and, at its block elements, blocks of text. Paragraphs pass points for their
length and their commas to their ancestors, halved and so on with the distance; a container's points are
discounted by its link density. The best container, and those of its siblings that score near it or read like
its paragraphs, are the article; all their blocks come out, in page order. Subtrees that can't be article text
(scripts, styles, forms, menus, page headers and footers, sidebars, notices, adverts, reader comments; by element,
role or the words of class and id) are left out first; a page that has nothing else gives "". Names are made of words:
inside an article an alert-box is left out, an alert-system is not. Inside an article no
list of links is dropped that isn't called a menu or the like. The time is linear in the page at any depth of tags.

Nulls: a null page is empty; a page without text gives "". Broken markup is read as browsers do in the common
cases (open paragraphs and list items end at the next, stray end tags are ignored, a declaration ends at the next >,
a page that is cut off within a tag ends there; a tag whose quote is never closed ends at the next >).
Whole pages are read; url and page_id may be null or repeat. Other columns are not looked at.
"""

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
NEVER = frozenset("script style noscript template head title svg math iframe object canvas audio video form button select option textarea input label nav aside footer dialog menu".split())
#: An open element of the key ends where one of the values begins inside the same parent.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div body main blockquote td th".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar "
    "comment comments disqus reply replies respond responses share sharing social related recommended recommendations widget widgets".split()
)
ARTICLE = frozenset("article content main post entry story".split())
#: Words that say article even beside a word of JUNK, unless it is one of these.
ALWAYS = frozenset("ad ads advert adverts advertisement sponsored promo cookie cookies consent sidebar comment comments disqus reply replies footer nav navbar menu newsletter related share social popup modal".split())
#: Words of JUNK that, inside an article, may also begin the name of what it is about (alert-system, menu-planning):
#: there they count where only words of SHAPES, single signs or other words of JUNK follow in the same name.
SUBJECTS = frozenset("alert aside banner header login menu notice notices promotion rail subscription".split())
SHAPES = frozenset(
    "area bar block board body bottom box btn button card col column container content danger dialog error field fixed form global grid group head holder icon image img info inner item items "
    "large layer left link links list main message messages outer page panel primary right row secondary section site slot small sticky strip success table text title top unit warning wrap wrapper zone".split()
)
#: Names say nothing of these.
KEEP = frozenset("html body main".split())
#: What makes an article element one that isn't the article.
ASIDE = frozenset("ad ads advert adverts advertisement sponsored promo comment comments reply replies response responses related recommended".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")
#: A paragraph has at least so many code points.
LEAST_CHARS = 25
TAG = re.compile(r"[^\s/>]+")
#: A quote that opens an attribute's value, any quote, and what begins like a tag.
OPENED, QUOTE, OPENER = re.compile(r"""=\s*["']"""), re.compile(r"""["']"""), re.compile(r"<[a-zA-Z/!?]")
#: How an element is left out: not, by the words of its class and id, by what it is.
NOT, BY_NAME, BY_KIND = range(3)
#: Open elements of the values end where one of the key begins inside the same parent.
CLOSES = {tag: [x for x, ends in ENDS.items() if tag in ends] for tag in {t for ends in ENDS.values() for t in ends}}


class Node:
    __slots__ = ("tag", "parent", "bad", "names", "in_link", "junk", "holds", "points", "chars", "linked", "links", "children")

    def __init__(self, tag: str, parent: "Node | None", bad: int, names: str) -> None:
        self.tag, self.parent, self.bad, self.names = tag, parent, bad, names
        self.in_link = tag == "a" or parent is not None and parent.in_link
        self.junk = self.holds = False
        self.points, self.chars, self.linked, self.links = 0.0, 0, 0, int(tag == "a")
        self.children: list[Node] = []
        if parent is not None:
            parent.children.append(self)

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0

    def above(self) -> Iterator["Node"]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


def _verdict(tag: str, attrs: list, inside_article: bool) -> tuple[int, str]:
    names, bad = "", BY_KIND if tag in NEVER or (tag == "header" and not inside_article) else NOT
    for key, value in attrs:
        if key in ("class", "id"):
            names += f" {value}" if value else ""
        elif key == "hidden" or (key == "role" and (value or "").lower() in ROLES) or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in (value or "").replace(" ", "")):
            bad = BY_KIND
    if names and not bad and tag not in KEEP:
        named = [[w.lower() for w in NAME.findall(name)] for name in names.split()]
        words = [w for name in named for w in name]
        subjects = {w for name in named for k, w in enumerate(name) if w in SUBJECTS and not all(x in SHAPES or x in JUNK or len(x) == 1 or x.isdigit() for x in name[k + 1 :])} if inside_article else set()
        found = {w for k, w in enumerate(words) if w in JUNK and w not in subjects and not (k and words[k - 1] in ("no", "has", "with", "without"))}
        if tag == "article":
            bad = BY_NAME if found & ASIDE and not ARTICLE & set(words) else NOT
        elif found and (found & ALWAYS or not ARTICLE & set(words)):
            bad = BY_NAME
    return bad, names


class Ends:
    """Where tags never end in a page: for each quote that opens a value, whether what follows ever comes to a > outside of quotes."""

    def __init__(self, of: str) -> None:
        self.of = of
        self.opens = [m.end() - 1 for m in OPENED.finditer(of)]
        self.endless = [False] * (len(self.opens) + 1)
        closing, last = {}, {'"': -1, "'": -1}
        for m in reversed(list(QUOTE.finditer(of))):
            closing[m.start()], last[m[0]] = last[m[0]], m.start()
        for k in range(len(self.opens) - 1, -1, -1):
            end = closing[self.opens[k]]
            self.endless[k] = end < 0 or self.never(end + 1)

    def never(self, i: int) -> bool:
        """Whether a tag whose rest begins at i (outside of quotes) has no end."""
        k = bisect_left(self.opens, i)
        if k == len(self.opens):
            return self.of.find(">", i) < 0
        return self.endless[k] and self.of.find(">", i, self.opens[k]) < 0


class Tree(HTMLParser):
    """Elements in page order (a parent before its children) and, at block elements, pieces of text.

    The open elements' places are kept by tag and by kind, so that each tag costs the same at any depth.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root", None, NOT, "")
        self.nodes, self.open = [self.root], [self.root]
        self.blocks: list[tuple[Node, list[tuple[Node, str]]]] = []
        self.pieces: list[tuple[Node, str]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.endless_comment = False
        self.ends: Ends | None = None
        kinds = {"block": BLOCK, "scope": SCOPES, "outer": SCOPES - {"td", "th"}, "barrier": {"article", "body", "table"}, "article": {"article", "main"}}
        self.kinds_of = {t: [k for k, tags in kinds.items() if t in tags] for t in BLOCK | SCOPES}

    def parse_comment(self, i: int, report: bool = True) -> int:
        """Once a comment has no end, no later one has."""
        found = -1 if self.endless_comment else super().parse_comment(i, report)
        self.endless_comment = found < 0
        return found

    def parse_html_declaration(self, i: int) -> int:
        """As browsers do: any declaration, marked sections included, ends at the next >."""
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self.rawdata.find(">", i + 2) + 1 or -1

    def parse_starttag(self, i: int) -> int:
        """A tag that never ends, as a quote in it is never closed, ends at the next > and has no attributes.

        Once there is one, others are known by the places of quotes, so none is looked for up to the page's end.
        """
        found = -1 if self.ends is not None and self.ends.of is self.rawdata and self.ends.never(i) else super().parse_starttag(i)
        if found >= 0:
            return found
        if self.ends is None or self.ends.of is not self.rawdata:
            self.ends = Ends(self.rawdata)
        tag = TAG.match(self.rawdata, i + 1)[0].lower()
        self.handle_starttag(tag, [])
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def last(self, name: str) -> int:
        """The place of the innermost open element of a tag or (with a colon before) of a kind; 0 for none."""
        places = self.places.get(name)
        return places[-1] if places else 0

    def end_block(self) -> None:
        if self.pieces:
            self.blocks.append((self.open[self.last(":block")], self.pieces))
            self.pieces = []

    def close_from(self, at: int) -> None:
        if self.last(":block") >= at:
            self.end_block()
        for x in self.open[at:]:
            for name in (x.tag, *[f":{k}" for k in self.kinds_of.get(x.tag, ())]):
                self.places[name].pop()
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br" or tag in ("td", "th"):
            self.pieces.append((self.open[-1], " "))
        if tag in BLOCK:
            self.end_block()
            if self.last("p") > self.last(":scope"):
                self.close_from(self.last("p"))
        ended = [at for at in map(self.last, CLOSES.get(tag, ())) if at > self.last(":outer")]
        if ended:
            self.close_from(min(ended))
        if tag == "a" and self.last("a"):
            self.close_from(self.last("a"))
        if tag in VOID:
            return
        parent = self.open[-1]
        bad, names = (BY_KIND, "") if parent.bad == BY_KIND else _verdict(tag, attrs, bool(self.last(":article")))
        node = Node(tag, parent, bad, names)
        for name in (tag, *[f":{k}" for k in self.kinds_of.get(tag, ())]):
            self.places[name].append(len(self.open))
        self.nodes.append(node)
        self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        at = self.last(tag)
        if at and (tag in BLOCK or at >= self.last(":barrier")):
            self.close_from(at)

    def handle_data(self, data: str) -> None:
        if self.open[-1].bad != BY_KIND:
            self.pieces.append((self.open[-1], data))


def _blocks(tree: Tree) -> list[tuple[Node, str, int]]:
    """(element, text, linked code points) of what isn't left out, in page order; sums are passed up to all ancestors.

    An element that only its names speak against is kept if it holds the page's article or main element.
    """
    for x in reversed(tree.nodes[1:]):
        x.parent.holds |= x.holds or x.tag == "main" or x.tag == "article" and not x.bad
        x.parent.links += x.links
    for x in tree.nodes[1:]:
        x.junk = x.parent.junk or x.bad == BY_KIND or x.bad == BY_NAME and not x.holds
    out = []
    for node, pieces in tree.blocks:
        own = [(x, data) for x, data in pieces if not x.junk]
        text = SPACE.sub(" ", "".join(data for _, data in own)).strip()
        if text and not node.junk:
            linked = min(sum(len(data.strip()) for x, data in own if x.in_link), len(text))
            out.append((node, text, linked))
            node.chars += len(text)
            node.linked += linked
    for x in reversed(tree.nodes[1:]):
        x.parent.chars += x.chars
        x.parent.linked += x.linked
    return out


def _score(blocks: list[tuple[Node, str, int]]) -> list[Node]:
    """Points of all candidates, which are returned."""
    scored: dict[int, Node] = {}
    for node, text, linked in blocks:
        if len(text) < LEAST_CHARS or (node.tag in HEADINGS or node.tag == "li") and linked * 2 > len(text):
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        start = node if node.tag in ("div", "article", "section", "main", "body") else node.parent
        for level, x in enumerate([start, *islice(start.above(), 3)] if start else []):
            if x.tag in ("html", "root"):
                break
            x.points += points / (level + 1)
            scored[id(x)] = x
    for x in scored.values():
        x.points *= 1 - x.density()
    return list(scored.values())


def _chosen(blocks: list[tuple[Node, str, int]]) -> list[Node]:
    candidates = _score(blocks)
    if not candidates:
        return []
    best = max(candidates, key=lambda x: x.points)
    while best.parent is not None and best.parent.tag not in ("body", "html", "root") and best.parent.points >= 0.7 * best.points:
        best = best.parent
    for x in best.above():  # the whole of the article that it stands in
        if x.tag in ("article", "main"):
            best = x
            break
    return [best, *(x for x in (best.parent.children if best.parent is not None and best.tag != "body" else []) if x is not best and not x.junk and _goes_along(x, best))]


def _goes_along(x: Node, best: Node) -> bool:
    """Whether a sibling of the best container is a part of the article: it scores near it, reads like its paragraphs,
    goes on with it in an element of the same kind, or is its headline."""
    share = x.points + (0.2 * best.points if x.names and x.names == best.names else 0)
    if share >= max(10, 0.2 * best.points) or x.tag in ("article", "section") and x.points >= 0.2 * best.points > 0 and x.density() < 0.25:
        return True
    if x.tag == "p":
        return x.chars > 80 and x.density() < 0.25 or 0 < x.chars <= 80 and not x.linked
    return x.tag in HEADINGS and x.chars > 0 and not x.linked and best.tag in ("article", "section")


def _list_of_links(node: Node) -> bool:
    return node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.links > 2 and node.density() > 0.6


def main_text(html: str) -> str:
    """The article's blocks, joined by two line ends; empty where there is nothing but what is left out."""
    tree = Tree()
    # nothing after the last > is a whole tag: the page is cut off in what begins like one
    cut = OPENER.search(html, html.rfind(">") + 1)
    tree.feed(html[: cut.start()] if cut else html)
    tree.close()
    tree.end_block()
    blocks = _blocks(tree)
    kept = {id(x) for x in _chosen(blocks)} or {id(x) for x in tree.nodes if x.tag in ("article", "main") and x.chars} or {id(tree.root)}
    held: dict[int, bool] = {}
    for x in tree.nodes:
        held[id(x)] = id(x) in kept or x.parent is not None and held[id(x.parent)]
    # a list of links between paragraphs belongs to them; one before the first or after the last is a menu or the like
    read = [k for k, (node, text, linked) in enumerate(blocks) if held[id(node)] and len(text) >= LEAST_CHARS and node.tag not in HEADINGS and 2 * linked <= len(text)]
    between: set[int] = set()
    for node, _, _ in blocks[read[0] : read[-1]] if read else []:
        for x in (node, *node.above()):
            if id(x) in between:
                break
            between.add(id(x))
    # inside: not in what is kept, in a container whose outer lists of links go, in an article, of which all stays
    inside: dict[int, int] = {}
    for x in tree.nodes:
        state = inside[id(x.parent)] if x.parent is not None else 0
        if id(x) in kept:
            state = 1
        if state and (x.tag in ("article", "main") or x.names and ARTICLE & {w.lower() for w in NAME.findall(x.names)}):
            state = 2
        inside[id(x)] = 0 if state == 1 and _list_of_links(x) and id(x) not in kept and id(x) not in between else state
    return "\n\n".join(text for node, text, _ in blocks if inside[id(node)])


def extract_pages(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text, n_chars. A map over pages without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    out = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
