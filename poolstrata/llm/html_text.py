"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: block elements are inner nodes, runs of text between block boundaries are leaves. Every node is
content or not. Node potentials come from features (tag, words of class and id, length, link share, ending), pair potentials
join a node to its parent. Sum-product messages go up to the root and down again; leaves whose marginal is content make
the text, in page order.

Potentials are counted (with add-one smoothing) on labelled pages: those of the table that mark their article
themselves, a sample of at most ``SAMPLE`` drawn by hash, each also with its telling tags turned to plain ones, so that
pages without such tags are covered; and ``EXAMPLES``, written and labelled by hand, for what a table may lack.

Defined cases: a null or empty page gives empty text; markup that never closes is closed at the page's end; text outside
any element is a leaf of the root; scripts, styles, frames, controls, comments, the head and what aria-hidden marks are
never text; blocks that other attributes hide are parts like others, with a feature that says so; other fallbacks (noscript, object, svg and so on) are; repeated rows each get a row. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SAMPLE = 1500
EXAMPLE_WEIGHT = 5
STRENGTH = 0.45  # of node features against pair potentials

# fixed values: element kinds of HTML
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style iframe annotation annotation-xml select option button textarea input head title".split())
RAW = frozenset("script style textarea title iframe".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
SCOPE = frozenset("ul ol table dl body html article section div td th blockquote main aside nav form".split())
CELLS = frozenset("td th tr".split())
TELLING = frozenset("article main nav header footer aside form section".split())
# fixed values: words of class and id names that say what a part of a page is for
ASIDE_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs bar comment comments cookie cookies consent copyright discussion disqus footer foot form gdpr header head login masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing side sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets alert modal links".split())
#: Words that may stand beside those in one name without changing what it says ("cookie-box"); beside others they may mean something else ("share-price").
PART_WORDS = frozenset("area bottom box block btn button card cards center col column container desktop group holder icon icons inner item items large left line list lists meta mobile module my outer page panel part posts right row section site small text title top unit wrap wrapper".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main maincontent post postcontent story text prose".split())

TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[a-zA-Z/!?][^>]*$", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"hidden|display\s*:\s*none", re.I)  # what attributes that hide an element hold
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
WORD = re.compile(r"[a-zA-Z]+")
REGION = TELLING | frozenset("div table center dialog details fieldset menu".split())
TOP = frozenset("#root html body".split())
LABEL = re.compile(r"(?:^|\s)data-label=\"([01])\"")

# fixed values: hand-labelled pages; data-label marks a part, and parts within it unless they say otherwise
EXAMPLES = (
    '<html><head><title>t</title></head><body data-label="0"><div id="page"><header class="site-header"><a href="/">Home</a> <a href="/a">About us</a></header><nav class="menu"><ul><li><a href="/1">News</a></li><li><a href="/2">Sport</a></li></ul></nav><div class="cookie-notice"><p>We use cookies to make this site work better for you.</p><button>OK</button></div><div class="content" data-label="1"><h1>A title of the story</h1><p>The first paragraph of the story tells what happened, where and when it did.</p><p>Short one.</p><ul><li>One point of the list in the story</li><li>Another point</li></ul><blockquote><p>What somebody said about it at length.</p></blockquote></div><aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Another story that you may like</a></li></ul></aside><div id="comments" data-label="0"><h3>Comments</h3><div class="comment"><p>I do not agree with the writer of this at all, and here is why.</p></div><form action="/c"><label>Your name</label><input name="n"><p>Leave a reply</p></form></div><footer><p>Copyright 2020 The Site. All rights reserved.</p></footer></div></body></html>',
    '<body data-label="0"><div class="container"><div class="row"><div id="header"><h2>The Site</h2><p>Words that matter to all of us, every day of the week.</p></div><div id="main" data-label="1"><h2>On rivers</h2><p>Rivers carry water from hills to the sea, and with it much that lives there.</p><p>Some are long.</p><table><tr><td>Length</td><td>Six hundred miles</td></tr></table><div class="ad" data-label="0"><p>Buy two, get one free, today only in our shop.</p></div><p>Others are short, and fall steeply.</p></div><div id="sidebar"><div class="widget"><h4>Popular</h4><p>What people read most in this week of the year.</p></div></div><form class="newsletter"><p>Sign up for our newsletter and never miss a story.</p></form><div id="footer"><p>Contact</p><p>Terms and privacy</p></div></div></div></body>',
    '<body data-label="0"><div class="wrap"><div class="navbar"><a href="/">Start</a><a href="/x">More</a></div><main data-label="1"><section><h1>How to bake</h1><p>Take flour, water and salt; mix them and let them rest for a night.</p><ol><li>Heat the oven.</li><li>Bake for an hour.</li></ol><pre>220 C</pre></section><section class="share" data-label="0"><p>Share this</p><a href="#">Post</a></section><section class="comments" data-label="0"><p>Great recipe, thank you so much for sharing it with us all!</p><p>Mine burnt.</p></section></main><div class="banner promo"><p>Subscribe now for the best price of the year.</p></div><footer class="foot"><ul><li><a href="/t">Terms</a></li></ul></footer></div></body>',
    '<body data-label="0"><header><h1>The daily paper</h1><p>News and views since the year it began.</p></header><div class="topbar"><p>Log in</p></div><div class="post" data-label="1"><h1>A walk</h1><p>We set out at dawn and came back late at night.</p><ul><li>Bread and cheese for the way</li><li>A map of the hills</li><li>Good boots, worn in</li></ul><p>It rained.</p><ol><li>First we went north.</li><li>Then we turned back</li></ol><h2>What we saw</h2><dl><dt>Hares</dt><dd>Two of them, in the long grass.</dd></dl><div><p>There were no other people.</p></div></div><section class="comments"><h2>Three replies</h2><article><p>We did the same walk last year and loved every minute.</p></article><article><p>Me too.</p></article></section><section class="promo"><h2>Our shop</h2><p>Maps and books for every walk in the hills.</p></section></body>',
    '<body data-label="0"><nav><a href="/1">One</a><a href="/2">Two</a></nav><div class="ad">Cheap flights to all islands, book today.</div><article data-label="1"><h1>Of bees</h1><p>Bees live in hives and gather nectar from flowers.</p><p>A hive has one queen.</p></article><section class="related"><p>More about insects in our archive.</p></section><footer>All rights reserved.</footer></body>',
    '<body data-label="0"><header><h1>Weekly</h1></header><div class="menu"><ul><li><a href="/x">Home</a></li></ul></div><article data-label="1"><h2>Salt</h2><p>Salt was once worth its weight in silver.</p><blockquote>So it is said.</blockquote><p>It is cheap now.</p></article><div class="sidebar"><p>Other stories of the week.</p></div><footer><p>Imprint</p></footer></body>',
    '<body data-label="0"><article data-label="1"><header><h1>The title in a header of the article</h1></header><p>Plain text of an article that goes on for a while and ends.</p><div><p>Nested paragraph, which belongs to the text as well.</p></div><aside data-label="0"><p>See also our guide to everything else on this site.</p></aside><p>The end.</p><footer data-label="0"><p>Filed under news</p></footer></article><div class="related-posts"><h3>Read next</h3><p>Ten things that you did not know about rivers.</p></div><div class="alert notice"><p>This page was archived and may be out of date.</p></div></body>',
    '<body data-label="0"><div class="modal" hidden><p>Sign in to read on, it is free and takes a minute.</p></div><nav class="nav"><ul><li><a href="/">Home</a></li></ul></nav><article data-label="1"><h1>The price of tea</h1><p>Tea has been traded over land and sea for many hundreds of years.</p><section class="share-price"><h2>A share of the market</h2><p>One house held nearly all of the trade for a century and a half.</p><p>Then others came.</p></section><p hidden>Readers who open this part find how the prices were worked out.</p><div style="display:none"><p>A table of all prices by year, as far as they are known.</p><p>Not all are.</p></div><div class="side-by-side"><p>The two ports lay close together, and the ships of both went east.</p></div><p>So it ended.</p></article><div class="cookie-banner" style="display:none"><p>We and our partners store cookies on your device for this.</p></div><footer class="site-footer"><p>All rights are reserved by the publisher.</p></footer></body>',
    '<body data-label="0"><div id="top-bar"><p>Open today from nine to five.</p></div><div class="story-body" data-label="1"><h1>Search for the source</h1><div class="search-party"><p>The search party went up the valley in the spring of that year.</p><p>They found it.</p></div><div class="menu-of-the-day"><h2>What they ate</h2><p>Bread, cheese and dried meat were all that they carried with them.</p></div><details hidden><summary>How long it took</summary><p>Nine weeks in all, of which two were lost to snow on the pass.</p></details><p>They came home in the summer.</p></div><div class="share-box"><p>Share this story with your friends and family.</p></div><div class="comments-list" hidden><p>What a story, I could read about this sort of thing all day!</p></div><div class="related-links"><ul><li><a href="/o">Other stories</a></li></ul></div></body>',
)


class Node:
    __slots__ = ("parent", "tag", "names", "text", "linked", "label", "leaf", "hidden")

    def __init__(self, parent: int, tag: str, names: str = "", leaf: bool = False, label: int | None = None, hidden: bool = False):
        self.parent, self.tag, self.names, self.leaf, self.label, self.hidden = parent, tag, names, leaf, label, hidden
        self.text: list[str] = []
        self.linked = 0


def hides(attributes: str) -> str:
    """How a start tag's attributes hide its element: "aria" (it is for the eye alone), "unseen" or not at all."""
    if not HIDDEN.search(attributes):
        return ""
    how = ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "style" and NO_DISPLAY.search(value):
            return "unseen"
        if name == "aria-hidden" and value.strip().lower() == "true":
            how = "aria"
    return how


def parse(page: str, shown_only: bool = True) -> list[Node]:
    """The page's nodes, parents before children, in page order. The first is the root. Unless only what is shown is asked for, blocks that
    attributes hide are nodes that are marked so."""
    nodes = [Node(-1, "#root")]
    stack: list[tuple[str, int, bool]] = [("#root", 0, False)]  # open elements, the block node that holds them, whether they silence
    leaf: Node | None = None
    silent, links, at = 0, 0, 0
    opened: dict[str, list[int]] = {}  # where each tag's open elements are in the stack, so nothing is searched for
    walls: tuple[list[int], list[int]] = ([], [])  # where those are that end an implied close: all, and those but for cells

    def say(text: str) -> None:
        nonlocal leaf
        if silent or not text:
            return
        if leaf is None:
            if text.isspace():
                return
            holder = stack[-1][1]
            leaf = Node(holder, nodes[holder].tag, leaf=True, label=nodes[holder].label, hidden=nodes[holder].hidden)
            nodes.append(leaf)
        leaf.text.append(text)
        if links:
            leaf.linked += len(text)

    def close(n: int) -> None:
        nonlocal leaf, silent, links
        for tag, _, quiet in stack[n:]:
            if tag in BLOCK:
                leaf = None
            silent -= quiet
            links -= tag == "a"
            opened[tag].pop()
        for wall in walls:
            while wall and wall[-1] >= n:
                wall.pop()
        del stack[n:]

    end = len(page)
    while at < end:
        found = TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag, rest = tag.lower(), found[3]
        if found[1]:
            if opened.get(tag):
                close(opened[tag][-1])
            if tag in BLOCK:
                leaf = None
            continue
        closes = CLOSES.get(tag) or (CLOSES["p"] if tag in BLOCK else None)
        if closes:
            wall = walls[tag in CELLS]
            after = [open_at[k] for t in closes if (open_at := opened.get(t)) and (k := bisect_right(open_at, wall[-1] if wall else 0)) < len(open_at)]
            if after:
                close(min(after))
        if tag == "br":
            say(" ") if leaf is not None else None
            continue
        if tag in BLOCK:
            leaf = None
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        holder = stack[-1][1]
        hidden = hides(rest) if rest else ""
        if tag in BLOCK:
            names = " ".join(a or b or c for a, b, c in NAMES.findall(rest)) if "=" in rest else ""
            mark = LABEL.search(rest) if "data-label" in rest else None
            nodes.append(Node(holder, tag, names, label=int(mark[1]) if mark else nodes[holder].label, hidden=nodes[holder].hidden or hidden == "unseen"))
            holder = len(nodes) - 1
        quiet = tag in SILENT or bool(hidden) and (shown_only or hidden == "aria")
        opened.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            walls[0].append(len(stack))
            walls[1].append(len(stack)) if tag not in CELLS else None
        stack.append((tag, holder, quiet))
        silent += quiet
        links += tag == "a"
        if tag in RAW:
            stop = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            close(len(stack) - 1)
    return nodes


def leaf_text(node: Node) -> str:
    text = "".join(node.text)
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def named_words(node: Node) -> set[str]:
    """Lower-case words of a node's class, id and role."""
    return set().union(*names_of(node))


def names_of(node: Node) -> list[set[str]]:
    """The lower-case words of each name in a node's class, id and role."""
    return [set(map(str.lower, WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name)))) for name in node.names.split()]


def named_for(node: Node) -> str:
    """What a node's names say of it: "aside" if one is made of words for parts that are none of the text, "partly" if one has such a word beside
    others ("share-price"), which says little; "content", or nothing."""
    names = names_of(node)
    aside = [name for name in names if name & ASIDE_WORDS]
    if any(name <= ASIDE_WORDS | PART_WORDS | CONTENT_WORDS for name in aside):
        return "aside"
    return "partly" if aside else "content" if any(name & CONTENT_WORDS for name in names) else ""


def features(nodes: list[Node], plain: bool = False) -> list[list[str]]:
    """Feature names of each node. ``plain``: as if telling tags and names weren't there."""
    out: list[list[str]] = []
    said = ["" if plain or not node.names else named_for(node) for node in nodes]
    under = ["no"] * len(nodes)  # what a node stands in: a part for something else, a header outside articles, or neither
    for k, node in enumerate(nodes):
        above = under[node.parent] if node.parent >= 0 else "no"
        if plain or node.leaf or node.tag in TOP or above == "aside":
            under[k] = above
        elif node.tag in ("nav", "aside", "footer", "form") or said[k] == "aside":
            under[k] = "aside"
        elif node.tag == "article":
            under[k] = "article"
        else:
            under[k] = "header" if node.tag == "header" and above == "no" else above
        if node.leaf:
            n = sum(map(len, node.text))
            tail = next((t.rstrip() for t in reversed(node.text) if t.strip()), "")
            share = node.linked / max(1, n)
            got = [f"size:{min(8, int(math.log2(n + 1)))}", f"links:{0 if share < 0.05 else 1 if share < 0.6 else 2}", f"ends:{tail[-1:] in '.!?' and bool(tail)}", f"in:{'div' if plain and node.tag in TELLING else node.tag}"]
            got += [] if plain else [f"under:{under[k]}"]
            got += ["unseen:leaf"] if node.hidden else []
        else:
            got = [f"tag:{'div' if plain and node.tag in TELLING else node.tag}"]
            got += [f"names:{said[k]}"] if said[k] else []
            got += ["names:unseen"] if node.hidden else []
        out.append(got)
    return out


def self_labelled(nodes: list[Node]) -> bool:
    """Label the nodes of a page that marks one article: it and what is in it is content, but for parts that are for
    something else by their tag or names; what holds it is neither and stays out."""
    tops = [k for k, n in enumerate(nodes) if n.tag == "article" and not n.leaf]
    if len(tops) != 1:
        return False
    named = features(nodes)
    for k, node in enumerate(nodes):
        if k == 0:
            node.label = None
            continue
        above = nodes[node.parent].label if node.parent != 0 else None
        inside = node.parent >= 0 and above == 1
        off = not node.leaf and (node.tag in ("nav", "aside", "footer", "form") or "names:aside" in named[k])
        unsure = "names:partly" in named[k] or node.hidden  # such a page doesn't say what these are: they teach nothing
        node.label = 1 if k == tops[0] else (0 if off else None if unsure else 1) if inside else 0
    return True


def pair_kind(node: Node, above: Node) -> str:
    """Pairs of one kind share a potential: what stands in a page's top, parts of a page, and what they hold."""
    return "top" if above.tag in TOP else "leaf" if node.leaf else "region" if node.tag in REGION else "inner"


def observations(nodes: list[Node], plain: bool):
    """(kind, name, label or pair) counts that a labelled page gives."""
    for node, names in zip(nodes, features(nodes, plain)):
        if node.label is None:
            continue
        for name in names:
            yield "node", name, node.label
        yield "prior", "leaf" if node.leaf else "element", node.label
        above = nodes[node.parent].label if node.parent >= 0 else None
        if above is not None:
            yield "pair", pair_kind(node, nodes[node.parent]), 2 * above + node.label


class Model:
    """Log potentials from counts {(kind, name, value): n}."""

    def __init__(self, counts: dict[tuple[str, str, int], int]):
        get = lambda *k: counts.get(k, 0) + 1
        self.weights = {}
        for name in {n for k, n, _ in counts if k == "node"}:
            kind = "element" if name.startswith(("tag:", "names:")) else "leaf"
            self.weights[name] = STRENGTH * (math.log(get("node", name, 1) / get("prior", kind, 1)) - math.log(get("node", name, 0) / get("prior", kind, 0)))
        self.pairs = {}
        for kind in ("top", "leaf", "region", "inner"):
            self.pairs[kind] = [[get("pair", kind, 2 * a + b) / (get("pair", kind, 2 * a) + get("pair", kind, 2 * a + 1)) for b in (0, 1)] for a in (0, 1)]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that each node is content, by one pass of messages up and one down."""
        find = self.weights.get
        own, up = [], []
        for names in features(nodes):
            odds = max(-30.0, min(30.0, sum(find(n, 0.0) for n in names)))
            p = 1 / (1 + math.exp(-odds))
            own.append([1 - p, p])
        belief = [x[:] for x in own]
        message: list[list[float]] = [[1.0, 1.0] for _ in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            node, (b0, b1) = nodes[k], belief[k]
            total = b0 + b1
            b0, b1 = b0 / total, b1 / total
            (p00, p01), (p10, p11) = self.pairs[pair_kind(node, nodes[node.parent])]
            m0, m1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
            message[k] = [m0, m1]
            above = belief[node.parent]
            a0, a1 = above[0] * m0, above[1] * m1
            total = a0 + a1
            above[0], above[1] = a0 / total, a1 / total
        up = belief
        for k in range(1, len(nodes)):
            node = nodes[k]
            (p00, p01), (p10, p11) = self.pairs[pair_kind(node, nodes[node.parent])]
            a0, a1 = up[node.parent][0] / message[k][0], up[node.parent][1] / message[k][1]
            b0, b1 = up[k][0] * (a0 * p00 + a1 * p10), up[k][1] * (a0 * p01 + a1 * p11)
            total = b0 + b1
            up[k] = [b0 / total, b1 / total]
        return [b[1] for b in up]

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page, shown_only=False)
        found = zip(nodes, self.marginals(nodes))
        return "\n".join(t for t in (leaf_text(n) for n, p in found if n.leaf and p >= 0.5) if t)


def train(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE) -> Model:
    """A model from the pages of a bounded sample that mark their article, and the examples."""
    n = pages.count()
    share = min(1.0, sample / max(1, n))
    drawn = pages.where(F.col(html).isNotNull() & (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))).select(html)

    def run(batches):
        counts: dict[tuple[str, str, int], int] = {}
        for batch in batches:
            for page in batch.column(0):
                nodes = parse(page.as_py(), shown_only=False)
                if self_labelled(nodes):
                    for plain in (False, True):
                        for x in observations(nodes, plain):
                            counts[x] = counts.get(x, 0) + 1
        kinds, names, values = zip(*counts) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(values, pa.int32()), pa.array(counts.values(), pa.int64())], names=["kind", "name", "value", "n"])

    rows = drawn.mapInArrow(run, "kind string, name string, value int, n long").groupBy("kind", "name", "value").agg(F.sum("n").alias("n")).collect()  # a row for each feature
    counts = {(r["kind"], r["name"], r["value"]): r["n"] for r in rows}
    scale = max(EXAMPLE_WEIGHT, sum(v for (k, _, _), v in counts.items() if k == "prior") // 400)
    for page in EXAMPLES:
        nodes = parse(page, shown_only=False)
        for plain in (False, True):
            for x in observations(nodes, plain):
                counts[x] = counts.get(x, 0) + scale
    return Model(counts)


def extract(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars for every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    schema = T.StructType([pages.schema[key], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [sent.value.text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return pages.select(key, url, html).mapInArrow(run, schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
