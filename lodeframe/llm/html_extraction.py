"""Main text of web pages by composite text density.

A page becomes a tree of its elements.  Elements that never hold an article (scripts, forms,
navigation ...) are pruned.  A class or id that names a page part (menu, advert, ...) is a hint:
a whole token counts, or one whose words all name parts or places, or one with a word for readers' talk.
Talk, adverts and notices go wherever they stand, unless they hold an article element.  Other hinted
parts stay if they hold most of the body's text outside links, if they are headings, or if they are
paragraphs or parts of an article whose name may be an article's too (header, tags ...).  Nothing is
pruned by a hint if nothing else has text.
Every remaining node gets its link-adjusted density: characters per tag, times
the logarithm of (characters per link character) * (tags per link tag) to a base that grows with
the share of link text of node and body.  The node with the largest sum of its children's
densities is the centre of the page; the least density on its path to the body is the threshold.

From the centre the subtree grows along that path: to a parent whose other text is as dense as the
threshold, or to an article element whose other text is mostly no links.  The subtree reached is the
main text, with what beside its path is as dense as the threshold.

Blocks are cut at block elements; white space inside a block becomes one space, and blocks are
joined by line feeds in the order of the page.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as X

#: An attribute as browsers read it: a quote that never closes belongs to the name, and one inside an unquoted value to the value.
_ATTRIBUTE = r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+|(?=>))))?+"""
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:" + re.sub(r"(?<!\\)\((?!\?)", "(?:", _ATTRIBUTE) + r")*+)[\s/]*+(?:>|\Z)|[^<]++|<", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes template svg math".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no article text, whatever they are called.
_NEVER = frozenset("script style noscript template nav footer aside form button select option input textarea iframe object embed svg math canvas audio video dialog menu head title noembed noframes".split())
#: Words in class or id that name a part of the page beside the article.
_PART = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion promoted sidebar side-bar sidenav rail nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs toolbar topbar header masthead site-header page-header footer foot site-footer comment comments commentlist disqus respond replies reply discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sign-up login signin search searchbox form share sharing social related recommended recommendations recirc more-stories popular trending widget widgets pagination pager paging tags tagcloud copyright disclaimer skip skip-link contentinfo complementary hidden visually-hidden sr-only".split()
)
#: Words beside these in a token: where a part is, or that it is a box.
_PLACE = frozenset("left right top bottom main site page primary secondary global container wrapper wrap box block bar area section inner outer list links item items button buttons icon icons slot slots unit zone frame thread article articles post posts story stories news reading topics pages reader readers user users visitor visitors guest guests blog".split())
#: Parts that an article may have as well.
_SOFT = frozenset("header page-header disclaimer discussion form search reply replies respond overlay tags foot banner copyright rail popular trending".split())
#: Talk of readers; one such word in a token tells it.
_TALK = frozenset("comment comments commentlist disqus replies respond".split())
#: Parts that never belong to the article, even where they hold more text than it.
_FOREIGN = _TALK | frozenset("ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored notice notices notification alert cookie cookies consent gdpr".split())
#: A token that begins so tells what an element has or lacks, not what it is.
_ABOUT = frozenset("has have with without no not is hide show".split())
_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: An opening tag closes these open elements, up to the boundary after the bar.
_CLOSES = {
    "p": (("p",), ()),
    "li": (("li", "p"), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "p"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th", "p"), ("table",)),
    "option": (("option",), ("select",)),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that leave an open head open.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: A stray end tag inside these does not close what is outside, unless it ends a container.
_BARRIERS = frozenset("article table td th".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_CONTAINERS = frozenset(("article", "main", "section", "div", "body", "td", "blockquote"))
#: Elements whose end tags pass barriers.
_STRONG = _CONTAINERS | frozenset("table tr tbody ul ol form nav aside footer header".split())


class Node:
    __slots__ = ("tag", "parent", "children", "pruned", "chars", "tags", "link_chars", "link_tags", "density", "total", "hint")

    def __init__(self, tag: str, parent: Node | None, pruned: bool) -> None:
        self.tag, self.parent, self.pruned = tag, parent, pruned
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.hint = 0


def _attributes(text: str) -> dict[str, str]:
    """Values by lower-cased name; of repeated names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTES.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Open:
    """The open elements, with the places of each tag, of containers and of barriers among them."""

    def __init__(self, *nodes: Node) -> None:
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []
        self.barriers: list[int] = []
        for node in nodes:
            self.push(node)

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in _CONTAINERS:
            self.containers.append(at)
        if node.tag in _BARRIERS:
            self.barriers.append(at)

    def cut(self, at: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in _CONTAINERS:
                self.containers.pop()
            if tag in _BARRIERS:
                self.barriers.pop()

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def in_article(self) -> bool:
        return bool(self.places.get("article") or self.places.get("main"))

    def end(self, tag: str) -> bool:
        """Close the innermost element of this tag; false if none is open here."""
        at = self.last(tag)
        if at < 2 or tag not in _STRONG and self.barriers and at < self.barriers[-1]:
            return at >= 2
        self.cut(at)
        return True

    def make_room(self, tag: str) -> None:
        """Close what a start tag of this name ends."""
        closes, bounds = _CLOSES.get(tag, (("p",), ()))
        wall = max([1, *(self.last(b) for b in bounds)])
        wall = next((c for c in takewhile(lambda at: at > wall, reversed(self.containers)) if self.nodes[c].tag not in closes), wall)
        inside = [list(takewhile(lambda at: at > wall, reversed(self.places.get(c, ())))) for c in closes]
        if any(inside):
            self.cut(min(places[-1] for places in inside if places))


def _prunes(tag: str, attributes: dict[str, str], open_elements: Open) -> bool:
    if tag in _NEVER:
        return True
    if tag == "header":  # a header inside an article may hold its title
        return not open_elements.in_article()
    if attributes and tag not in ("html", "body", "article", "main"):
        return (
            "hidden" in attributes
            or attributes.get("aria-hidden", "").strip().lower() == "true"
            or attributes.get("role", "").strip().lower() in _ROLE
            or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I))
        )
    return False


def _named(token: str) -> str | None:
    """The page part that a class or id token names: the whole token, all its words with places, or one word for talk."""
    low = token.lower()
    if low in _PART:
        return low
    words = [w for w in re.split("[-_]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", "-", token).lower()) if w]
    if not words or words[0] in _ABOUT:
        return None
    talk = [w for w in words if w in _TALK and w not in _SOFT]
    if talk:
        return talk[0]
    parts = [w for w in words if w in _PART]
    return parts[0] if parts and all(w in _PART or w in _PLACE or w.isdigit() for w in words) else None


def _hint(tag: str, attributes: dict[str, str], open_elements: Open) -> int:
    """0 if class and id name no page part, 2 for what is never of the article (talk, adverts, notices), 1 for others."""
    if not attributes or tag in _HEADINGS or tag in ("html", "body", "article", "main"):
        return 0
    parts = {_named(t) for name in ("class", "id") for t in attributes.get(name, "").split()} - {None}
    if parts and parts <= _SOFT and (tag in _TEXT or open_elements.in_article()):
        return 0
    return 2 if parts & _FOREIGN else 1 if parts else 0


def parse(page: str) -> Node:
    """The tree of a page; pruned subtrees keep no children."""
    root = Node("html", None, False)
    body = Node("body", root, False)
    root.children.append(body)
    stack = Open(root, body)
    at, n, hinted = 0, len(page), False
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            text = m[0]
            if text.startswith("<![CDATA["):
                text = text[9:].removesuffix("]]>")
            elif text.startswith("<") and len(text) > 1:
                continue
            if stack.places.get("head") and not text.isspace():
                stack.cut(stack.last("head"))  # text ends an open head
            if not stack.nodes[-1].pruned:
                stack.nodes[-1].children.append(text)
            continue
        tag = tag.lower()
        if m["end"]:
            if not stack.end(tag) and tag == "p" and not stack.nodes[-1].pruned:
                stack.nodes[-1].children.append(Node("p", stack.nodes[-1], False))  # it parts the text around it
            continue
        if stack.places.get("head") and tag not in _HEAD:
            stack.cut(stack.last("head"))  # the end tag of a head may be left out
        if tag in ("html", "body"):
            continue
        if tag in _CLOSES or tag in _BLOCK:
            stack.make_room(tag)
        parent = stack.nodes[-1]
        attributes = _attributes(m["attributes"]) if m["attributes"] else {}
        pruned = parent.pruned or _prunes(tag, attributes, stack)
        ended = m[0].rstrip(">").endswith("/")
        if tag in _RAW and not ended:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        node = Node(tag, parent, pruned)
        if not pruned:
            node.hint = _hint(tag, attributes, stack)
            hinted |= node.hint > 0
            parent.children.append(node)
        elif not parent.pruned and tag in _BLOCK:
            parent.children.append(Node("hr", parent, False))  # what is pruned still parts the blocks around it
        if tag not in _VOID and not (ended and tag not in _BLOCK):
            stack.push(node)
    if hinted:
        _follow_hints(body)
    return body


def _follow_hints(body: Node) -> None:
    """Prune what class or id name as a page part, unless nothing is left.

    Talk, adverts and notices stay only if they hold an article element, other parts if they hold most of the text outside links.
    """
    nodes = _measure(body)
    plain = {id(x): x.chars - x.link_chars for x in nodes}
    holds = set()
    for x in reversed(nodes):
        if x.parent is not None and (x.tag in ("article", "main") and x.chars or id(x) in holds):
            holds.add(id(x.parent))
    for x in nodes:
        x.chars = x.tags = x.link_chars = x.link_tags = 0
    total = left = plain[id(body)]
    gone, work = [], [body]
    while work:
        node = work.pop()
        if node.hint == 2 and id(node) not in holds or node.hint == 1 and plain[id(node)] * 2 <= total:
            gone.append(node)
            left -= plain[id(node)]
        else:
            work.extend(c for c in node.children if isinstance(c, Node))
    if not left and total:
        return
    out = {id(x) for x in gone}
    for parent in {id(x.parent): x.parent for x in gone}.values():
        children = []
        for c in parent.children:
            if not isinstance(c, Node) or id(c) not in out:
                children.append(c)
            elif c.tag in _BLOCK:
                children.append(Node("hr", parent, False))  # what is pruned still parts the blocks around it
        parent.children = children


def _measure(body: Node) -> list[Node]:
    """Characters, tags, link characters and link tags of every node; all nodes, parents first."""
    nodes = [body]
    for node in nodes:
        nodes.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    return nodes


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, adjusted for links; share: of link characters in the body."""
    if not chars:
        return 0.0
    tags = max(tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    value = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / tags * math.log(max(value, 1.0)) / math.log(max(base, 1.0 + 1e-9))


def _densities(body: Node) -> list[Node]:
    nodes = _measure(body)
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node))
        node.total += sum(len(c.strip()) for c in node.children if isinstance(c, str))  # text beside elements is dense in itself
    return nodes


#: How a line of rights begins.
_RIGHTS = re.compile(r"\s*(?:copyright\s*)?(?:©|&copy;|\(c\)\s*\d)|\s*copyright\s*\d", re.I)


def _opening(node: Node) -> str:
    """The first text of a subtree that is not blank."""
    work: list[Node | str] = [node]
    while work:
        x = work.pop()
        if isinstance(x, str):
            if x.strip():
                return x
        else:
            work.extend(reversed(x.children))
    return ""


def _content(body: Node) -> list[Node]:
    """The subtrees of the main text, in the order of the page.

    These are the centre (the node of the largest sum), grown along its path to the body, and, beside
    the rest of that path, headings and what is as dense as the least dense node of it.  What shares its
    parent with the grown centre stays too, if it is mostly no links, unless an article element holds the
    centre and not it.  A short line of rights beside the centre goes.
    """
    nodes = [x for x in _densities(body) if x.tag in _CONTAINERS]
    best = max(nodes, key=lambda x: x.total)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    least = min(x.density for x in path)
    share = body.link_chars / max(body.chars, 1)
    grown = 0
    for i in range(1, len(path) - 1):
        inner, outer = path[grown], path[i]
        chars, links = outer.chars - inner.chars, outer.link_chars - inner.link_chars
        rest = _density(chars, outer.tags - inner.tags, links, outer.link_tags - inner.link_tags, share)
        if not chars or rest >= least or outer.tag in ("article", "main") and links * 2 <= chars:
            grown = i
    best, path = path[grown], path[grown:][::-1]
    before: list[Node] = []
    after: list[list[Node]] = []
    for node, inner in zip(path[:-1], path[1:], strict=True):
        at = next(i for i, c in enumerate(node.children) if c is inner)
        near = inner is best and not any(x.tag in ("article", "main") for x in path[path.index(inner) :])
        stays = lambda c, near=near: (c.density >= least or c.tag in _HEADINGS or near and c.link_chars * 2 <= c.chars) and not (c.chars < 200 and _RIGHTS.match(_opening(c)))
        sides = [[c for c in part if isinstance(c, Node) and c.chars and stays(c)] for part in (node.children[:at], node.children[at + 1 :])]
        before += sides[0]
        after.append(sides[1])
    return [*before, best, *(c for side in reversed(after) for c in side)]


def _blocks(node: Node) -> list[str]:
    blocks: list[list[str]] = [[]]
    work: list[Node | str | None] = [node]
    while work:
        x = work.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(html.unescape(x))  # a reference never runs over markup
        elif x.tag == "br":
            blocks[-1].append(" ")
        else:
            parts = x.tag in _BLOCK
            if parts:
                blocks.append([])
                work.append(None)
            work.extend(reversed(x.children))
    joined = (" ".join("".join(b).split()) for b in blocks)
    return [b for b in joined if b]


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null, empty or text-less pages."""
    if not page:
        return ""
    body = parse(page)
    return "\n".join(b for node in _content(body) for b in _blocks(node))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    A null or empty page has the empty text; markup that never ends is read to the end of the
    page.  Repeated rows keep a row each; null ids and urls stay null.  Of equal density sums the
    outer node is the centre.  An empty table gives no rows; other columns are ignored, whatever
    their names.  Whole pages are read, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "html"):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
