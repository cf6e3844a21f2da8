"""Main text of web pages by composite text density.

For every node of a page's element tree the characters per tag are computed, with the
characters inside links held against it; the densities of a node's children are summed,
and the subtree with the largest sum is the main text.  The smallest density on the way
from that subtree to the body is the threshold: the choice widens to a parent as long as all
of the parent's other parts reach it, and to the article that encloses it.  Parts that are no text of
the page's author (menus, adverts, forms, comments of readers and so on) count nothing
and are left out of the result.  A class or id with an ordinary word (related, discussion)
only marks a candidate: inside the main text it stays when it is dense prose with few links.

The measure and the threshold follow Sun, Song and Liao, "DOM based content extraction via
text density" (SIGIR 2011).
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import as_bytes, blocks

#: Fixed values of HTML: elements without content, with raw content, that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split())
#: Elements that a new one of the same kind ends, up to the given container.
ENDED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "p": ({"p"}, {"div", "article", "section", "td", "th", "li", "blockquote", "body", "main", "button", "table"}),
}
#: Parts that are not the author's text, by element, by role and by words in class or id.
NOISE_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe noembed noframes object svg canvas audio video "
    "button select textarea input dialog menu search title datalist".split())
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist "
    "advertisement".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot alert alerts announcement banner banners "
    "billboard breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown footer footers gdpr "
    "header headers login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay "
    "pager paginate pagination paywall popup popups promo promos promotion recommended related reply replies respond "
    "promoted responses discussion share sharing sidebar sidebars signup sitemap skip social sponsor sponsored sponsors subscribe subscription tags "
    "teaser toolbar topbar widget widgets".split())
NOISE_ENDINGS = ("nav", "menu", "sidebar", "banner", "comments", "cookie", "cookies", "advert", "adverts", "footer", "popup")
#: Words that name no part of an author's text: adverts, consent, readers' comments.  Others mark candidates.
CLEAR_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot comment comments commentlist consent cookie cookies "
    "disqus gdpr newsletter paywall popup popups promo promos promoted reply replies respond signup sponsor sponsored sponsors".split())
#: Words that may stand before the one that names a part.
PLACES = frozenset("site page main post entry left right top bottom primary secondary".split())
#: Characters a tag of dense prose, and the percentage of them that may be in links.
PROSE_CHARS = 30
PROSE_LINK_PERCENT = 25
#: What marks an article as a reader's comment or an advert; other class names say little of it.
NOISE_ARTICLES = frozenset("comment reply ad advert advertisement promo sponsored teaser".split())
ARTICLE_TAGS = frozenset({"article", "main"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"})

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total", "named", "inside")

    def __init__(self, tag: str, parent: Node | None, noise: bool, named: bool = False):
        self.tag, self.parent, self.noise, self.named = tag, parent, noise, named
        self.children: list[Node | str] = []
        self.inside = tag in ARTICLE_TAGS or (parent is not None and parent.inside)


def _name(token: str) -> str | None:
    """The noise word that a class or id is, begins with, or has after its place."""
    words = [w.lower() for w in _WORD.findall(token)]
    if len(words) > 1 and words[0] in PLACES:
        words = words[1:]
    if not words:
        return None
    if words[0] in NOISE_WORDS:
        return words[0]
    return next((e for e in NOISE_ENDINGS if len(words) == 1 and words[0].endswith(e)), None)


def _noise(tag: str, attributes: str, parent: Node | None) -> tuple[bool, bool]:
    """Whether an element is noise, and whether only its name says so."""
    if tag in NOISE_TAGS:
        return True, False
    # The head of an article holds its title; the page's own header does not.
    page_part = parent is None or not parent.inside
    if tag == "header":
        return page_part, False
    if not attributes or tag in ("html", "body", "main"):
        return False, False
    named = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, tokens = name.lower(), value.strip("\"'").split()
        if tag == "article":
            if name == "class" and {t.lower() for t in tokens} & NOISE_ARTICLES:
                return True, False
        elif name == "role":
            if {w.lower() for w in _WORD.findall(value)} & NOISE_ROLES:
                return True, False
        elif name in ("class", "id"):
            found = {w for w in map(_name, tokens) if w} - (set() if page_part else {"header", "headers"})
            # Converters name sections by their headings, whatever the heading says.
            if found & CLEAR_WORDS and not (tag == "section" and name == "id"):
                return True, False
            named = named or bool(found)
    return named, named


def _ancestors(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def parse(page: str) -> Node:
    """The element tree; elements that are not closed end where their kind requires it."""
    root = Node("#root", None, False)
    here, at, size = root, 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            here.children.append(page[at:])
            break
        if found.start() > at:
            here.children.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            for node in _ancestors(here):
                if node.tag == tag and node.parent is not None:
                    here = node.parent
                    break
            continue
        if tag in BLOCK:
            here = _ended(here, ENDED["p"])
        if tag in ENDED and tag != "p":
            here = _ended(here, ENDED[tag])
        node = Node(tag, here, *_noise(tag, found[3], here))
        here.children.append(node)
        if tag in ARTICLE_TAGS and not node.noise:
            # A layout that is named after its sidebar still holds the article, as does a form around the page.
            for outer in _ancestors(here):
                outer.noise = outer.noise and outer.tag != "form" and (outer.tag in NOISE_TAGS or outer.tag in ARTICLE_TAGS)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            node.children.append(page[at : close.start() if close else size])
            at = close.end() if close else size
        elif tag not in VOID and not found[3].endswith("/"):
            here = node
    return root


def _ended(here: Node, rule: tuple[set[str], set[str]]) -> Node:
    """Where a new element goes once the open ones that it ends are closed."""
    ends, within = rule
    outer = None
    for node in _ancestors(here):
        if node.tag in within:
            break
        if node.tag in ends:
            outer = node.parent
    return outer if outer is not None else here


def measure(root: Node) -> None:
    """Densities of all nodes; noise counts nothing."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.noise)
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(" ".join(child.split()))
            elif not child.noise:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.chars if child.tag == "a" else child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
    body = next((n for n in order if n.tag == "body"), root)
    linked = body.link_chars / max(body.chars, 1)
    for node in order:
        chars, tags = node.chars, max(node.tags, 1)
        plain = max(chars - node.link_chars, 1)
        base = math.log(chars / plain * node.link_chars + linked * chars + math.e)
        weight = max(chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1), 1.0)
        node.density = chars / tags * math.log(weight) / base if chars else 0.0
    for node in order:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.noise)


def main_node(root: Node) -> Node:
    """The subtree of the largest sum, widened within the threshold and to its article."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.noise)
    body = next((n for n in order if n.tag == "body"), root)
    best = max(order, key=lambda n: n.total)
    path = list(_ancestors(best))
    if body in path:
        path = path[: path.index(body) + 1]
    threshold = min(n.density for n in path)
    for node in path[1:]:
        others = [c for c in node.children if isinstance(c, Node) and c is not best and not c.noise and c.chars]
        if node is body or any(c.density < threshold for c in others):
            break
        best = node
    enclosing = [n for n in path if n.tag in ARTICLE_TAGS]
    if enclosing:
        return enclosing[-1] if best in path[: path.index(enclosing[-1]) + 1] else best
    articles = [n for n in order if n.tag in ARTICLE_TAGS and n.chars]
    if best is body and len(articles) == 1:
        return articles[0]
    return best if best.total > 0 else body


def _prose(node: Node) -> bool:
    """Whether a measured subtree is dense text with few links."""
    return node.chars >= PROSE_CHARS * max(node.tags, 1) and 100 * node.link_chars <= PROSE_LINK_PERCENT * node.chars


def _stays(node: Node) -> bool:
    """Whether a candidate inside the main text is text of its own."""
    if node.named:
        measure(node)
    return node.named and _prose(node)


def _wraps(node: Node) -> bool:
    """Whether a form's own main text is prose, as that of a form around a whole page."""
    if node.tag != "form":
        return False
    measure(node)
    return _prose(main_node(node))


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order; noise is left out, but for candidates that are prose."""
    found: list[str] = []
    open_text: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(open_text)).split())
        if text:
            found.append(text)
        open_text.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            open_text.append(item)
        elif item.noise and item is not node and not _stays(item):
            if item.tag in BLOCK:
                close()
        elif item.tag == "br":
            open_text.append(" ")
        else:
            if item.tag in BLOCK:
                close()
                stack.append(None)
            stack.extend(reversed(item.children))
    close()
    return found


def main_text(page: str) -> str:
    root = parse(page)
    measure(root)
    chosen = main_node(root)
    if not _prose(chosen) and _unnamed(root):
        measure(root)
        chosen = main_node(root)
    return "\n".join(blocks_of(chosen))


def _unnamed(root: Node) -> bool:
    """Makes candidates and forms that hold prose, outside of other noise, ordinary elements; whether there were any."""
    found, stack = False, [root]
    while stack:
        node = stack.pop()
        if node.noise and (_stays(node) or _wraps(node)):
            node.noise, found = False, True
        if not node.noise or node.named:
            stack.extend(c for c in node.children if isinstance(c, Node))
    return found


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points) of every row.

    * A null or empty page has an empty text.  Malformed markup is read as browsers do:
      unclosed elements end with their parents, unknown ones are kept.
    * Repeated rows are read one by one; other columns are ignored, whatever their names.
    """
    fields = [T.StructField(name, pages.schema[name].dataType) for name in keep]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(len(keep)))
            for start, stop in blocks(texts):
                found = [main_text(t.decode()) for t in texts[start:stop]]
                yield pa.record_batch(
                    [*(batch.column(k).slice(start, stop - start) for k in range(len(keep))),
                     pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    [*keep, "text", "n_chars"],
                )

    return pages.select(*keep, F.col(html_col).cast("string").alias("_html")).mapInArrow(work, schema)
