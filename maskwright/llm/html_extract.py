"""HTML extraction by composite text density: the densest subtree of the page, without what surrounds an article."""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import small_batches, text_blocks

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>?)",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>]|$)""", re.I)
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
P_STOPS = frozenset("button td th table caption object div article section".split())
CLOSES_P = BLOCKS - frozenset("body html caption dd dt legend li optgroup option tbody td tfoot th thead tr".split())
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}}
#: What is never part of an article.
DROPPED = frozenset("head script style noscript template nav footer aside button select textarea iframe svg math canvas object embed video audio map dialog menu noembed noframes xmp title input label".split())
#: Words of class and id that name a menu, header, footer, sidebar, notice, advert, form or reader comments; a name counts
#: if all its words are these or NEUTRAL.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login search "
    "sidebar widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead topbar footer comment comments commentlist respond replies disqus".split()
)
NEUTRAL = frozenset("site page top bottom left right bar box block list item items link links wrapper wrap container inner outer section area header main primary secondary form text content post posts articles buttons icons slot unit".split())
_WORDS = re.compile(r"[\s_-]+")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose class, id and role say nothing of their text.
KEPT = HEADINGS | {"html", "body", "main", "p"}
ARTICLES = frozenset({"article", "main"})
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "items", "skip", "chars", "tags", "link_chars", "link_tags", "density", "total", "hinted")

    def __init__(self, name: str, parent: Node | None, skip: bool = False):
        self.name, self.parent, self.skip, self.hinted = name, parent, skip, False
        self.items: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(name: str, attrs: str, in_article: bool) -> bool:
    if name in DROPPED or name == "header" and not in_article:
        return True
    if len(attrs) > 1 and name not in ("html", "body", "article", "main"):
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), (a or b or c).lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return True
    return False


def _speaks(value: str) -> bool:
    """Whether one of the names has a hint and nothing but hints, neutral words and numbers: not has-sidebar, related-work."""
    for name in value.lower().split():
        words = [w for w in _WORDS.split(name) if w and not w.isdigit()]
        if any(w in HINTS for w in words) and all(w in HINTS or w in NEUTRAL for w in words):
            return True
    return "site-header" in value.lower().split() or "page-header" in value.lower().split()


def _hinted(name: str, attrs: str) -> bool:
    """Whether name, class, id or role make it likely that the element is not part of an article."""
    if name in KEPT:
        return False
    if name == "form":
        return True
    for key, a, b, c in _ATTR.findall(attrs) if len(attrs) > 1 else ():
        key, value = key.lower(), a or b or c
        if key in ("class", "id") and _speaks(value) or key == "role" and value.strip().lower() in ROLES:
            return True
    return False


class _Tree:
    """The open elements of a page that is being read, counted by name, so that a look for one that is not open is short."""

    def __init__(self):
        self.root = self.node = Node("#root", None)
        self.open: Counter[str] = Counter()

    def close(self, last: Node) -> None:
        """Closes all open elements up to and with last."""
        up = self.node
        while up is not last.parent:
            self.open[up.name] -= 1
            up = up.parent
        self.node = up

    def nearest(self, names, stops=frozenset()) -> Node | None:
        """The innermost open element of these names that lies in none of the stops."""
        if not any(self.open[n] for n in names):
            return None
        up = self.node
        while up is not self.root and up.name not in names and up.name not in stops:
            up = up.parent
        return up if up.name in names else None

    def outermost(self, names, stops) -> Node | None:
        found = up = self.nearest(names, stops)
        while up is not None and up is not self.root and up.name not in stops:
            found = up if up.name in names else found
            up = up.parent
        return found


def parse(page: str) -> Node:
    """The page's element tree; end tags that the page leaves out are supplied as browsers do for common elements."""
    tree = _Tree()
    at, end = 0, len(page)
    low = None
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            tree.node.items.append(page[at:])
            break
        if m.start() > at:
            tree.node.items.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name, attrs = name.lower(), m["attrs"] or ""
        if m["end"]:
            up = tree.nearest((name,))
            if up is not None:
                tree.close(up)
            elif name == "p":
                tree.node.items.append(Node("p", tree.node))
            continue
        if name in CLOSES_P and (up := tree.nearest(("p",), P_STOPS)) is not None:
            tree.close(up)
        if name in SAME and (up := tree.outermost(SAME[name], SCOPE.get(name, frozenset()))) is not None:
            tree.close(up)
        if name == "html" and tree.node is not tree.root:
            continue
        new = Node(name, tree.node, _unwanted(name, attrs, tree.open["article"] + tree.open["main"] > 0))
        new.hinted = _hinted(name, attrs)
        tree.node.items.append(new)
        if name in RAW:
            low = page.lower() if low is None and len(page.lower()) == end else low
            stop = (low or page).find(f"</{name}", at)
            stop = end if stop < 0 else stop
            new.items.append(page[at:stop])
            at = page.find(">", stop) + 1 or end
        elif name not in VOID and (not attrs.rstrip(">").endswith("/") or name in BLOCKS):
            tree.node = new
            tree.open[name] += 1
    return tree.root


def _weigh_hints(root: Node) -> None:
    """Hinted elements are skipped, but for wrappers: those that hold all of the page's articles or, in a page without
    article and main, most of the text outside links."""
    order: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(x for x in n.items if not isinstance(x, str) and not x.skip)
    if not any(n.hinted for n in order):
        return
    holds: dict[int, int] = {}
    for n in reversed(order):
        inner = [x for x in n.items if not isinstance(x, str) and not x.skip]
        own = sum(len(x) - x.count(" ") for x in n.items if isinstance(x, str) and not x.isspace())
        n.chars = 0 if n.name == "a" else own + sum(x.chars for x in inner)
        holds[id(n)] = (n.name in ARTICLES and not n.hinted) + sum(holds[id(x)] for x in inner)
    every = holds[id(root)]
    for n in order:
        n.skip = n.hinted and not (holds[id(n)] == every if every else 2 * n.chars > root.chars)


def _measured(root: Node) -> list[Node]:
    """The wanted elements in page order, with counts of their subtrees; text is decoded in place."""
    order: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        order.append(n)
        kept = []
        for x in n.items:
            if isinstance(x, str):
                kept.append(html.unescape(x) if "&" in x else x)
            elif not x.skip:
                kept.append(x)
                stack.append(x)
        n.items = kept
    for n in reversed(order):
        inner = [x for x in n.items if not isinstance(x, str)]
        n.chars = sum(len(x) - x.count(" ") for x in n.items if isinstance(x, str) and not x.isspace()) + sum(x.chars for x in inner)
        n.tags = sum(x.tags + 1 for x in inner)
        n.link_chars = n.chars if n.name == "a" else sum(x.link_chars for x in inner)
        n.link_tags = sum(x.link_tags + (x.name == "a") for x in inner)
    body = next((n for n in order if n.name == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for n in reversed(order):
        if n.chars:
            plain = max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * n.link_chars + ratio * n.chars + math.e)
            n.density = n.chars / max(n.tags, 1) * max(math.log(n.chars / max(n.link_chars, 1) * max(n.tags, 1) / max(n.link_tags, 1) + 1e-9) / base, 0.0)
        n.total = sum(x.density for x in n.items if not isinstance(x, str))
    return order


def _menu(n: Node) -> bool:
    return n.link_tags >= 3 and 2 * n.link_chars > n.chars


def _chosen(root: Node, order: list[Node]) -> tuple[Node, set[int]]:
    """The subtree of the greatest density sum, widened along its path to the body: (top, ids of what is left out in it).

    The least density on that path is the threshold: what stands beside the path belongs to the text if it is as dense
    and not mostly links, and so do headings before it. Where the path runs inside an article or main, all beside it
    belongs to the text but for menus. Outside of these, menus at the top of the subtree are left out too. Ties: of equal
    sums the first in the page counts.
    """
    body = max([n for n in order if n.name == "body"] or [root], key=lambda n: n.chars)
    best = max(order, key=lambda n: n.total)
    if best.total <= 0:
        return body, set()
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min((n.density for n in path if n is not root), default=0.0)
    inside = max((k for k, n in enumerate(path) if n.name in ARTICLES), default=-1)
    out = {id(x) for x in best.items if inside < 0 and not isinstance(x, str) and _menu(x)}
    top = 0
    for k, n in enumerate(path[1:], 1):
        before = True
        for i, x in enumerate(n.items):
            if x is path[k - 1]:
                before = False
                continue
            if isinstance(x, str):
                belongs = k <= inside and not x.isspace()
            elif k <= inside:
                belongs = not _menu(x)
            else:
                belongs = before and x.name in HEADINGS and 2 * x.link_chars <= x.chars or x.chars > 0 and x.density >= threshold and 2 * x.link_chars <= x.chars
            if belongs:
                top = k
            elif isinstance(x, str):
                n.items[i] = " "
            else:
                out.add(id(x))
    return path[top], out


def text_of(top: Node, out: set[int] = frozenset()) -> str:
    blocks: list[str] = []
    own: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(own)).strip()
        if text:
            blocks.append(text)
        own.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            own.append(x)
        elif x.name == "br":
            own.append(" ")
        elif id(x) not in out:
            if x.name in BLOCKS or x is top:
                flush()
                stack.append(None)
            stack.extend(reversed(x.items))
    flush()
    return "\n".join(blocks)


def main_text(page: str) -> str:
    """The article's blocks of text, one a line; empty if the page has none."""
    root = parse(page)
    _weigh_hints(root)
    return text_of(*_chosen(root, _measured(root)))


def densest_text(page: str) -> str:
    """The text of the subtree of the greatest density sum alone, as it is before it is widened."""
    root = parse(page)
    _weigh_hints(root)
    best = max(_measured(root), key=lambda n: n.total)
    return text_of(best)


def _extract(batches):
    for rows, pages in text_blocks(batches, "html"):
        texts = [main_text(p.decode("utf-8", "replace")) for p in pages]
        columns = [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row's whole html.

    Each row is extracted by itself, so repeated rows and ids stay as they are, null ids and urls stay null, and a
    null or empty html, or one without an article, gives an empty text. Long and deeply nested pages take time in
    proportion to their tags. Extra columns are not read. No shuffle.
    """
    small_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
