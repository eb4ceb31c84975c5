"""Main text of web pages by composite text density: characters a tag of every node, adjusted for links, and the subtree whose children are densest."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never read as markup, up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand in a line of text; all others begin and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Of these, those that aren't counted as tags: each would make its paragraph sparser than the text in it.
PLAIN = INLINE - {"a"} | {"br"}
#: Elements that are never an article's text, and roles that say the same of any element.
ASIDE = frozenset("nav footer aside form button select menu dialog svg canvas object audio video math head".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
#: Words in class or id that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|topbar|masthead|siteheader|sitefooter|footer"
    r"|sidebar\w*|aside|widget\w*|related|recommend\w*|trending|comments?|commentlist|respond|repl(?:y|ies)|disqus\w*|discussion|cookies?|consent|gdpr|notices?|alerts?|popup\w*|modal|overlay"
    r"|newsletter\w*|subscri\w*|signup|login|share\w*|sharing|social\w*|pagination|pager|skip-link|hidden|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Elements that class and id don't mark; of articles only those that are reader comments.
KEPT = frozenset("html body main".split())
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|respond)(?:$|[\s_-])", re.IGNORECASE)
#: An element that is only marked by class or id stays if it holds one of these.
BODIES = frozenset(["article", "main"])
#: Lists of which every sign is in links, of this many or more, are menus wherever they stand.
MENUS = frozenset("ul ol dl".split())
MENU_LINKS = 2
#: Start tags before which an open paragraph, item or cell ends, and the elements that such an end doesn't look beyond.
ENDS = {
    "p": "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(),
    "li": ["li"],
    "dt": ["dt", "dd"],
    "dd": ["dt", "dd"],
    "option": ["option", "optgroup"],
    "tr": ["tr", "tbody", "tfoot"],
    "td": ["td", "th", "tr", "tbody", "tfoot"],
    "th": ["td", "th", "tr", "tbody", "tfoot"],
}
_CLOSED_BY: dict[str, set[str]] = {}
for _open, _starts in ENDS.items():
    for _s in _starts:
        _CLOSED_BY.setdefault(_s, set()).add(_open)
_SCOPE = frozenset("ul ol dl table td th div article section main aside nav footer header form body blockquote select".split())

_TAG = re.compile(r"""<(?:(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>|!--(?P<comment>)|[!?][^>]*+>)""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}


class Node:
    """An element: what stands in it in order, why it may be aside, and the counts of its subtree."""

    __slots__ = ("name", "parent", "never", "marked", "aside", "link", "items", "own", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, name: str, parent: Node | None, never: bool = False, marked: bool = False):
        self.name, self.parent, self.never, self.marked = name, parent, never, marked
        self.items: list[Node | str] = []


def _judged(name: str, rest: str, parent: Node) -> tuple[bool, bool]:
    """Whether an element is aside by its kind, and whether its class or id marks it."""
    never, marked = name in ASIDE, False
    if name == "header":
        at: Node | None = parent
        while at is not None and at.name not in BODIES:
            at = at.parent
        never = at is None
    for m in _ATTRIBUTE.finditer(rest) if rest else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            marked = marked or name not in KEPT and bool((COMMENT if name == "article" else MARKED).search(value))
        elif key == "role":
            never = never or value.lower() in ROLES
        else:
            never = never or key == "hidden" or value.lower() == "true"
    return never, marked


def parse(page: str) -> list[Node]:
    """The elements of a page in order, the root first, by a stack. Unknown end tags are ignored, open elements end where their kind must, and a tag, comment or raw element that is never closed takes the rest of the page."""
    root = Node("#root", None)
    nodes, at, pos, size = [root], root, 0, len(page)
    depth: dict[str, int] = {}

    def text(raw: str) -> None:
        if raw:
            at.items.append(html.unescape(raw) if "&" in raw else raw)

    while pos < size:
        start = page.find("<", pos)
        if start < 0:
            text(page[pos:])
            break
        m = _TAG.match(page, start)
        if m is None:
            after = page[start + 1 : start + 2]
            if after.isascii() and after.isalpha() or after in ("/", "!", "?"):  # a tag that is cut off, or an end tag without a name
                text(page[pos:start])
                end = page.find(">", start) if after == "/" else -1
                if end < 0:
                    break
                pos = end + 1
            else:
                text(page[pos : start + 1])
                pos = start + 1
            continue
        text(page[pos:start])
        pos = m.end()
        if m["comment"] is not None:
            end = page.find("-->", start + 2)
            pos = size if end < 0 else end + 3
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if depth.get(name, 0):
                while at.name != name:
                    depth[at.name] -= 1
                    at = at.parent
                depth[name] -= 1
                at = at.parent
            elif name == "br":
                at.items.append(" ")
            continue
        closes = _CLOSED_BY.get(name)
        if closes and any(depth.get(c, 0) for c in closes):
            up: Node | None = at
            while up is not None and up.name not in closes and up.name not in _SCOPE:
                up = up.parent
            while up is not None and up.name in closes:
                while at is not up:
                    depth[at.name] -= 1
                    at = at.parent
                depth[at.name] -= 1
                at = at.parent
                up = at if at.name in closes else None
        if name == "br":
            at.items.append(" ")
        node = Node(name, at, *_judged(name, m["rest"], at))
        at.items.append(node)
        nodes.append(node)
        if name in RAW:
            end = _RAW_END[name].search(page, pos)
            pos = size if end is None else end.end()
        elif name not in VOID:
            depth[name] = depth.get(name, 0) + 1
            at = node
    return nodes


def measure(nodes: list[Node], forms: bool = False) -> Node:
    """Fills in what is aside, counts, composite densities and density sums; gives the body. With forms, forms are elements like others.

    Of a node with C characters and T tags, LC and LT of them in links, in a body with the share r of characters in links, the density is C / T times
    the logarithm of (C / LC)(T / LT) to the base ln(C LC / (C - LC) + r C + e), counts of zero being one. A node's sum is that of its
    children's densities; its own text counts as a child with its share of the node's density. Plain marks within a line aren't counted as tags, and what is aside counts nowhere.
    """
    for node in nodes:
        node.aside = node.link = False  # for now: whether a body stands in it
        node.own = node.chars = node.tags = node.link_chars = node.link_tags = 0
    for node in reversed(nodes):
        node.aside = node.aside or node.name in BODIES and not node.marked
        if node.aside and node.parent is not None:
            node.parent.aside = True
    for node in nodes:
        never = node.never and not (forms and node.name == "form")
        up = node.parent
        node.aside = never or node.marked and not node.aside or up is not None and up.aside
        node.link = node.name == "a" or up is not None and up.link
    seen = [n for n in nodes if not n.aside]
    for node in reversed(seen):
        node.own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        node.chars += node.own
        if node.link:
            node.link_chars, node.link_tags = node.chars, node.tags
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + (node.name not in PLAIN)
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + node.link
    body = next((n for n in seen if n.name == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for node in reversed(seen):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(c * lc / max(1, c - node.link_chars) + share * c + math.e)
        node.density = c / t * math.log(c * t / (lc * lt)) / math.log(base) if c else 0.0
        node.sum = sum(x.density for x in node.items if isinstance(x, Node) and not x.aside) + (node.density * node.own / c if node.own else 0.0)
    return body


def chosen(nodes: list[Node], body: Node) -> set[Node]:
    """The subtrees that are taken: in every block at least as dense as the threshold, the block of the largest sum.

    The threshold is the least density on the path from the page's largest sum up to the body. Of equal sums the outer block is taken.
    """
    seen = [n for n in nodes if not n.aside]
    best: dict[Node, Node | None] = {}
    for node in reversed(seen):
        best[node] = None if node.name in INLINE else node
        for x in node.items:
            if isinstance(x, Node) and (y := best.get(x)) is not None and (best[node] is None or y.sum > best[node].sum):
                best[node] = y
    node, threshold = best[body], body.density
    while node is not body:
        threshold = min(threshold, node.density)
        node = node.parent
    inside, out = {body}, {best[body]}
    for node in seen:
        if node is body or node.parent in inside:
            inside.add(node)
            if node.name not in INLINE and node.chars and node.density >= threshold:
                out.add(best[node])
    return out


def rendered(root: Node, taken: set[Node]) -> str:
    """Blocks of the taken subtrees in page order, joined by line feeds; white space in a block is one space."""
    blocks, line = [], []

    def end() -> None:
        if words := "".join(line).split():
            blocks.append(" ".join(words))
        line.clear()

    todo: list[tuple[Node | str | None, bool]] = [(root, False)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if inside:
                line.append(x)
        elif not x.aside and not (x.name in MENUS and x.chars == x.link_chars and x.link_tags >= MENU_LINKS):
            inside = inside or x in taken
            if x.name not in INLINE and x.name != "br":
                end()
                todo.append((None, inside))
            todo.extend((y, inside) for y in reversed(x.items))
    end()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    """The article's text of a page; empty if there is none. A page whose only text is in a form is read as if the form were an element like others."""
    if not page:
        return ""
    nodes = parse(page)
    for forms in (False, True):
        body = measure(nodes, forms)
        if body.chars:
            return rendered(nodes[0], chosen(nodes, body))
    return ""


def extract_table(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points). Null and empty pages have no text, repeats stand for themselves; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
