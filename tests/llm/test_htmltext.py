import html
import math
import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import htmltext as H

VOID = {"br", "img", "hr", "meta", "link", "input"}


class Tree(HTMLParser):
    """A page as nested lists [name, attributes, children], by the standard library; fine for pages whose tags are balanced."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["#root", {}, []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag not in VOID:
            assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def brute(page):
    """Densities by recursion over the whole subtree for each node, then the choice by trying all nodes."""
    root = Tree(page).root

    def is_aside(node):
        return node[0] in H.ASIDE or bool(H.MARKED.search(node[1].get("class") or "")) and node[0] not in H.KEPT and node[0] != "article"

    def under(node, link=False):
        """Texts (with whether in a link) and counted tags (likewise) below a node."""
        link = link or node[0] == "a"
        texts, tags = [], []
        for x in node[2]:
            if isinstance(x, str):
                texts.append((x.strip(), link))
            elif not is_aside(x):
                a, b = under(x, link)
                texts += a
                tags += b + ([link or x[0] == "a"] if x[0] not in H.PLAIN else [])
        return texts, tags

    every = []

    def visit(node, path):
        every.append((node, path))
        for x in node[2]:
            if not isinstance(x, str) and not is_aside(x):
                visit(x, [*path, node])

    visit(root, [])
    body = next((n for n, _ in every if n[0] == "body"), root)
    of = {}
    btexts, _ = under(body)
    share = sum(len(t) for t, k in btexts if k) / max(1, sum(len(t) for t, _ in btexts))
    for node, path in every:
        texts, tags = under(node, any(p[0] == "a" for p in path))
        c, lc = sum(len(t) for t, _ in texts), sum(len(t) for t, k in texts if k)
        t, lt = max(1, len(tags)), max(1, sum(tags))
        base = math.log(c * max(1, lc) / max(1, c - lc) + share * c + math.e)
        of[id(node)] = (c / t * math.log(c / max(1, lc) * t / lt) / math.log(base) if c else 0.0, c)
    total = {}
    for node, _ in every:
        d, c = of[id(node)]
        own = sum(len(x.strip()) for x in node[2] if isinstance(x, str))
        total[id(node)] = sum(of[id(x)][0] for x in node[2] if not isinstance(x, str) and id(x) in of) + (d * own / c if own else 0)

    def largest(top):
        inside = [n for n, path in every if (n is top or any(p is top for p in path)) and n[0] not in H.INLINE]
        return next(n for n in inside if total[id(n)] >= max(total[id(m)] for m in inside) * (1 - 1e-12))

    best = largest(body)
    path = next(p for n, p in every if n is best)
    threshold = min(of[id(n)][0] for n in [*path, best] if n is body or any(b is body for b in path[: [*map(id, path), id(best)].index(id(n))]))
    taken = {id(best)}
    for node, p in every:
        if node[0] not in H.INLINE and (node is body or any(x is body for x in p)) and of[id(node)][0] >= threshold * (1 - 1e-12) and of[id(node)][1]:
            taken.add(id(largest(node)))
    pieces = []

    def write(node, inside):
        if node is not root and is_aside(node):
            return
        texts, tags = under(node)
        if node[0] in H.MENUS and all(k for t, k in texts if t) and sum(tags) >= 4 and sum(k for _, k in texts) >= 2:
            return
        inside = inside or id(node) in taken
        block = node[0] not in H.INLINE and node[0] != "br"
        pieces.append("\0" * block + " " * (node[0] == "br"))
        for x in node[2]:
            if isinstance(x, str):
                pieces.append(x if inside else "")
            else:
                write(x, inside)
        pieces.append("\0" * block)

    write(root, False)
    return "\n".join(x for x in (" ".join(b.split()) for b in "".join(pieces).split("\0")) if x)


WORDS = st.lists(st.sampled_from("lorem ipsum dolor sit amet consetetur x & ü".split()), min_size=1, max_size=30).map(" ".join).map(html.escape)
INNER = st.one_of(WORDS, WORDS.map(lambda w: f"<a href='/x'>{w}</a>"), WORDS.map(lambda w: f"<b>{w}</b>"), st.just("<br>"))
PARAGRAPH = st.tuples(st.sampled_from(["p", "h2", "div", "section", "blockquote"]), st.lists(INNER, max_size=4).map(" ".join)).map(lambda x: f"<{x[0]}>{x[1]}</{x[0]}>")
BLOCK = st.recursive(PARAGRAPH, lambda kids: st.tuples(st.sampled_from(["div", "section", "article", "div class='ad'", "nav"]), st.lists(kids, max_size=4).map("".join)).map(lambda x: f"<{x[0]}>{x[1]}</{x[0].split()[0]}>"), max_leaves=10)


@settings(max_examples=150, deadline=None)
@given(st.lists(BLOCK, max_size=5).map("".join))
def test_against_brute_force(inside):
    page = f"<html><head><title>t</title></head><body>{inside}</body></html>"
    if "class='ad'" in inside and "<article" in inside:
        page = page.replace("class='ad'", "")
    assert H.main_text(page) == brute(page)


def test_query_gives_the_article(spark, medium):
    pages = spark.read.parquet(f"{medium}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract_table(pages).collect()}
    held = pages.collect()
    assert len(got) == len(held)
    for r in held:
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


STORY = "<p>" + "A first paragraph of the story, long enough to be read with care. " * 3 + "</p><p>" + "And a second one, which tells how the story went on and ended. " * 3 + "</p>"
TEXT = "\n".join(" ".join(re.sub("<[^>]*>", "", p).split()) for p in STORY.split("</p>") if p)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("   \n\t", ""),
        ("just some words", "just some words"),
        ("<p>a &lt;b&gt; &amp;amp; &#65;&#x42;&nbsp;c\n\n d&copy", "a <b> &amp; AB c d©"),
        (f"<body><header><a href=/>Home</a></header><nav>Menu here</nav><main>{STORY}</main><aside>More</aside><footer>Imprint</footer></body>", TEXT),
        (f"<body><div id=page><div class='cookie-banner'>We use cookies, do you agree with this?</div><div class=content>{STORY}</div><div id='comments'><article class=comment><p>{'First! I say. ' * 20}</p></article></div></div>", TEXT),
        (f"<div class='post-with comments'><article>{STORY}</article></div>", TEXT),
        (f"<body class='has-sidebar no-comments'><div>{STORY}</div><div class='sidebar-left'>Left</div><div role=navigation>x</div><div hidden>y</div><div aria-hidden='true'>z</div>", TEXT),
        (f"<article>{STORY}<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><script>var a = '<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --></article>", TEXT),
        (f"<article>{STORY}<ul><li>First point<li>Second <a href=2>point</a></ul></article>", TEXT + "\nFirst point\nSecond point"),
        (f"<form><div><p>Name</p><input></div>{STORY}<select><option>One<option>Two</select></form>", "Name\n" + TEXT),
        ("<p>one<p>two<div>three<br>four</div>five", "one\ntwo\nthree four\nfive"),
        ("<p>broken </x> 3 < 4 and <b>bold</p><p>next</p>", "broken 3 < 4 and bold\nnext"),
        ("<p>cut off <a href='x", "cut off"),
        ("<p>cut <!-- off", "cut"),
        ("<p>cut </p><script>var x", "cut"),
        ("<p title='a > b' class=\"x>y\">kept</p>", "kept"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<DIV><P>Upper <EM>case</EM></P></DIV>", "Upper case"),
    ],
)
def test_pages(page, text):
    assert H.main_text(page) == text


def test_deep_and_very_long_pages():
    deep = "<div>" * 50_000 + "<p>" + "deep down there is text " * 5 + "</p>"
    assert H.main_text(deep) == ("deep down there is text " * 5).strip()
    long = "<article>" + "<p>some words of a very long page &amp; more</p>" * 100_000 + "</article>"
    assert H.main_text(long) == "\n".join(["some words of a very long page & more"] * 100_000)
    assert H.main_text("<a " * 200_000) == "" and H.main_text("<" * 200_000) == "<" * 200_000


def test_odd_rows(spark):
    rows = [(1, "u", "<p>text", "a", 1), (1, "u", "<p>text", "a", 1), (2, None, None, None, None), (None, "v", "", "b", 2), (None, None, "<p>text", "b", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in H.extract_table(pages).collect())
    assert got == sorted((str(i), str(u), "text" if h else "", 4 if h else 0) for i, u, h, *_ in rows)
    assert H.extract_table(pages.limit(0)).count() == 0
