import html
import math
import random
import re
import time

import pytest

from ringdata.llm import html_text as h

PAGES = [
    (None, ""), ("", ""), ("<p>a<p>b", "a\nb"), ("text only", "text only"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<nav>menu</nav>", ""),
    ("<div class=comments><p>x y z</div><article><p>Main text here &amp; more.</p><p>Two</p></article>", "Main text here & more.\nTwo"),
    ("<main><h1>T</h1><section><p>long long text one is here</p><p>more text there</p></section><section><p>second section text</p></section></main><aside>no</aside>", "T\nlong long text one is here\nmore text there\nsecond section text"),
    ("<p>a <b>bold</b>\n c<br>d</p><script>if(a<b){}</script><style>p{}</style>", "a bold c d"), ("a<hr>b", "a\nb"), ("1 < 2 &lt; 3 &#233;&nbsp;x", "1 < 2 < 3 é x"),
    ("<p title=don't>kept</p><p>it's</p>", "kept\nit's"), ("<p>x <a href='" + "y" * 1000, "x"), ("<div>" * 20000 + "deep" + "</div>" * 20000, "deep"),
    ("<body><header>h</header><div id='cookie-notice'>accept all</div><div><h2>Title</h2><p>Some words of text, quite a few.</p><form>f</form><p>End</p></div><footer>f</footer>", "Title\nSome words of text, quite a few.\nEnd"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_small_pages(page, want):
    assert h.main_text(page) == want


ARTICLE = [f"Sentence number {i} of the article, which has some words in it." for i in range(6)]
WRAPPERS = ['<div class="has-sidebar">', '<div class="page-header-fixed">', '<div id="main" class="with-comments">', '<form id="aspnetForm">', '<div class="post no-ads">', '<header>', '<div class="widget">', '<div class="sidebar"><form>', '<div class="navigation">']


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_no_mark_empties_a_page(wrapper):
    body = "".join(f"<p>{x}</p>" for x in ARTICLE)
    comments = "<div class=comments>" + "<p>I think that this is wrong, and say it at some length.</p>" * 9 + "</div>"
    ends = "".join(f"</{x}>" for x in re.findall(r"<(\w+)", wrapper)[::-1])
    page = f"<body><nav><a href=/>Home</a> <a href=/n>News</a></nav>{wrapper}{body}{comments}{ends}<footer>Some rights reserved</footer>"
    assert h.main_text(page) == "\n".join(ARTICLE)
    assert h.main_text(f"<body><div>{body}</div>{comments * 9}") == "\n".join(ARTICLE)


@pytest.mark.parametrize("name", ["social-policy", "search-theory", "related-work", "comment-analysis", "no-ads", "ad"])
def test_names_that_only_contain_a_marking_word(name):
    side = "<div>" + "".join(f"<p>Side column line {i}, which is of no mark at all here.</p>" for i in range(6)) + "</div>"
    body = [f"Paragraph {i} of the article, " + "with a good many words in each of its lines, " * 5 + "as it should be." for i in range(4)]
    part = "".join(f"<p>{x}</p>" for x in body)
    whole = h.main_text(f'<body>{side}<div class="{name}">{part}</div></body>')
    assert (body[0] in whole and body[-1] in whole) == (name != "ad")
    inside = h.main_text(f'<article><div>{part}</div><section class="{name}"><p>One more part of it.</p></section></article>')
    assert inside == "\n".join(body + ["One more part of it."] * (name != "ad"))


def test_marked_compounds():
    assert all(h.mark_of("div", f'class="{x}"') for x in ["site-footer", "ad-slot", "cookie_notice", "comment-list", "share-buttons", "x related-posts", "ad-1", "sidebar2", "page-header"])
    assert not any(h.mark_of("div", f'class="{x}"') for x in ["has-sidebar", "no-ads", "page-header-fixed", "content", "main-content", "post", "", "-", "advice"])


def test_no_part_of_an_article_is_dropped():
    long = "<p>" + "A long paragraph of many words that tells of something. " * 8 + "</p>"
    said = " ".join(("A long paragraph of many words that tells of something. " * 8).split())
    page = f"<article><section>{long}{long}</section><section><h2>B</h2><p>Tiny para.</p><ul><li>one<li>two</ul></section></article><div><a href=/>x</a></div>"
    assert h.main_text(page) == "\n".join([said, said, "B", "Tiny para.", "one", "two"])
    page = f"<main><p>Short lead.</p><div>{long}{long}</div><p>Short end.</p><div><a href=/>Other page</a> <a href=/>Next page</a></div></main>"
    assert h.main_text(page) == "\n".join(["Short lead.", said, said, "Short end."])


def test_densities_against_brute_force():
    r = random.Random(6)

    def grow(depth):
        """A random tree as (name, children), where a child is a text or a tree."""
        kids = [" ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, 12))) if depth == 0 or r.random() < 0.4 else grow(depth - 1) for _ in range(r.randint(0, 4))]
        return (r.choice(["div", "div", "section", "a", "ul"]) if depth else "p", kids)

    def write(t):
        return t if isinstance(t, str) else f"<{t[0]}>" + "".join(map(write, t[1])) + f"</{t[0]}>"

    def counts(t):
        """Characters, tags below, characters in links, links below."""
        if isinstance(t, str):
            return len(t), 0, 0, 0
        below = [(counts(k), k) for k in t[1]]
        c, tags, lc, lt = (sum(x[i] for x, _ in below) for i in range(4))
        trees = [k for _, k in below if not isinstance(k, str)]
        return c, tags + len(trees), c if t[0] == "a" else lc, lt + sum(k[0] == "a" for k in trees)

    def density(t, share):
        c, tags, lc, lt = counts(t)
        tags = max(tags, 1)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / tags * math.log(max(c / max(lc, 1) * tags / max(lt, 1), 1 + 1e-9), max(base, 1 + 1e-9))

    def total(t, share):
        """Sum of the densities of child blocks; what is inside a link or other inline element counts as its parent's."""
        return sum(total(k, share) if k[0] == "a" else density(k, share) for k in t[1] if not isinstance(k, str))

    def trees(t):
        return [t, *[x for k in t[1] if not isinstance(k, str) for x in trees(k)]]

    for _ in range(150):
        tree = ("body", [grow(4)])
        c, _, lc, _ = counts(tree)
        want = sorted((x[0], f"{density(x, lc / max(c, 1)):.8g}", f"{total(x, lc / max(c, 1)):.8g}") for x in trees(tree))
        root = h.parse("<body>" + write(tree[1][0]))
        h.settle_marks(root)
        assert sorted((n.name, f"{n.density:.8g}", f"{n.total:.8g}") for n in h.measure(root)) == want


def test_long_odd_pages_stay_linear():
    began = time.time()
    for page in ("<a '" * 50_000, "<" * 200_000, "<!--" * 50_000, "<p x=\"" * 50_000, "<b>" * 50_000, "&" * 100_000,
                 "<span>" * 100_000 + "</b>" * 100_000, "<b><p>" + "<span>" * 50_000 + "</b>" * 50_000, "<span>" * 50_000 + "<div></div>" * 50_000, "<ul>" + "<div>" * 50_000 + "<dd></dd>" * 50_000):
        h.main_text(page)
    assert time.time() - began < 20


def test_query_on_the_template_pages(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = h.op9_html_text(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.sub(r"<footer>.*", "", re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id].html, re.S)[1], flags=re.S)
        parts = [re.sub(r"<[^>]*>|<[^>]*$", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        assert r.text == want and r.n_chars == len(want) and r.url == pages[r.page_id].url
    rows = [(i, None, p, 1) for i, (p, _) in enumerate(PAGES) for _ in range(2)] + [(0, "u", None, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text) for r in h.extract(df).collect()) == sorted([(i, w) for i, (_, w) in enumerate(PAGES) for _ in range(2)] + [(0, "")])
    assert h.extract(df.limit(0)).count() == 0
