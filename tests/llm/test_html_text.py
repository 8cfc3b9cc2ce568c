import random

import pytest

from stowage.llm import html_text

PAGES = {
    "<html><body><nav>menu</nav><article><h1>T &amp; x</h1><p>one<br>two<p> three\n four<aside>side</aside></article><footer>f</footer>": "T & x\n\none two\n\nthree four",
    "<body><div class='cookie-notice'>we use</div><main><p>a</p><form>sub</form><div id=comments>c</div></main>": "a",
    "<header>site</header><article><header><h1>Title</h1></header><p>p</p><div class='ad'>buy</div></article>": "Title\n\np",
    "<p>only <b>bold</b>text</p><script>x</script><style>y</style><!-- c -->": "only boldtext",
    "<article><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></article>": "a\n\nb\n\n1 2\n\n3",
    "<article><p>cut &am": "cut &am",
    "<article><p>a <b hre": "a", "<article><p>a</p><!-- un": "a", "<article><p>x<script>if(a<b)</script>y": "xy",
    "": "", "plain < text": "plain < text", "<article><p>a&nbsp;&nbsp;b&#233;&copy;</p></article><article>second</article>": "a bé©\n\nsecond",
}
LONG = "A long comment that goes on and on about nothing at all. " * 5
PAGES |= {
    "<article><p>post</p><section class='thread'><article class='comment'>Nice!</article></section></article>": "post",
    "<article><p>A post of some words</p><section><article><p>one</p></article><article><p>two and more</p></article></section></article>": "A post of some words",
    f"<article><p>short</p></article><div id='comments'><p>{LONG}</p></div>": "short",
    f"<p>short</p><section class='post-comments'><p>{LONG}</p></section>": "short",
    f"<div class='comments'><p>{LONG}</p></div>": LONG.strip(),
    "<main><h1>T</h1><p>long text</p><article><p>teaser</p></article></main>": "T\n\nlong text",
    "<div class='discussion'><p>intro</p><article><p>the topic</p></article></div><p>x</p>": "the topic",
    "<article><p>post</p></article><section class='comments'><article><p>c1</p></article><article><p>c2 and more</p></article></section>": "post",
    "<main><p>one</p></main><p>between</p><main><p>two</p></main>": "one\n\ntwo",
    "<main><h1>Posts</h1><article><p>first of the posts</p></article><article class='x'><p>second</p></article></main>": "first of the posts\n\nsecond",
    "<div class='site-navigation'><a href=x>home</a> <a href=y>away</a></div><div class='ads-top'>buy</div><p>The text of a page</p><div class='adbox'>now</div><ul class='comment-list'><li>c</li></ul>": "The text of a page",
    "<article><p>Dishes</p><div class='menu-item'>Soup of the day</div><div class='has-ads'>stays</div></article>": "Dishes\n\nSoup of the day\n\nstays",
}


@pytest.mark.parametrize("html", list(PAGES))
def test_main_text(html):
    assert html_text.main_text(html) == PAGES[html]


def test_template_goes_by_counting(spark):
    page = "<html><body><div><p>Welcome to our site</p></div><div><p>body {0}</p></div></body></html>"
    rows = [(i, "http://a.org/x", page.format(i), 1) for i in range(20)] + [(100, "http://b.org/x", page.format(0), 1), (101, None, None, 1), (101, "bad", "<p>x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT int")
    out = html_text.extract_text(df).collect()
    by = sorted((r["page_id"], r["text"], r["n_chars"]) for r in out)
    assert by[:20] == sorted((i, f"body {i}", len(f"body {i}")) for i in range(20))
    assert by[20] == (100, "Welcome to our site\n\nbody 0", 27) and by[21:] == [(101, "", 0), (101, "x", 1)]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_deep_and_odd_html():
    assert html_text.main_text("<div>" * 5000 + "x") == "x"
    assert html_text.main_text("</p></div>" * 10 + "<p>y</b></p>") == "y"


def test_what_lies_deep_is_still_an_element():
    assert html_text.main_text("<article>" + "<div>" * 1000 + "<p>kept</p><nav>menu</nav><form>f</form>") == "kept"


def repeated_blocks(pages, min_pages=10, share=0.5):
    """By hand, for pages that are lists of plain paragraphs: those which recur on a host or in a section of it go."""
    out = []
    for i, host, section, paragraphs in pages:
        whole = [p for _, h, _, p in pages if h == host]
        own = [p for _, h, s, p in pages if (h, s) == (host, section)]
        often = lambda x, group: sum(x in p for p in group) >= max(min_pages, share * len(group))
        out.append((i, "\n\n".join(x for x in paragraphs if not any(often(x, g) for g in (whole, own)))))
    return out


def test_template_against_counting_by_hand(spark):
    """Hosts with a block on all pages, on those of one section, on a few pages of a section and on half of them."""
    rng = random.Random(4)
    pages = []
    for i in range(240):
        host, section = rng.choice(["a.org", "a.org", "b.net", "small.com"]) if i % 30 else "small.com", rng.choice(["news", "news", "shop", "", "x"])
        paragraphs = [f"text {i} {k}" for k in range(rng.randrange(1, 4))]
        blocks = [("of the host", host == "a.org"), ("of the section", section == "shop"), ("now and then", rng.random() < 0.3), ("half", section == "news" and rng.random() < 0.5)]
        paragraphs += [b for b, here in blocks if here]
        rng.shuffle(paragraphs)
        pages.append((i, host, section, paragraphs))
    url = lambda h, s: f"http://{h}/{s}/p" if s else f"http://{h}/p"
    rows = [(i, url(h, s), "<body>" + "".join(f"<p>{x}</p>" for x in p)) for i, h, s, p in pages]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = repeated_blocks(pages)
    assert sorted((r["page_id"], r["text"]) for r in out) == want
    assert any("of the host" in p and "of the host" not in t for (_, _, _, p), (_, t) in zip(pages, want)) and any("now and then" in t for _, t in want)


TEXT = "<p>The text of the page, which is longer than what stands beside it.</p>"
WRAPPED = ["content has-sidebar", "content-sidebar-wrap", "site no-menu", "social-studies", "related", "sidebar widget"]


@pytest.mark.parametrize("name", WRAPPED)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers_keep_the_text(name, tag):
    want = "The text of the page, which is longer than what stands beside it."
    page = f"<body><div class='sidebar'>links</div><div class='{name}'><{tag}>{TEXT}<div class='share'>share</div></{tag}></div><div id='cookie-notice'>we use</div></body>"
    assert html_text.main_text(page) == want
    assert html_text.main_text(page.replace("class='" + name, "id='" + name)) == want


def test_comments_marked_up_as_articles():
    page = f"<main>{TEXT}<div class='comments'><article class='comment'>first!</article></div></main>"
    assert html_text.main_text(page) == "The text of the page, which is longer than what stands beside it."


def test_a_page_of_many_megabytes_and_clashing_columns(spark):
    body = "".join(f"<p>paragraph {i} of a very long page</p>" for i in range(60_000))
    rows = [(1, "http://a.org/x", f"<article>{body}</article>", 1), (1, "http://a.org/x", "<article>again</article>", 2), (2, "http://a.org/y", None, 3)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, N_CHARS int")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in out)[:2] == [(1, 5), (1, len("\n\n".join(f"paragraph {i} of a very long page" for i in range(60_000))))]
