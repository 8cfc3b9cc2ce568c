"""HTML extraction: main text by removing what a site repeats.

Every page is parsed into a tree, and every element subtree that has text is hashed. The hashes are counted per host and
per section of a host (the first part of the path, which often has a layout of its own), a page once; subtrees on at
least min_share of the pages of either (and min_pages of them) are template. Each page is then parsed again, next to the
template hashes of its host and section, and loses those subtrees. As a host of few pages shows no template,
elements that HTML itself marks as no content go too (navigation, forms, scripts and the like), and those of which the
words of a class or id say so together with what the element holds: a name made of such words only is enough, of other
names one such word and either mostly links or, outside of an article, at most a quarter of the page's text. No name
removes an element that holds an article or main element or more than half of the page's text. Adverts go by one word, and
so do comments, whatever they hold, if text is left without them. The text is what is left of the articles, or of the main
elements if those have more text of their own, or have it alone, else of the body, block by block. An article inside of
that goes if it is a comment, if another one there has its shape, or if the text around it is longer.

Defined results: null or empty html has an empty text; a null url belongs to the host ''; unclosed and unknown tags, and
html that ends inside a tag, are read as far as they go; elements may nest as deeply as they like; pages that repeat a page_id are pages of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut
from stowage.llm.url_filter import url_host, url_path

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
SPACE = frozenset(["br", "td", "th", "option"])
#: A new element of the key closes an open one of these, up to the nearest of its scope.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
} | {t: {"p"} for t in BLOCK - {"p", "li", "dt", "dd", "tr", "html", "body", "tbody", "thead", "tfoot", "caption"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
NO_TEXT = frozenset("head title script style noscript template iframe object svg canvas audio video select button textarea input form nav aside footer dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended comment comments commentlist disqus reply replies respond popup modal overlay widget login signup search pagination skip".split()
)
HEADS = frozenset("header masthead topbar".split())
COMMENTS = frozenset("comment comments commentlist commentarea disqus reply replies respond responses discussion".split())
ADVERTS = frozenset("ad ads adbox adslot adunit adspace adsense advert adverts advertisement advertising sponsored".split())
#: With one of these a name says something of its element's surroundings.
ABOUT = frozenset("has with without no not hide show before after".split())
#: Stands for a whole host where a section is named; no section has it.
WHOLE = "/"


class Tree(HTMLParser):
    """Nodes are [tag, attributes, children]; children are nodes and strings."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root: list = ["#root", {}, []]
        self.open: list[list] = [self.root]
        self.tags: Counter[str] = Counter()  # of the open elements
        self.feed(html)
        if re.match(r"<[a-zA-Z/!?]", self.rawdata):  # a tag or comment that never ends is no text
            self.rawdata = ""
        self.close()

    def shut(self, k: int) -> None:
        for node in self.open[k:]:
            self.tags[node[0]] -= 1
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closing = CLOSES.get(tag, ())
        if any(map(self.tags.get, closing)):
            scope = SCOPE.get(tag, {"table", "button"} if tag == "p" else {"table"})
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in closing:
                    self.shut(k)
                    break
                if self.open[k][0] in scope:
                    break
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)
            self.tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.tags[tag]:
            self.shut(next(k for k in range(len(self.open) - 1, 0, -1) if self.open[k][0] == tag))

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def in_order(tree: list) -> list[list]:
    """All elements, each before its children."""
    out, waiting = [], [tree]
    while waiting:
        node = waiting.pop()
        out.append(node)
        waiting += [c for c in reversed(node[2]) if not isinstance(c, str)]
    return out


def subtree_hashes(tree: list) -> dict[int, int]:
    """The hash (of tag, text and children) of each element that has text, by node id."""
    done: dict[int, tuple[bytes, bool]] = {}
    found: dict[int, int] = {}
    for node in reversed(in_order(tree)):
        h, text = hashlib.blake2b(node[0].encode("utf-8", "surrogatepass"), digest_size=8), False
        for child in node[2]:
            if isinstance(child, str):
                if words := " ".join(child.split()):
                    h.update(b"\x01" + words.encode("utf-8", "surrogatepass"))
                    text = True
            else:
                own, has = done.pop(id(child))
                h.update(b"\x02" + own)
                text |= has
        done[id(node)] = h.digest(), text
        if text and node[0] not in ("#root", "html", "body"):
            found[id(node)] = int.from_bytes(done[id(node)][0], "little", signed=True)
    return found


def is_boilerplate(node: list, in_article: bool) -> bool:
    """Whether HTML itself marks an element as no content."""
    tag, attrs, _ = node
    if not attrs:
        return tag in NO_TEXT or (tag == "header" and not in_article)
    if tag in NO_TEXT or (tag == "header" and not in_article) or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
        return True
    if tag in ("article", "main", "body", "html"):
        return False
    return "style" in attrs and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"] or "", re.I))


def name_words(node: list) -> list[set[str]]:
    """The words of each token of an element's class and id: 'has-sidebar' says nothing of the element itself."""
    attrs = node[1]
    if "class" not in attrs and "id" not in attrs:
        return []
    tokens = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()
    return [words for t in tokens if (words := set(re.split(r"[^a-z]+", t)) - {""}) and not words & ABOUT]


def named(node: list, in_article: bool) -> int:
    """What an element's names say: 2 that it is no content, 1 that it may be none, 0 nothing."""
    names = NAMES if in_article else NAMES | HEADS
    tokens = name_words(node)
    if any(words <= names or words & ADVERTS for words in tokens):
        return 2
    return int(any(words & names for words in tokens))


def is_comment(node: list) -> bool:
    return node[0] not in ("main", "body", "html") and any(words & COMMENTS for words in name_words(node))


def measure(tree: list, repeated: set[int]) -> dict[int, tuple[int, int, bool]]:
    """The characters of text that each element shows, those of them in links, and whether it holds an article or main element, by node id."""
    found: dict[int, tuple[int, int, bool]] = {}
    for node in reversed(in_order(tree)):
        size, links, holds = 0, 0, False
        for child in node[2]:
            if isinstance(child, str):
                size += len("".join(child.split()))
            else:
                own, linked, inner = found[id(child)]
                size += own
                links += linked
                # a comment that is marked up as an article is no article of the page
                holds |= inner or (child[0] in ("article", "main") and not is_comment(child) and not named(child, True))
        gone = id(node) in repeated or is_boilerplate(node, True)
        found[id(node)] = (0, 0, False) if gone else (size, size if node[0] == "a" else links, holds)
    return found


def size_of(parts: list[list], drop) -> int:
    """The characters of text of elements, less what is dropped in them."""
    size, waiting = 0, list(parts)
    while waiting:
        for child in waiting.pop()[2]:
            if isinstance(child, str):
                size += len("".join(child.split()))
            elif not drop(child):
                waiting.append(child)
    return size


def shape(node: list) -> tuple:
    return node[0], node[1].get("class"), tuple(c[0] for c in node[2] if not isinstance(c, str))


def every_of(tree: list, tag: str, drop) -> Iterator[list]:
    """The outermost elements of a tag outside of what is dropped."""
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        if node[0] == tag:
            yield node
        else:
            waiting += [c for c in reversed(node[2]) if not isinstance(c, str) and not drop(c)]


def blocks_of(node: list, drop, out: list[list[str]]) -> None:
    open_: list[tuple[Iterator, bool]] = [(iter(node[2]), False)]  # children that are still to come, and whether a block ends after them
    while open_:
        children, ends = open_[-1]
        for child in children:
            if isinstance(child, str):
                out[-1].append(child)
            elif child[0] in SPACE and not child[2]:
                out[-1].append(" ")
            elif drop(child):
                if child[0] in BLOCK:
                    out.append([])
            else:
                if child[0] in BLOCK:
                    out.append([])
                elif child[0] in SPACE:
                    out[-1].append(" ")
                open_.append((iter(child[2]), child[0] in BLOCK))
                break
        else:
            open_.pop()
            if ends:
                out.append([])


def main_text(html: str, template: frozenset[int] = frozenset()) -> str:
    """The main text of a page whose host repeats the subtrees of these hashes."""
    tree = Tree(html).root
    repeated = {i for i, h in subtree_hashes(tree).items() if h in template} if template else set()
    measured: dict[int, tuple[int, int, bool]] = {}
    marked = lambda node, in_article: id(node) in repeated or is_boilerplate(node, in_article)
    source = html.lower()  # what it doesn't hold needn't be looked for
    commented = False  # whether comments can be told from the rest
    every = in_order(tree) if any(w in source for w in COMMENTS) else []
    if any(is_comment(n) for n in every):
        apart = lambda n: marked(n, False) or is_comment(n)
        main = [n for n in every if n[0] in ("article", "main") and not is_comment(n)]
        # what is named for comments may wrap the article as well
        commented = any(True for tag in ("article", "main") for _ in every_of(tree, tag, apart)) if main else size_of([tree], apart) > 0

    def dropped(node: list, in_article: bool) -> bool:
        if marked(node, in_article) or (commented and is_comment(node)):
            return True
        if node[0] in ("article", "main", "body", "html") or not (said := named(node, in_article)):
            return False
        if not measured:
            measured.update(measure(tree, repeated))
        (size, links, holds), whole = measured[id(node)], measured[id(tree)][0]
        return not holds and 2 * size <= whole and (said == 2 or 2 * links >= size or (not in_article and 4 * size <= whole))

    outside = lambda n: dropped(n, False)
    inside = lambda n: dropped(n, True)
    articles, mains = (list(every_of(tree, tag, outside)) if f"<{tag}" in source else [] for tag in ("article", "main"))
    around = size_of(mains, lambda n: n[0] == "article" or inside(n))
    parts = mains if mains and around > (size_of(articles, inside) if articles else -1) else articles
    # articles within: comments and teasers, unless they are most of the text
    more = source.count("<article") > (0 if parts is mains else len(parts))
    within = more and [n for part in parts for child in part[2] if not isinstance(child, str) for n in every_of(child, "article", inside)]
    if within:
        shapes = Counter(shape(n) for n in within)
        own = size_of(parts, lambda n: n[0] == "article" or inside(n))
        gone = {id(n) for n in within if shapes[shape(n)] > 1 and own or size_of([n], inside) < own}
        inside = lambda n: id(n) in gone or dropped(n, True)
    blocks: list[list[str]] = [[]]
    for part in parts:
        blocks_of(part, inside, blocks)
        blocks.append([])
    if not parts:
        blocks_of(tree, outside, blocks)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def extract_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 10, min_share: float = 0.5
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A host's or section's template has at most 1 / min_share times the subtrees of a mean page, so its hashes fit one row; counts
    combine before their shuffle, and html itself is shuffled only if the template table is too large to broadcast.
    """
    section = F.regexp_extract(url_path(F.col(url_col)), r"^/([^/]*)/", 1)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), section.alias("section"), F.col(html_col).cast("binary").alias("html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, every = [], []
            for i, raw in enumerate(b.column("html")):
                own = set(subtree_hashes(Tree((raw.as_py() or b"").decode("utf-8", "replace")).root).values())
                which += [i] * len(own)
                every += own
            yield b.select(["host", "section"]).take(pa.array(which, pa.int64())).append_column("hash", pa.array(every, pa.int64()))

    # each page counts for its host and for its section
    both = F.explode(F.array(F.lit(WHOLE), F.col("section"))).alias("section")
    counts = rows.select("host", "section", "html").mapInArrow(hashes, "host string, section string, hash long").select("host", both, "hash")
    counts = counts.groupBy("host", "section", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    sizes = rows.select("host", both).groupBy("host", "section").agg(F.count(F.lit(1)).alias("n_pages"))
    repeated = counts.join(sizes, ["host", "section"]).filter(F.col("n") >= min_share * F.col("n_pages"))
    template = cut(repeated.groupBy("host", "section").agg(F.collect_set("hash").alias("template")))
    of_host = template.filter(F.col("section") == WHOLE).select(F.col("host").alias("t_host"), F.col("template").alias("of_host"))
    of_section = template.filter(F.col("section") != WHOLE).select(F.col("host").alias("s_host"), F.col("section").alias("s_section"), F.col("template").alias("of_section"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [frozenset(a or ()).union(c or ()) for a, c in zip(b.column("of_host").to_pylist(), b.column("of_section").to_pylist(), strict=True)]
            out = [main_text((raw.as_py() or b"").decode("utf-8", "replace"), t) for raw, t in zip(b.column("html"), known, strict=True)]
            out = [t.encode("utf-8", "replace").decode() for t in out]
            yield b.select(["page_id", "url"]).append_column("text", pa.array(out, pa.string())).append_column("n_chars", pa.array([len(t) for t in out], pa.int64()))

    joined = rows.join(of_host, F.col("host") == F.col("t_host"), "left").join(of_section, (F.col("host") == F.col("s_host")) & (F.col("section") == F.col("s_section")), "left")
    joined = joined.select("page_id", "url", "html", "of_host", "of_section")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return joined.mapInArrow(texts, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
