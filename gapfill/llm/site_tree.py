"""Main text of web pages: a style tree per site tells the branches that matter from those all its pages repeat."""

from __future__ import annotations

import html
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.session import materialize

from .common import map_slices, worker_cache
from .url_filter import parse

#: Every branch starts as important as so many pages that all differ make it; what its own pages say is added to that.
PRIOR_PAGES = 20
#: Below this importance a branch goes. Beside an article it needs that much by its own pages' evidence to stay.
MIN_IMPORTANCE = 0.85
MIN_EVIDENCE = 0.45
#: Branches on a smaller share of a site's pages are not looked up, so that a site's lists are as long as 50 pages have branches.
MIN_SHARE = 0.02
#: Entropy of a branch that is the same in form and all different in content is 1 - PRESENTATION; a proven one is close to it.
PROVEN = 0.87
#: Weight of the presentation (child order) against the content in a branch's importance.
PRESENTATION = 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select title head".split())
#: Elements that end a line of text.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
#: Elements that are never main text.
APART = RAW | frozenset("nav footer aside form button menu dialog label audio video fieldset".split())
#: Words of class, id and role that name such parts.
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disclaimer disqus footer form gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination popup promo promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget widgets alert alerts contentinfo complementary reactions recommended".split()
)
#: Inside an article the tree does not judge these and what they hold: they are what it says, even if pages repeat it.
OWN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
#: Opening one of these ends an open paragraph; opening a key ends an open element of its values.
ENDS_P = BLOCK - {"br", "button", "body", "html", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
#: Implied ends do not look past these.
WALLS = frozenset("table ul ol dl article main section div body html nav aside footer header form blockquote".split())

_START = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|[!?/])")
_REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_REST = re.compile(r"([^>]*)>")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|aria-hidden|hidden)(?![^\s=/>])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _style(attributes: str) -> tuple[str, bool]:
    """What of an element's attributes makes its style, and whether they name a part that is not main text."""
    known = worker_cache("styles")
    if attributes not in known:
        if len(known) >= 4096:
            known.clear()
        known[attributes] = _read_style(attributes)
    return known[attributes]


def _read_style(attributes: str) -> tuple[str, bool]:
    key, apart = [], False
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden":
            apart |= value.lower() in ("", "true", "hidden")
            continue
        key.append(re.sub(r"[0-9]+", "0", value.lower()))
        apart |= any(w in APART_WORDS for w in _WORD.findall(_CAMEL.sub(" ", value).lower()))
    return " ".join(key), apart


class Node:
    """An open element: its path in the style tree, and hashes of what it holds so far."""

    __slots__ = ("apart", "block", "judged", "kids", "main", "path", "tag", "words")

    def __init__(self, tag: str, path: int, apart: bool, main: bool, block: int, judged: bool):
        self.tag, self.path, self.apart, self.main, self.block, self.judged = tag, path, apart, main, block, judged
        self.kids: list[int] = []
        self.words: list[int] = []


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest(repr(parts)) >> 1


def walk(page: str, drop: frozenset[int] = frozenset()) -> tuple[list[tuple[bool, int, str]], list[tuple[int, int, int]]]:
    """Blocks of a page's text, each with whether it lies in an article and the path of its element (0 for the body), and
    the branches that the tree judges.

    A branch is ``(path, hash of its child order, hash of its text)``. Inside an article these are its block elements
    without the article's own paragraphs and headings. Branches named as boilerplate by their element or
    style, and those whose path is in ``drop``, give neither. Works like a browser on unclosed and stray tags.
    """
    blocks: list[tuple[bool, int, str]] = []
    branches: list[tuple[int, int, int]] = []
    text: list[str] = []
    root = Node("", 0, False, False, 0, True)
    open_: list[Node] = [root]

    count: Counter[str] = Counter()

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                blocks.append((open_[-1].main, open_[-1].block, line))
                open_[-1].words.append(_hash(line))

    def close() -> None:
        node = open_[-1]
        if node.tag in BLOCK:
            flush()
        open_.pop()
        count[node.tag] -= 1
        if not node.apart:
            words = _hash(node.words)
            if node.words and (not node.main or node.judged and node.tag in BLOCK and node.tag not in ("article", "main")):
                branches.append((node.path, _hash(node.kids), words))
            if node.words:
                open_[-1].words.append(words)

    at, end = 0, len(page)
    rest = _REST
    while at < end:
        m = _START.search(page, at)
        tail = None
        if m and m[2]:
            tail = rest.match(page, m.end())
            if not tail:  # a quote that never ends: from here on quotes mean nothing, so no tag is read twice
                rest = _PLAIN_REST
                tail = rest.match(page, m.end())
        if not m or m[2] and not tail:
            if not open_[-1].apart:
                text.append(page[at:])
            break
        if m.start() > at and not open_[-1].apart:
            text.append(page[at : m.start()])
        if not m[2]:
            mark = "-->" if m[3] else ">"
            stop = page.find(mark, m.end())
            at = stop + len(mark) if stop >= 0 else end
            continue
        at = tail.end()
        tag = m[2].lower()
        if m[1]:
            if count[tag]:
                while open_[-1].tag != tag:
                    close()
                close()
            elif tag == "p":
                flush()
            continue
        ends = ENDS.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
        if ends:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag in ends:
                    while len(open_) > i:
                        close()
                    ends = ends - {"p"} if tag in ENDS else frozenset()
                    if not ends:
                        break
                elif open_[i].tag in WALLS:
                    break
        if tag in BLOCK:
            flush()
        style, named = _style(tail[1])
        over = open_[-1]
        path = _hash(over.path, tag, style)
        main = over.main or tag in ("article", "main")
        apart = over.apart or tag in APART or path in drop or (named and tag not in ("html", "body", "article", "main", "h1"))
        apart = apart or (tag == "header" and not over.main)
        over.kids.append(path)
        if tag in VOID or tail[1].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW and tag != "head":
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        block = over.block if tag not in BLOCK else 0 if tag in ("html", "body") else path
        open_.append(Node(tag, path, apart, main, block, over.judged and not (main and tag in OWN)))
        count[tag] += 1
    while len(open_) > 1:
        close()
    flush()
    return blocks, branches


def main_text(page: str, drop: frozenset[int] = frozenset(), keep: frozenset[int] = frozenset()) -> str:
    """The article's blocks and those of paths in ``keep``, or all that are left where the page marks no article."""
    blocks, _ = walk(page, drop)
    if any(main for main, _, _ in blocks):
        blocks = [b for b in blocks if b[0] or b[1] in keep]
    return " ".join(line for _, _, line in blocks)


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged trees of all sites: ``host, path, pages, on_pages, importance`` (0: the same everywhere, 1: all differ).

    Every page gives each of its branches that :func:`walk` has once. Counts per branch and content are summed before they
    are shuffled, so a host with most of the pages costs no task more than others. Copies of a page count once.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("host", "page", "path", "kids", "words")}
        for host, page in zip(rows["host"], rows["html"], strict=True):
            page = page or ""
            at: dict[int, list[int]] = {0: [0, 0]}
            for path, kids, words in walk(page)[1]:
                had = at.setdefault(path, [0, 0])
                had[0], had[1] = _hash(had[0], kids), _hash(had[1], words)
            name = xxhash.xxh64_intdigest(page) >> 1
            for path, (kids, words) in at.items():
                for c, v in zip(out, (host, name, path, kids, words), strict=True):
                    out[c].append(v)
        return out

    schema = "host string, page long, path long, kids long, words long"
    seen = map_slices(pages.select("host", "html").filter("host <> ''"), schema, work).distinct()
    size = seen.filter("path = 0").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    both = seen.filter("path <> 0").select("host", "path", F.inline(F.array(*(F.struct(F.lit(k).alias("of"), F.col(k).alias("h")) for k in ("kids", "words")))))
    counts = both.groupBy("host", "path", "of", "h").agg(F.count(F.lit(1)).alias("n"))
    # entropy of the values a branch takes, as a share of the most it could be
    spread = counts.groupBy("host", "path", "of").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    entropy = F.when(F.col("m") > 1, (F.log2("m") - F.col("nlogn") / F.col("m")) / F.log2("m")).otherwise(F.lit(1.0))
    weight = F.when(F.col("of") == "kids", PRESENTATION).otherwise(1 - PRESENTATION)
    tree = spread.groupBy("host", "path").agg(F.max("m").alias("on_pages"), F.sum(entropy * weight).alias("importance"))
    return tree.join(size, "host")


def noise(tree: DataFrame, prior_pages: float = PRIOR_PAGES, min_importance: float = MIN_IMPORTANCE, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, drop, keep``: the paths that go, and those proven important.

    A branch on m pages with an entropy e counts as (m e + ``prior_pages``) / (m + ``prior_pages``): on few pages nothing
    but many equal contents makes it unimportant, on many pages its own entropy decides. Every site is judged.
    """
    common = tree.filter(F.col("on_pages") >= min_share * F.col("pages"))
    seen = F.col("on_pages") * F.col("importance") / (F.col("on_pages") + prior_pages)
    low = seen + F.lit(prior_pages) / (F.col("on_pages") + prior_pages) < min_importance
    proven = (F.col("importance") > PROVEN) & (seen >= MIN_EVIDENCE - 1e-9)
    paths = {"drop": F.when(low, F.col("path")), "keep": F.when(~low & proven, F.col("path"))}
    lists = common.groupBy("host").agg(*(F.collect_set(c).alias(n) for n, c in paths.items()))
    return lists.filter((F.size("drop") > 0) | (F.size("keep") > 0))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    Branches whose importance in their site's tree is low go, and so do parts that their element or style names as
    menu, header, footer, sidebar, notice, advert, form or comments. An article (``article``, ``main``) is main text by its
    name: its paragraphs and headings stay even if many pages share them, unless a part around them goes. Beside an article,
    blocks stay whose own branch is important by the evidence of many pages; text right in the body never has it. Null or empty html gives empty text; a
    null url or one without a host belongs to no site. Repeated rows are extracted each.
    """
    hosted = pages.select("page_id", "url", "html", parse(F.col("url"))["host"].alias("host"))
    drops = materialize(noise(style_tree(hosted)), "site-noise")
    joined = hosted.join(drops, "host", "left")
    id_kind = pages.schema["page_id"].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        texts = [main_text(h or "", frozenset(d or ()), frozenset(k or ())) for h, d, k in zip(rows["html"], rows["drop"], rows["keep"], strict=True)]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": list(map(len, texts))}

    return map_slices(joined.select("page_id", "url", "html", "drop", "keep"), f"page_id {id_kind}, url string, text string, n_chars long", work)
