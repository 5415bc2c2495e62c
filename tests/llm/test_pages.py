"""URL filter and page extraction on small sites."""

import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest

from gapfill.llm import site_tree as st
from gapfill.llm import url_filter as uf

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://a.EXAMPLE.net/de/1", "a.example.net", "/de/1", "net/", "block"),
        ("http://a.example.net/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.net/", "x.net", "/", "net/", "block"),
        ("ftp://net/?q=http://b.org/", "net", "/", "net/", "block"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_given_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url), (1, url), (None, url)], "page_id long, url string").selectExpr("*", "1 as host", "2 as tokens")
    rows = uf.judge(pages, pages.selectExpr("url", "false as bad").limit(0)).collect()
    assert len(rows) == 3 and {(r.host, r.path, r.rule, r.verdict) for r in rows} == {(host, path, rule, verdict)}


def test_mined_rules(spark):
    rows = [(f"http://www.good{i}.com/en/{i}", False) for i in range(60)] + [(f"http://www.bad-pills.com/de/{i}", True) for i in range(30)]
    rows += [("http://www.good1.com/en/5", None), (None, True)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    mined = {tuple(r.antecedent): (r.verdict, r.confidence, r.support) for r in uf.mine(labelled).collect()}
    assert mined["word:bad",] == ("block", 1.0, 30) and mined["dir:de", "name:bad-pills"] == ("block", 1.0, 30)
    assert all(c >= uf.MIN_CONFIDENCE and s >= uf.MIN_COUNT for _, c, s in mined.values())
    pages = spark.createDataFrame([(1, "http://x.bad-pills.com/zz/9"), (2, "http://www.good7.com/en/2"), (3, "http://other.info/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in uf.judge(pages, labelled).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}
    assert uf.judge(pages.limit(0), labelled).count() == 0 and uf.mine(labelled.limit(3)).count() == 0


def test_rules_from_any_part_of_a_url(spark):
    """A label that depends on a deep segment, a later host word or a query name, rare beside the other."""
    bad = lambda i: [f"http://a{i}.x.com/s/t/{i}/casino/v", f"http://b{i}.win-big-fast.com/s", f"http://c{i}.y.com/s?id=1&refer={i}"]
    rows = [(u, True) for i in range(8) for u in bad(i)] + [(f"http://{k}{i}.x.com/s/t/{i}?id=2", False) for i in range(100) for k in "de"]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    asked = {1: "http://n.com/q/r/casino/", 2: "https://very-fast.org/", 3: "http://n.com/?a&refer", 4: "http://n.com/s/t?id=7", 5: "http://n.org/" + "deep/" * 3_000}
    pages = spark.createDataFrame([(k, u) for k, u in asked.items()] * 2 + [(None, None)], "page_id long, url string")
    got = [(r.page_id, r.verdict) for r in uf.judge(pages, labelled).collect()]
    assert sorted(got, key=str) == sorted([(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow")] * 2 + [(None, "allow")], key=str)


def test_planted_blocks_are_found_in_the_given_tables(spark):
    """Labels that a query name decides: every page of that kind without a given rule is blocked, and no other."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rows = uf.judge(pages, pages.filter("page_id % 3 = 0").selectExpr("url", "url like '%utm_source%' as bad")).join(pages, "page_id").collect()
    mined = [r for r in rows if r.rule is None]
    assert len(mined) > 500 and {("utm_source" in r.url, r.verdict) for r in mined} == {(True, "block"), (False, "allow")}


def test_ties_between_rules_go_to_the_last_in_order(spark):
    mined = spark.createDataFrame([(["a"], "block", 2.0, 1.0, 5), (["b"], "allow", 2.0, 1.0, 5), (["a", "b"], "block", 2.0, 0.9, 9)],
                                  "antecedent array<string>, verdict string, lift double, confidence double, support long")
    got = uf.match(spark.createDataFrame([(["a", "b"],)], "tokens array<string>"), mined).first()["mined"]
    assert (got.mined_rule, got.verdict) == ("b", "allow")


@pytest.mark.parametrize("limit", [uf.MAX_BROADCAST_HOSTS, 0])
def test_joins_give_the_same_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(uf, "MAX_BROADCAST_HOSTS", limit)
    monkeypatch.setattr(uf, "MAX_BROADCAST_RULES", limit)
    rows = [(i, f"http://www.x{i % 3}.net/{'en' if i % 2 else 'de'}/{i}") for i in range(40)] + [(99, "http://q.com/z")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in uf.judge(pages, pages.selectExpr("url", "true as bad")).collect()}
    assert got == {i: 'block' for i in range(40)} | {99: 'allow'}


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>a<p> b\n c", "a b c"),
        ("a &amp;amp; b&nbsp;c<br>d", "a &amp; b c d"),
        ("<body><nav>n</nav><div class='sidebar'>x</div><div>y</div><footer>f", "y"),
        ("<article><h1>T</h1><p>Hi<!-- c --> <b>th</b>ere<div id='comments'><p>no</div><form>q</form><p>x</article>z", "T Hi there x"),
        ("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "1 2 3 4"),
        ("</p>x</div><script>if(a<b)</script>t<style>p{}", "xt"),
        ("<a href='", "<a href='"),
        ("a<b", "a<b"),
    ],
)
def test_main_text(page, text):
    assert st.main_text(page or "") == text


def test_site_tree_finds_what_all_pages_repeat(spark):
    def page(i):
        return f"<body><div class='top'>Our motto</div><div class='text'><p>Story {i} of this site.</p></div><div class='end'><p>All rights {'x' * (i % 2)}</p></div>"

    rows = [(i, f"http://Site.com/{i}", page(i)) for i in range(20)] + [(50, "http://small.com/", page(1)), (51, None, page(2)), (None, "http://site.com/n", None)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as text", "'h' as host").repartition(3)
    got = {r.page_id: r for r in st.extract(pages).collect()}
    assert got[3].text == "Story 3 of this site." and got[3].n_chars == 21
    assert got[50].text == "Our motto Story 1 of this site. All rights x" and got[None].text == ""
    assert got[51].text.startswith("Our motto") and st.extract(pages.limit(0)).count() == 0


def test_copies_of_a_page_do_not_make_its_text_noise(spark):
    rows = [(i, "http://a.com/", "<div><p>The same story.</p></div>") for i in range(30)]
    assert {r.text for r in st.extract(spark.createDataFrame(rows, PAGES)).collect()} == {"The same story."}


def test_nested_and_long_pages_are_linear():
    assert st.main_text("<div>" * 30_000 + "x") == "x"
    assert st.main_text('<a href="' * 30_000)
    assert len(st.main_text("<p>word " * 50_000)) == 250_000 - 1
    assert st.main_text("<b></i>" * 30_000 + "x") == "x"


def test_tree_judges_inside_and_beside_articles(spark):
    def whole(i):
        return f"<main><div class='upper'><p>Our motto</p></div><div class='inner'><p>Story {i} <b>as told</b>.</p></div><p>Same end</p></main>"

    def cards(i):
        return f"<div class='upper'>Our motto</div><div class='inner'><p>Story {i} in full.</p></div><article class='card'><h2>Other {i % 3}</h2></article>"

    rows = [(i, "http://whole.com/", whole(i)) for i in range(20)] + [(100 + i, "http://cards.com/", cards(i)) for i in range(20)]
    rows += [(200, "http://small.com/", cards(0))]
    got = {r.page_id: r.text for r in st.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert got[3] == "Story 3 as told. Same end" and got[104] == "Story 4 in full. Other 1" and got[200] == "Other 0"


class _Dom(HTMLParser):
    """Elements of a well-formed page with their path, the paths of their children and what they say."""

    def __init__(self, page):
        super().__init__()
        self.found, self.open = {}, [(0, [], [])]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        path = st._hash(self.open[-1][0], tag, " ".join(re.sub("[0-9]+", "0", v) for _, v in attrs))
        self.open[-1][1].append(path)
        self.open.append((path, [], []))

    def handle_data(self, data):
        self.open[-1][2].append(data)

    def handle_endtag(self, tag):
        path, kids, said = self.open.pop()
        if said:
            self.found.setdefault(path, []).append((tuple(kids), tuple(said)))
            self.open[-1][2].append(tuple(said))


def _entropy(values):
    counts, m = Counter(values), len(values)
    return -sum(n / m * math.log2(n / m) for n in counts.values()) / math.log2(m) if m > 1 else 1.0


def test_style_tree_against_plain_entropies(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["ant", "bee", "cat", "dog"])
    rows = []
    for i in range(60):
        extra = f"<div class='x{i % 3}'><p>{word()}</p><p>{word()}</p></div>" * rng.randint(0, 2)
        page = f"<div class='top'><p>{word()}</p></div><section><div class='deep'><p>{i // 2}</p></div></section>{extra}"
        rows.append((i, f"http://{rng.choice(['a.com', 'b.org'])}/{i}", page))
    rows += rows[:10]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "regexp_extract(url, '//([^/]+)', 1) as host")
    got = {(r.host, r.path): (r.pages, r.on_pages, r.importance) for r in st.style_tree(pages).collect()}
    sites = {}
    for _, url, page in rows:
        sites.setdefault(url.split("/")[2], set()).add(page)
    want = {}
    for host, distinct in sites.items():
        doms = [_Dom(page).found for page in sorted(distinct)]
        for path in {p for d in doms for p in d}:
            kids, said = zip(*[(tuple(k for k, _ in d[path]), tuple(w for _, w in d[path])) for d in doms if path in d])
            share = st.PRESENTATION * _entropy(kids) + (1 - st.PRESENTATION) * _entropy(said)
            want[host, path] = (len(doms), len(kids), pytest.approx(share, abs=1e-9))
    assert got == want


def test_the_tree_decides_where_nothing_is_named(spark):
    """The given pages without element names: on sites with many pages the tree finds the adverts and keeps the articles."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    named = {r.page_id: r.text for r in st.extract(pages).collect()}
    plain = pages.selectExpr(
        "page_id", "url", """replace(replace(replace(html, '<div class="ad">', '<div class="ux">'), '<article>', '<div class="uy">'), '</article>', '</div>') as html"""
    )
    by_tree = {r.page_id: (r.url.split("/")[2], r.text) for r in st.extract(plain).collect()}
    alone = {r.page_id: st.main_text(r.html) for r in plain.collect()}
    changed = [i for i, (_, text) in by_tree.items() if text != alone[i]]
    assert len(changed) > 250 and all(by_tree[i][1] == named[i] for i in changed)
    large = [i for i, (host, _) in by_tree.items() if host in ("blog.tionsh.example.com", "tionble.example.org")]
    assert len(large) > 400 and all(by_tree[i][1] == named[i] for i in large)
    assert all(text.endswith(named[i]) for i, (_, text) in by_tree.items())


def test_long_pages_and_clashing_columns_with_a_tree(spark):
    long = "<div class='end'>Same end</div><div><p>" + "word " * 100_000 + "</p></div>"
    rows = [(i, "http://a.com/", long.replace("word", f"w{i}")) for i in range(12)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as `drop`", "'y' as keep", "1 as host", "2 as path")
    got = {r.page_id: r.text for r in st.extract(pages).collect()}
    assert all(got[i] == " ".join([f"w{i}"] * 100_000) for i in range(12))
