import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starledger.llm import html

from .fixtures import frame


@pytest.mark.parametrize("page,text", [
    ("<nav>x</nav><article><h1>Title</h1><p>One  two\n three<p>Four</article><footer>y</footer>", "Title One two three Four"),
    ("<body><header>h</header><main><p>a&amp;b &lt;i&gt; &#233;&nbsp;x</p><aside>no</aside></main>", "a&b <i> é x"),
    ("<article><p><b>Bold<br><p>mid<i>dle</i> <a href='x>y'>link</a></article>", "Bold middle link"),
    ("<article><p>t</p><script>var a='</p>';</script><style>p{}</style><!-- <p>c</p> --><form><p>f</p></form><div class='cookie-notice'>n</div><section id=comments><p>c</p></section><p>u", "t u"),
    ("<div class=content><p>only</p></div><div class='sidebar left'>s</div><div role=navigation>n</div><div hidden>h</div>", "only"),
    ("plain text", "plain text"), ("", ""), (None, ""), ("<", "<"), ("<article></article>", ""), ("a < b and c > d", "a < b and c > d"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y</ul><pre>a\n  b</pre></article>", "1 2 3 x y a b"),
    ("<article><p>read<article class=comment><p>reader</article></article>", "read"),
    ("<ARTICLE><P>Case</P></ARTICLE><SCRIPT>x</SCRIPT>", "Case"),
    ("<article><p>cut off <b", "cut off"), ("<article><p>x<script>never closed", "x"),
])
def test_main_text(page, text):
    assert html.extract(page) == text


def site(i, body):
    return f"<html><body><div class=top>My Site</div><div class=box><div class=crumbs>Home</div><div class=story><h2>Story {i}</h2>{body}</div><div class=share-it>Share now</div></div><div class=bottom>All rights 2024</div></body></html>"


def test_wrapper_of_a_site_without_semantic_elements():
    pages = [site(i, "".join(f"<p>Paragraph {i}.{j} with words</p>" for j in range(i + 2))) for i in range(4)]
    wrapper = html.induce(pages)
    assert wrapper["region"][-1] == "div.story"
    assert html.extract(pages[1], wrapper) == "Story 1 Paragraph 1.0 with words Paragraph 1.1 with words Paragraph 1.2 with words"
    assert "My Site" in html.extract(pages[1])  # nothing is known without other pages
    assert html.induce(pages[:1] * 3) == html.induce([]) == {"region": [], "template": []}


def test_region_takes_its_headline_in():
    pages = [f"<body><div class=a>Site</div><div class=page><h1>News {i}</h1><div class=text><p>Words {i} of this page</p><p>{'more ' * i}</p></div><div class=b>Site words</div></div></body>" for i in range(3)]
    wrapper = html.induce(pages)
    assert wrapper["region"][-1] == "div.page"
    assert html.extract(pages[2], wrapper) == "News 2 Words 2 of this page more more"


def test_tree_match():
    a, b = (html.merged(html.parse(x)) for x in ("<div><h1>a</h1><p>x</p><ul><li>1</ul></div>", "<div><p>y</p><p>z</p><ul><li>1<li>2</ul></div>"))
    size, pairs = html.tree_match(a, b)
    assert size == 5 and [x.label for x, _ in pairs] == ["#", "div", "ul", "li", "p"] or size == len(pairs) == 5


def test_table_of_pages(spark):
    rows = [(i, f"http://User@Host{i % 2}.org:80/{i}", site(i, f"<p>Body {i}</p>")) for i in range(12)] + [(20, None, "<article>x</article>"), (21, "http://h/", None), (22, "no url", ""), (23, "https://one.org/a", site(9, "<p>z")), (24, "http://host0.org/q", site(0, "<p>Body 0</p>"))]
    df = spark.createDataFrame([(*r, "w", "h") for r in rows], "page_id long, url string, html string, wrapper string, host string")
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    assert len(got) == len(rows) and all(got[i]["text"] == f"Story {i} Body {i}" for i in range(12))
    assert (got[20]["text"], got[21]["text"], got[22]["text"], got[24]["text"]) == ("x", "", "", "Story 0 Body 0")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.main_text(df.limit(0)).count() == 0


def test_contract_query_on_real_pages(spark, sf_dir):
    import re

    from html import unescape

    from starledger.llm.queries import op1_html_extraction

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op1_html_extraction(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 2000
    assert html.extract(deep) == "x"
    df = frame(spark, [(1, "x")]).selectExpr("doc_id as page_id", "'http://d/' as url", "text as html").limit(0)
    two = spark.createDataFrame([(1, "http://d/", deep), (2, "http://d/", deep + "y")], df.schema)
    assert {r["page_id"]: r["text"] for r in html.main_text(two).collect()} == {1: "x", 2: "x y"}


def test_template_inside_articles_goes(spark):
    def page(i):
        return f"<body><article><h1>Title {i}</h1><div class=by>From our own staff</div><div class=story><p>Words {i} of a story</p><p>{'more words ' * (i + 3)}</p></div><div class=tell>Tell a friend</div></article><div class=end>The end</div></body>"

    body = [f"Title {i} Words {i} of a story {' '.join(['more words'] * (i + 3))}" for i in range(8)]
    wrapper = html.induce([page(i) for i in range(4)])
    assert html.extract(page(2), wrapper) == body[2]
    assert "Tell a friend" in html.extract(page(2))  # nothing is known without other pages
    # A region inside an article that doesn't hold nearly all of its text doesn't stand for it.
    odd = "<body><article><h1>T</h1><p>Long words before a story that are not template at all</p><div class=story><p>w</p></div></article></body>"
    assert html.extract(odd, {"region": ["#", "body", "article", "div.story"], "template": []}).startswith("T Long words")
    got = html.main_text(spark.createDataFrame([(i, "http://h/", page(i)) for i in range(8)], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == dict(enumerate(body))


def rich(i):
    """A page with many and long-named constant parts, without article or main; each list item ends in constant words."""
    frame = "".join(f"<div class='part-with-a-rather-long-name-{c} and-another-long-name-{c}'><div class=inner-part-of-long-name>Constant words {c}</div></div>" for c in "abcdefghijklmnopqrstuvwxyz")
    items = "".join(f"<div class=item><div class=what>Item {i} {j} has words</div><div class=tell>Tell a friend</div></div>" for j in range(i % 3 + 2))
    return f"<body>{frame}<div class=list>{items}</div></body>"


def test_many_constant_parts_and_an_odd_page(spark, monkeypatch):
    rows = [(i, "http://rich/", rich(i)) for i in range(30)]
    rows += [(100 + i, "http://rich/", f"<body><ul class=odd><li>Not found {i}</ul></body>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert all(first[i] == " ".join(f"Item {i} {j} has words" for j in range(i % 3 + 2)) for i in range(30))
    assert all(first[100 + i] == f"Not found {i}" for i in range(8))
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == first


def test_an_odd_reference_page():
    pages = [site(i, f"<p>Paragraph {i} with words</p>") for i in range(3)]
    odd = "<body><ul class=all><li>One of a list of pages<li>Another one of a list of pages</ul></body>"
    marks = set.intersection(*(set(html.marks_of(p)) for p in pages))
    assert len(marks) == 3 and html.induce([odd, *pages], marks)["region"][-1] == "div.story"
    assert html._all_text(html.merged(html.parse(pages[0]))).split() == html._all_text(html.parse(pages[0])).split()


def test_a_copied_article_is_no_template(spark):
    rows = [(i, "http://copies/", f"<article><p>The same long story on every page of this host</p><p>{i}</p></article>") for i in range(6)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"The same long story on every page of this host {r['page_id']}" for r in got)


def plain_match(a, b):
    """The size of the largest order-keeping match of two trees, tried in every way."""
    if a.label != b.label:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), *(plain_match(xs[0], y) + best(xs[1:], ys[j + 1 :]) for j, y in enumerate(ys)))

    return 1 + best(a.children, b.children)


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.sampled_from(["<p>x</p>", "<h2>y</h2>"]), lambda inner: st.tuples(st.sampled_from(["div", "ul", "section"]), st.lists(inner, max_size=4)).map(lambda t: f"<{t[0]}>{''.join(t[1])}</{t[0]}>"), max_leaves=8), st.data())
def test_tree_match_equals_every_way(first, data):
    second = data.draw(st.sampled_from([first, first.replace("<h2>y</h2>", ""), "<div>" + first + "</div>", first + "<p>z</p>"]))
    a, b = html.parse(first), html.parse(second)
    size, pairs = html.tree_match(a, b)
    assert size == plain_match(a, b) == len(pairs) and all(x.label == y.label for x, y in pairs)


def test_a_very_long_page(spark):
    long = "<body><article>" + "".join(f"<p>Paragraph {i} of very many</p>" for i in range(100_000)) + "</article></body>"
    rows = [(1, "http://long/", long), (2, "http://long/", "<article><p>short</p></article>")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: " ".join(f"Paragraph {i} of very many" for i in range(100_000)), 2: "short"}


@pytest.mark.parametrize("page,text", [
    ("<p>Hello <span class='ad'>x</span> world</p><p>Next</p>", "Hello world Next"),
    ("<article>Intro <span class=related>r <span>s</span> t</span> tail text <p>para one</p><p>two</p></article>", "Intro tail text para one two"),
    ("<p>a <b><span class=ad>x</b> b</p><p>c <span class=ad>never ended</p><p>d", "a b c d"),
    ("<p>seen <span hidden>not</span><b hidden>nor <i>this</i></b> again</p>", "seen again"),
    ("<div class='layout has-sidebar'><article><p>Story</p></article></div>", "Story"),
    ("<div class='content no-sidebar'><p>Story</p></div>", "Story"),
    ("<div class='promo-wrap'><article><p>Story</p></article><div class=x>Much more text than the story has</div></div>", "Story"),
    ("<div class='share-box'>s</div><div class=nav-page><p>Nearly all of the text of a page</p></div>", "Nearly all of the text of a page"),
    ("<div class=sidebar><article><p>Story</p></article></div>", "Story"),
    ("<div class=text><p>Story</p></div><section id=comments><article><p>a reader's long words, much longer than it</p></article></section>", "Story"),
    ("<div class=text><p>Story</p></div><section class=post-comments><article><p>a reader's long words, much longer than it</p></article></section>", "Story"),
    ("<article><p>Story</p><div class=promo><p>Buy</p></div></article>", "Story"),
    ("<div>" * 600 + "<nav><ul><li>Menu</ul></nav><p>Story</p>", "Story"),
])
def test_telling_names_and_spans(page, text):
    assert html.extract(page) == text


def test_template_goes_even_where_it_is_most_of_an_article(spark):
    rows = [(i, "http://h/", f"<article><p>The own words {'abcdefgh'[i]} of it</p><p>A long sentence that stands on every page here</p><p>And another one that stands on every page</p></article>") for i in range(8)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"The own words {'abcdefgh'[i]} of it" for i in range(8)}
    two = html.main_text(spark.createDataFrame(rows[:2], "page_id long, url string, html string")).collect()
    assert all(r["text"].endswith("on every page") for r in two)  # two pages may be near copies


def test_many_blocks_are_aligned_quickly():
    import time

    def page(i, n):
        return "<body><div class=story>" + "".join(f"<h3>Head {i} {j}</h3><p>Words {i} {j}</p>" for j in range(n)) + "</div><div class=end>The end</div></body>"

    began = time.perf_counter()
    assert html.induce([page(i, 900 + i) for i in range(4)])["region"][-1] == "div.story"
    assert time.perf_counter() - began < 2


@pytest.mark.parametrize("cells", [1, 6, 40])
def test_halved_rows_match_as_well(cells, monkeypatch):
    import random

    monkeypatch.setattr(html, "TABLE_CELLS", cells)
    rng = random.Random(cells)
    for _ in range(60):
        a, b = (html.parse("<div>" + "".join(rng.choice(["<p>x</p>", "<h2>y</h2>", "<ul><li>1<li>2</ul>", "<ul><li>1</ul>"]) for _ in range(rng.randrange(7))) + "</div>") for _ in range(2))
        size, pairs = html.tree_match(a, b)
        assert size == plain_match(a, b) == len(pairs)


def test_pages_of_any_depth():
    deep = "<div>" * 200_000 + "x" + "<p>y"
    assert html.extract(deep) == "x y"
    assert html.induce(["<div>" * 50_000 + f"<p>word {c}" for c in "ab"])["region"] == ["#"] + ["div"] * 50_000
