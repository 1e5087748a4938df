import random

from tallyforge.llm import html


def text_of(page):
    return [t for z, t in html.page_lines(page) if z == html._MAIN]


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


def test_shared_lines_are_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(3)
    for limit in (None, 1):
        for _ in range(400):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
            if limit is None:
                found = html.shared_lines(a, b)
            else:  # the halving path: compare lengths of prefixes
                head, tail = html._lengths(a, b), html._lengths(a[::-1], b[::-1])[::-1]
                assert head[-1] == lcs_length(a, b) == tail[0]
                continue
            picked = [a[i] for i in sorted(found)]
            assert len(picked) == lcs_length(a, b)
            rest = iter(b)
            assert all(x in rest for x in picked)
    long = [str(i % 7) for i in range(13_000)]
    assert len(html.shared_lines(["x", *long, "y", "q"], ["z", *long[::-1], *long, "w"])) == 13_000


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li>A<li>B</ul></nav><!-- c --><div class="ad">Buy</div>
    <article><header><h1>Head &amp; line</h1></header><p><b>One  &eacute;&#233;<br><p>Tw<i>o</i>\n 3 &lt; 4</p><aside>Side</aside>
    <div class="share-links">Share</div><form><input value="x"><label>Name</label></form><p>Three<script>no</script> four</p>
    <ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><section id="comments"><article>Me too</article></section></article>
    <footer>&copy; F</footer>"""
    assert text_of(page) == ["Head & line", "One éé", "Two 3 < 4", "Three four", "x", "y", "c1", "c2"]
    assert html.page_lines(None) == html.page_lines("") == html.page_lines("<p> \n </p>") == []
    assert text_of("<main>a < b and 1<2 <a title='>' href=x>c</a><p title=\"unclosed>d</p></main>e") [:1] == ["a < b and 1<2 c"]
    assert text_of("<article><p class=ad>x<p>y</article><p>z") == ["y"]
    assert text_of('<div class="layout has-sidebar"><article><div class="article-header"><h1>T</h1></div>x</article></div>') == ["T", "x"]
    assert text_of('<div class="page-sidebar"><article>x</article></div>') == []
    assert text_of("<article>a<span class='ad'>b</span>c</article>") == ["a", "c"]


def test_differencing(spark):
    menu, foot = "<div>Home</div><div>About us</div>", "<div>All rights</div>"
    rows = [(1, "http://h/a/1", f"{menu}<div>First story.</div>{foot}"), (2, "http://H/a/2?x", f"{menu}<div>Second &amp; story.</div>{foot}"),
            (3, "http://h/b/3", f"{menu}<div>Third story.</div>{foot}"), (4, "http://other/a/1", "<div>Alone</div>"),
            (5, "http://copy/1", "<div>Same</div>"), (6, "http://copy/2", "<div>Same</div>"),
            (7, "http://art/1", "<nav>N</nav><article>Told twice</article><div>x</div>"),
            (8, "http://art/2", "<nav>N</nav><article>Told twice</article>"),
            (9, None, None), (None, None, "<div>No id</div>"), (1, "http://h/a/1", f"{menu}<div>First story.</div>{foot}"),
            (10, "http://long/1", "<article>" + "<p>word " * 40_000 + "</article>")]
    pages = spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, key int, text string")
    got = sorted((tuple(r) for r in html.extract(pages).collect()), key=lambda r: (r[0] or -1, r[1] or ""))
    texts = [(r[0], r[2]) for r in got if r[0] != 10]
    assert texts == [(None, "No id"), (1, "First story."), (1, "First story."), (2, "Second & story."), (3, "Third story."), (4, "Alone"),
                     (5, "Same"), (6, "Same"), (7, "Told twice"), (8, "Told twice"), (9, "")]
    assert [r[3] for r in got] == [len(r[2]) for r in got]
    assert got[-1][2] == " ".join(["word"] * 40_000)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pairs_share_most_segments(spark):
    """No page of the host shares more leading segments than the partner, however paths are spelt and ranges are cut."""
    rng = random.Random(2)
    names = ["a", "a-b", "a.b", "b", "b~", "c"]
    rows = [("hot" if i % 3 else f"h{rng.randrange(5)}", "/".join(["", *(rng.choice(names) for _ in range(rng.randint(1, 4)))]), i) for i in range(300)]
    rows += [("alone", "/x", 900), ("dash", "/a/b", 901), ("dash", "/a/b-x/1", 902), ("dash", "/a/b/c", 903)]
    of = {key: (host, path.split("/")) for host, path, key in rows}

    def shared(i, j):
        return next((k for k, (x, y) in enumerate(zip(of[i][1], of[j][1], strict=False)) if x != y), min(len(of[i][1]), len(of[j][1])))

    seen = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r.key: r.partner for r in html.nearest_pages(spark.createDataFrame(rows, "host string, path string, key long")).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        seen.append(got)
        assert set(got) == set(of) - {900}
        for key, partner in got.items():
            others = [j for j in of if j != key and of[j][0] == of[key][0]]
            assert partner in others and shared(key, partner) == max(shared(key, j) for j in others)
    assert seen[0] == seen[1] and seen[0][901] == 903


def test_differencing_decides_on_pages_that_declare_articles(spark):
    """A declared element that the nearest page has too is a template, one with a line of its own is whole, and a page's text may lie outside of all."""
    card, menu = "<article class='card'><h2>Our shop</h2><p>Buy two</p></article>", "<div>Home</div>"
    rows = [(1, "http://h/a/1", f"{menu}<article><p>One.</p><p>Told by all.</p></article>{card}"),
            (2, "http://h/a/2", f"{menu}<article><p>Two.</p><p>Told by all.</p></article>{card}"),
            (3, "http://t/b/1", f"{menu}{card}<div>A long story that no element declares.</div>"),
            (4, "http://t/b/2", f"{menu}{card}<div>Another long story without an element.</div><div class='sidebar'>Side</div>"),
            (5, "http://c/1", f"{menu}<main><p>Copied.</p></main>"), (6, "http://c/2", f"{menu}<main><p>Copied.</p></main>"),
            (7, "http://alone/1", f"<div>A menu of many words and no partner</div>{card}"),
            (8, "http://e/1", f"<div>A text of many words beside an empty page</div>{card}"), (9, "http://e/2", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert texts == {1: "One. Told by all.", 2: "Two. Told by all.", 3: "A long story that no element declares.",
                     4: "Another long story without an element.", 5: "Copied.", 6: "Copied.", 7: "Our shop Buy two",
                     8: "Our shop Buy two", 9: ""}
