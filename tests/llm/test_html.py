from __future__ import annotations

import html as entities
import itertools
import random
import re

from voxcohort.llm import html, queries

SF = "/root/testdata/sf0.001"


def article(page):
    """The blocks of the one article, by splitting at its block tags."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|div)>", inner)
    return "\n\n".join(t for t in (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts) if t)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op2_page_differencing(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
    assert sum(r.n_template > 0 for r in got) > 0


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    return {r.page_id: r.text for r in html.extract(df).collect()}


def test_markup(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><li>Home</nav><header>Site</header>
    <div id="cookie-notice">We use <b>cookies</b></div><aside>Side</aside>
    <article><header><h1>Title &amp; more</h1></header><p>One&nbsp;two
      three<br>four <a title="a>b" href=x>link</a>ed</p><script>if (a < b) "</p>"</script><p>Five<p>Six
      <div class="ad">Buy</div><ul><li>x<li>y</ul><form>Name <input></form>
      <section class="comments"><article class="comment"><p>I disagree</p></article></section></article>
    <footer>&copy; me</footer></body></html>"""
    got = texts(spark, [(1, "http://a/x", page, "clash"), (2, None, None, None), (3, "http://a", "", None), (4, "", "plain text < 3", None), (5, "u", "<article>cut &am", None)])
    assert got == {1: "Title & more\n\nOne two three four linked\n\nFive\n\nSix\n\nx\n\ny", 2: "", 3: "", 4: "plain text < 3", 5: "cut &am"}


def test_differencing_without_an_article_element(spark):
    def page(i, body):
        return f"<body><div>The Daily</div><div>Menu of the day</div>{''.join(f'<p>{b}</p>' for b in body)}<div>All rights</div></body>"

    rows = [(i, f"http://h{i % 2}.org/news/{i}?q={i}", page(i, [f"story {i} has a long first paragraph", f"and a second one {i * 7}"]), None) for i in range(20)]
    got = texts(spark, rows)
    assert got == {i: f"story {i} has a long first paragraph\n\nand a second one {i * 7}" for i in range(20)}
    # A copy of a page is no template; a page alone on its host keeps all.
    twins = [(1, "http://h/a/1", page(1, ["same story on two pages here"] * 3), None), (2, "http://h/a/2", page(1, ["same story on two pages here"] * 3), None), (3, "http://h/a/3", page(1, ["another story altogether, longer than the rest"]), None), (4, "http://alone/x", page(1, ["mine"]), None)]
    got = texts(spark, twins)
    assert got[2] == "\n\n".join(["same story on two pages here"] * 3)
    assert got[3] == "another story altogether, longer than the rest"
    assert got[4].startswith("The Daily")


def test_borders_make_no_difference(spark):
    rows = [(i, f"http://host/p/{i:03}", f"<p>head</p><p>text number {i} is its own</p><p>foot</p>", None) for i in range(60)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in (1, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            out.append(texts(spark, rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out[0] == out[1] == out[2] == {i: f"text number {i} is its own" for i in range(60)}


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(8))] for _ in "ab")
        got = html.common(a, b)
        assert got == sorted(set(got))
        rest = iter(b)
        assert all(any(a[i] == x for x in rest) for i in got)
        best = max(n for n in range(len(a) + 1) if any(_inside(c, b) for c in itertools.combinations(a, n)))
        assert len(got) == best


def _inside(c, b):
    rest = iter(b)
    return all(any(x == y for y in rest) for x in c)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(df).count() == 0


def test_repeated_rows_and_runs_of_copies(spark):
    """A row given twice is one page among its neighbours; pages among copies lose their template and keep their text."""
    page = lambda *body: f"<div>The Daily</div><div>Menu</div>{''.join(f'<p>{b}</p>' for b in body)}<div>All rights</div>"
    rows = [(i, f"http://h/{i:02}", page(f"story {i} of the day", f"its end {i}"), None) for i in range(8)]
    rows += [rows[3], rows[3]]
    same = page("one story", "on many pages")
    rows += [(20 + i, f"http://h/05{i}", same, None) for i in range(2)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(parts)
        got = [(r.page_id, r.text) for r in html.extract(df).collect()]
        want = [(i, f"story {i} of the day\n\nits end {i}") for i in (*range(8), 3, 3)] + [(20 + i, "one story\n\non many pages") for i in range(2)]
        assert sorted(got) == sorted(want)


def test_shared_lines_by_votes():
    assert html.shared([1, 5, 6, 9], [0] * 4, [[1, 7, 9], [1, 8, 5, 9], [1, 2, 9]]) == [0, 3]  # 5 is shared with one of three
    assert html.shared([1, 5, 9], [0] * 3, [[1, 5, 9], [1, 5, 9]]) == []  # copies
    assert html.shared([1, 5, 9], [0, 2, 1], [[1, 5, 9, 4]]) == [2]  # all open lines are shared: a near copy
    assert html.shared([1], [0], []) == []
