import html
import random
import re

from glasswatch.llm import pagediff

from .helpers import SMALL, rows


def test_alignment_is_longest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        marks = pagediff.shared(a, b)
        rest = iter(b)
        assert sum(marks) == best[-1][-1] and all(x in rest for x, m in zip(a, marks) if m)


def test_meaning_of_markup():
    page = ('<nav>x</nav><p>a &amp; b<br>c<p>d<b>e</b> f</p><div class="ad-box">buy</div><article><header><h1>T</h1>by me</header><p>x'
            '<span class="ad">no</span> y<section class="comments"><p>hi</p></section><p>z</article><footer>f</footer><!-- c --><script>"</p>"</script> tail')
    said = pagediff.lines(page)
    assert [t for t, m in said if m == pagediff.ARTICLE] == ["T", "x", "y", "z"]
    assert [t for t, m in said if m == pagediff.PLAIN] == ["a & b c", "de f", "tail"]


def test_query(spark):
    from glasswatch.llm.registry import QUERIES
    pages = {x["page_id"]: x["html"] or "" for x in rows("pages")}
    got = QUERIES["op3_page_diff"](spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        blocks = re.split(r"</?(?:p|h1)>", pages[r.page_id].split("<article>", 1)[1].split("</article>")[0])
        texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b.replace("<b>", ""))).split()) for b in blocks)
        assert r.text == "\n\n".join(t for t in texts if t) and r.n_chars == len(r.text)


def test_differencing_where_markup_is_silent(spark):
    page = "<div>menu here</div><p>text {}</p><div>bottom</div>"
    given = [(1, "http://h.com/a/1", page.format("one"), 0), (2, "http://h.com/a/2", page.format("two"), 0), (None, "http://h.com/a/2", page.format("two"), 0),
             (3, "http://g.com/", "<div>menu here</div><p>only</p>", 0), (4, None, None, 0), (5, "", "<p>q", 0), (6, "http://[bad", "x", 0), (6, "http://[bad", "x", 0)]
    got = sorted((str(r.page_id), r.text) for r in pagediff.extract(spark.createDataFrame(given, "page_id int, url string, html string, key int")).collect())
    assert got == sorted([("1", "text one"), ("2", "text two"), ("None", "text two"), ("3", "menu here\n\nonly"), ("4", ""), ("5", "q"), ("6", "x"), ("6", "x")])
    assert pagediff.extract(spark.createDataFrame([], "page_id int, url string, html string")).collect() == []


def test_nearest_neighbour_is_the_partner(spark):
    page = "<div>{}</div><p>own {}</p>"
    given = [(k, u, page.format(m, k)) for k, (u, m) in enumerate([
        ("http://h.com/a/1", "A menu"), ("http://h.com/a/2", "A menu"), ("http://h.com/b/1", "B menu"), ("http://h.com/b/2", "B menu")])]
    got = {r.page_id: r.text for r in pagediff.extract(spark.createDataFrame(given, "page_id int, url string, html string")).collect()}
    assert got == {k: f"own {k}" for k in range(4)}
