import pytest
from pyspark.sql import functions as F

from planmark.llm import style_tree as tree


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def texts(html):
    return [(t, w) for _, t, _, w in tree.blocks(html)]


@pytest.mark.parametrize("html, wanted", [
    ("", []), ("plain", [("plain", "other")]), ("<p>a<p>b", [("a", "other"), ("b", "other")]),
    ("<p>x &amp; y&nbsp;&lt;b&gt; &#233;</p>", [("x & y <b> é", "other")]),
    ("<p>a <b>b</b>\n\n c<br>d<i>e</i></p>", [("a b c de", "other")]),
    ("<div>one<p>two</p>three</div>", [("one", "other"), ("two", "other"), ("three", "other")]),
    ("<article><h1>H</h1><nav>n</nav><header><h2>K</h2></header><footer>f</footer></article>",
     [("H", "main"), ("n", "noise"), ("K", "main"), ("f", "noise")]),
    ("<header>h</header><div class='side-bar cookieNotice'>c</div><div id=comments><p>r</p></div>",
     [("h", "noise"), ("c", "noise"), ("r", "noise")]),
    ("<script>var t='</p>';</script>a<!-- no --><style>x</style>b", [("ab", "other")]),
    ("<script>open", []), ("<!-- open", []), ("a < b and <3 c", [("a < b and <3 c", "other")]), ("x <a href='", [("x", "other")]),
    ("</p></div>z</article>", [("z", "other")]),
    ("<ul><li>a<li>b</ul>c", [("a", "other"), ("b", "other"), ("c", "other")]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", [("1", "other"), ("2", "other"), ("3", "other")]),
    ("<p>a <span class=ad>buy</span> b</p>", [("buy", "noise"), ("a b", "other")]),
    ("<p><span class='share'>x<span>y</span> LEAK</span>kept</p>", [("x y LEAK", "noise"), ("kept", "other")]),
    ("<p><span class=ad>never closed</p>", [("never closed", "other")]),
    ("<div class='social-science'><p>s</p></div><p class=ad-hoc>t</p>", [("s", "doubt"), ("t", "doubt")]),
    ("<div class='share-buttons'>s</div><div id=site-footer-2>t</div>", [("s", "noise"), ("t", "noise")]),
    ("<form><main><p>in</p></main>out</form>", [("in", "main"), ("out", "noise")]),
    ("<form class=newsletter><main><p>in</p></main></form>", [("in", "noise")]),
    (f"<p data-x='{'<b>x</b>' * 3000}'>q</p>", [("q", "other")]),
    ("<div hidden>h</div><div style='display: none'>i</div>", [("h", "noise"), ("i", "noise")]),
    ("<form>f<input value=v></form><select><option>o</select>", [("f", "noise")]),
    ("<article class=comment>bad</article>", [("bad", "noise")]),
    ('<p title="a > b">q</p>', [("q", "other")]), ("<P CLASS='Lead'>Q</P>", [("Q", "other")]),
])
def test_blocks(html, wanted):
    assert texts(html) == wanted


def test_long_and_broken_pages_end_soon():
    for html in ("<" * 50_000, '<a "' * 20_000, "<p>" * 50_000, "<div>" * 3000 + "x", "&amp;" * 50_000, "<!--" * 20_000, "<span class=ad>" * 20_000):
        tree.blocks(html)


@pytest.fixture(scope="module")
def site(spark):
    rows = []
    for i in range(30):
        shared = f"<div class=top>Home News {i % 3}</div><div class=line>All rights kept</div>"
        own = "".join(f"<p>own text {i} {j} with words</p>" for j in range(4))
        rows.append((i, "http://A.example/x" if i % 2 else "https://u@a.EXAMPLE:80/y", page(f"{shared}<div class=story>{own}</div>")))
    rows += [(100, "http://b.example", page("<div class=top>Home News 1</div><p>alone</p>")), (101, None, None), (102, "x", "")]
    rows += [(200 + i, "http://a.example/copy", page("<div class=top>Home News 0</div><div class=story><p>the same page</p></div>")) for i in range(40)]
    rows += [(300, "http://a.example", page("<nav>n</nav><article><h1>Title</h1><p>All rights kept</p></article><div class=line>All rights kept</div>"))]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def test_repeated_branches_go(site):
    df = site.withColumn("n_chars", F.lit("clash")).withColumn("x_host", F.lit(1)).withColumn("extra", F.lit(2))
    got = {r["page_id"]: r for r in tree.extract(df).collect()}
    assert len(got) == 74 and got[0]["extra"] == 2
    for i in range(30):
        assert got[i]["text"] == "\n".join(f"own text {i} {j} with words" for j in range(4))
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert got[100]["text"] == "alone"  # judged by all hosts
    assert got[101]["text"] == got[102]["text"] == "" and got[101]["n_chars"] == 0
    assert got[300]["text"] == "Title\nAll rights kept"
    assert {got[200 + i]["text"] for i in range(40)} == {"the same page"}


def test_tree_decides_inside_articles(spark):
    """Lines that every page of a host repeats under names that say nothing, and names in doubt."""
    rows = []
    for i in range(20):
        own = "".join(f"<p>own text {i} {j}</p>" for j in range(3)) + f"<p class=ad-hoc>committee {i}</p><p class=ad-hok>k</p>"
        share = "<div class=x1>Share this page</div><div class=menu-q>Top of the site</div>"
        rows.append((i, "http://a.example", page(f"<main><h1>Title {i}</h1>{own}{share}</main>")))
    copied = "<article><p>copied</p><p>twice</p></article>"
    rows += [(100 + i, "http://c.example", page(f"<div class=ad>advert {i}</div>{copied}")) for i in range(30)]
    rows += [(200 + i, "http://c.example", page(f"<article><p>other {i}</p></article>")) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in tree.extract(df).collect()}
    for i in range(20):
        assert got[i].split("\n") == [f"Title {i}", *[f"own text {i} {j}" for j in range(3)], f"committee {i}"]
    assert {got[100 + i] for i in range(30)} == {"copied\ntwice"}
    assert got[200] == "other 0"


def test_importance_by_hand(site):
    rows = [("h", k, [(7, f"t{c}", 1, "other", True, True)]) for k, c in enumerate([1, 1, 1, 1, 2, 3, 4, 5])]
    spark = site.sparkSession
    df = spark.createDataFrame(rows, "host string, page long, blocks array<struct<node:long,text:string,style:long,where:string,new_text:boolean,new_style:boolean>>")
    weight = tree.importance(df).filter("host = 'h'").first()["weight"]
    import math

    assert abs(weight - 0.9 * ((1 - math.log(4) / math.log(8)) + 4) / 5) < 1e-9


def test_empty_table(site):
    assert tree.extract(site.filter("page_id < 0")).count() == 0
