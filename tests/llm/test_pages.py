import html
import random
import re

import pytest
from pyspark.sql import functions as F

from fathom.llm import pages

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head><body>"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("just  text &amp; more", "just text & more"),
        (HEAD + "<nav><a>menu</a></nav><article><h1>A</h1><p>one <b>tw</b>o<br>three<p>f&eacute;ur&nbsp;x</article><footer>f</footer>", "A one two three féur x"),
        (HEAD + '<div class="ad">buy</div><main><p>body</p><form><input>say</form><aside>side</aside><section id="comments"><p>hi</p></section></main>', "body"),
        (HEAD + "<header>site</header><article><header><h1>Title</h1></header><p>x</p></article>", "Title x"),
        (HEAD + "<p>no article here<div id='cookie-notice'>ok?</div><ul><li>a<li>b</ul>", "no article here a b"),
        ("<article><p>cut off here<sp", "cut off here"),
        ("<article>a<!-- no --->b<!-- never closed", "ab"),
        ("<article><p title='a>b'>q</p><p>1 < 2 & 3</p></article>", "q 1 < 2 & 3"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
        ("<article><p>x</article></article></p><p>outside</p>", "x"),
        ("<script>never ends", ""),
        ("<article><p>Area is <math><mi>x</mi></math> here</p></article>", "Area is x here"),
        ('<article><h2 id="login-flow">Login flow</h2><p>Body</p></article>', "Login flow Body"),
        ('<article><section id="search-menu-tree"><h2>Trees</h2></section><section id="comments">hi</section></article>', "Trees"),
        ("<p title=don't>Text isn't here</p><p>more</p>", "Text isn't here more"),
        ("<article><p data-class=ad id=x>a<x-card>b</x-card>c<br/>d</p><svg><text>e</text></svg></article>", "abc d e"),
        ("<p title='never closed>a</p><p>b</p>", "a b"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + " end</article>", "deep end"),
        ("<article><p>" + "word " * 200_000 + "</p></article>", ("word " * 200_000).strip()),
    ],
)
def test_parse(source, text):
    assert pages.main_text(pages.parse(source)) == text


def site(host, n, body):
    return [(i, f"http://{host}/{i}", body(i)) for i in range(n)]


def test_repeated_branches_go(spark):
    body = lambda i: HEAD + f"<div class='wrap'><div class='box'>Welcome to our shop, dear reader</div><div class='story'><p>Story {i} tells of {i * 7}.</p><p>It ends {i}.</p></div></div>"
    rows = site("a.example", 12, body) + [(100, "http://b.example/", body(3)), (101, None, None), (102, None, ""), (103, "http://[bad", "<p>x")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, host string, low_nodes string, main_text string")
    out, name = pages.extract(df)
    assert out.columns == [*df.columns, name] and name != "main_text"
    got = {r.page_id: r[name] for r in out.collect()}
    for i in range(12):
        assert got[i] == f"Story {i} tells of {i * 7}. It ends {i}."
    assert got[100].startswith("Welcome") and got[101] == "" and got[102] == "" and got[103] == "x"


def test_copies_keep_their_article(spark):
    body = HEAD + "<article><p>the same on every page</p></article>"
    out, name = pages.extract(spark.createDataFrame(site("c.example", 9, lambda i: body), "page_id long, url string, html string"))
    assert {r[name] for r in out.collect()} == {"the same on every page"}


def test_repeated_headings_stay_in_an_article(spark):
    body = lambda i: HEAD + f"<article><h2>Ingredients</h2><p>egg {i}</p><h2>Summary</h2></article>"
    rows = site("d.example", 9, body)
    out, name = pages.extract(spark.createDataFrame(rows + rows[:2], "page_id long, url string, html string"))
    assert sorted(r[name] for r in out.collect()) == sorted(f"Ingredients egg {r[0]} Summary" for r in rows + rows[:2])


def mixed_site(rng):
    """Pages of two hosts without article or names, with menus that repeat, stories that differ and a note that some share."""
    out = []
    for i in range(24):
        menu = "<div class=x1><ul><li>Home<li>News<li>About us</ul></div>"
        story = "".join(f"<p>Story {i} part {j} {rng.random()}</p>" for j in range(rng.randint(1, 5)))
        note = f"<div class=x2><div class=x3>Note {i % 3}</div></div>" if i % 4 else ""
        out.append((i, f"http://{'ab'[i % 2]}.example/{i}", HEAD + f"<div class=w>{menu}<div class=y>{story}</div>{note}</div><div>All rights reserved</div>"))
    return out


def test_tree_against_plain(spark):
    from llm_brute import tree

    from fathom.plans.staging import Workspace

    rows = mixed_site(random.Random(3))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("h", pages.host_of(F.col("url"))).repartition(5)
    scores = pages.importance(pages.node_counts(df, "h", "html"), Workspace(spark))
    for threshold in (0.1, 0.3, 0.6, 0.9):
        got = {}
        for r in pages.unimportant(scores, threshold).collect():
            got.setdefault(r.host, set()).add(r.node)
        parsed = [(u.split("/")[2], pages.parse(h)) for _, u, h in rows]
        want = tree([(h, [(n, k) for n, _, k in p.shapes], [(b[0], b[-1]) for b in p.blocks]) for h, p in parsed], pages.GAMMA, pages.MIN_PAGES, threshold)
        assert got == {h: n for h, n in want.items() if n}, threshold


def test_without_article_and_names_the_tree_decides(spark):
    rows = mixed_site(random.Random(4))
    out, name = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for r in out.collect():
        assert "Home" not in r[name] and "rights" not in r[name] and r[name].startswith(f"Story {r.page_id} part 0")


def test_empty_table(spark):
    out, name = pages.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert out.count() == 0


def test_real_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out, name = pages.extract(df)
    for r in out.collect():
        a = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        a = re.sub(r"</?b>", "", re.sub(r"<(?:/?(?:p|h1|br)[^>]*)>", " ", a))
        assert r[name] == " ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*$", "", a)).split())


def test_tree_tells_articles_apart(spark):
    """An article that each page of a host repeats went into the main text, as the tree had no say on articles."""
    note = "<article class=box><h2>House rules</h2><p>Be kind to each other</p></article>"
    story = lambda i: f"<article class=story><h2>Summary</h2><p>Story {i} of {i * 7}</p></article>"
    rows = site("e.example", 9, lambda i: HEAD + note + story(i))
    rows += [(100 + i, f"http://f.example/{i}", HEAD + f"<main><h1>Daily</h1>{story(i)}{note}</main><p>outside {i}</p>") for i in range(9)]
    rows += [(200 + i, f"http://g.example/{i}", HEAD + f"<p>outside {i}</p>" + note) for i in range(9)]
    out, name = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for r in out.collect():
        i = r.page_id % 100
        assert r[name] == [f"Summary Story {i} of {i * 7}", f"Daily Summary Story {i} of {i * 7}", "House rules Be kind to each other"][r.page_id // 100]
