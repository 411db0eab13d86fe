"""Reading of pages, tree matching against all alignments, and what is content with and without marks."""

import itertools
import random

from quire.llm import wrappers

SCHEMA = "page_id long, url string, html string, host string, text string, nodes string"


def extract(spark, pages, **options):
    df = spark.createDataFrame([(*p, "h", "t", "n") for p in pages], SCHEMA).repartition(3)
    got = wrappers.main_text(df, carry=["host", "text", "nodes"], **options).collect()
    assert all((r.in_host, r.in_text, r.in_nodes) == ("h", "t", "n") and r.n_chars == len(r.text) for r in got)
    return sorted(((r.page_id, r.url, r.text) for r in got), key=repr)


def texts(html):
    return [t for _, t, _ in wrappers.read(html)[1]]


# -- reading ------------------------------------------------------------------------------------------------------------------


def test_blocks_blanks_references_and_raw_content():
    assert texts("<p>a <b>b</b>\n\t c&nbsp;d&amp;e &lt;f&gt;<p>g<br>h<!-- x -->i") == ["a b c d&e <f>", "g hi"]
    assert texts("<title>no</title><script>var x='<p>no</p>'</script><style>p{}</style>yes<script>no") == ["yes"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e<table><tr><td>f<td>g<tr><th>h</table>") == ["a", "b", "c", "d", "e", "f", "g", "h"]
    assert texts("a<p>b<div>c</div>d</p>e") == ["a", "b", "c", "d", "e"]
    assert texts('1 < 2 <a href="x>y">in</a> <p title=\'>\'>z') == ["1 < 2 in", "z"]
    assert texts("<p>a<span class='ad'>no <i>no</i></span>b</p>") == ["ab"]
    assert texts('x<p class="never closed>y<p>z') == ["x", "y", "z"]
    assert texts("<!doctype html><?php no ?></3 no>a<!-->b<!-- no") == ["ab"]
    assert texts("") == [] and texts(None) == [] and texts("<a href='cut of") == []


def test_long_and_deep_pages_are_read_whole():
    assert texts("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after") == ["deep", "after"]
    assert texts("<div>" * 500 + "<nav>no<div>no</div></nav>yes") == ["yes"]
    assert texts("<p>x" * 30_000) == ["x"] * 30_000
    assert len(texts("<p>" + "word " * 400_000)[0]) == 5 * 400_000 - 1
    assert len(texts("<i a='" * 20_000 + ">x")) <= 1


# -- alignment ------------------------------------------------------------------------------------------------------------------


def most_pairs(a, b):
    """The most nodes that any alignment keeping order and parents can pair, by trying all."""
    if a[0] != b[0]:
        return 0
    best = 0
    for n in range(1, min(len(a[2]), len(b[2])) + 1):
        for x in itertools.combinations(a[2], n):
            for y in itertools.combinations(b[2], n):
                got = [most_pairs(s, t) for s, t in zip(x, y)]
                best = max(best, sum(got) if all(got) else 0)
    return best + 1


def random_tree(rng, depth=0):
    return [rng.choice("ab") if depth else "r", None, [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3) if depth < 3 else 0)]]


def size(tree):
    return 1 + sum(map(size, tree[2]))


def test_matching_pairs_the_most_nodes_and_merging_loses_none():
    rng = random.Random(4)
    for _ in range(150):
        a, b = random_tree(rng), random_tree(rng)
        score, pairs = wrappers.match(a, b)
        assert score == most_pairs(a, b)
        whole = wrappers.merge(a, b, pairs)
        assert size(whole) == size(a) + size(b) - score
        assert wrappers.match(whole, a)[0] == size(a) and wrappers.match(whole, b)[0] == size(b)


# -- content ----------------------------------------------------------------------------------------------------------------------


FULL = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<nav><ul><li><a href=/>Home</a></ul></nav><form action=/s><label>Find</label><input><button>Go</button></form>
<div class="layout with-sidebar"><main><div class="breadcrumbs">Home &gt; Here</div><article class="post-12 entry"><header class="entry-header"><h2>Title {0}</h2></header><p>First {0}</p><div class="advert-box">Buy</div><ul><li>one<li>two</ul><aside>More</aside>
<blockquote>Quote</blockquote><div class="share-links"><a>Share</a></div><footer>Tags</footer></article><section id="comments"><article><p>Nice post</p></article></section></main><div class="sidebar"><p>Side</p></div></div>
<footer>&copy; Site</footer><script>x()</script></body></html>"""
BODY = "Title {0}\nFirst {0}\none\ntwo\nQuote"


def test_marked_parts_go_and_the_article_stays(spark):
    pages = [(k, "http://a.example/x", FULL.format(k)) for k in range(4)] + [(9, "http://b.example/", FULL.format(9))]
    assert extract(spark, pages) == [(k, u, BODY.format(k)) for k, u, _ in pages]
    wrapped = [(1, "http://f.example/", f"<form>{FULL.format(5)}</form>"), (2, "http://g.example", "<div role=main><p>a</p><div class=nav>b</div></div>c"), (3, "http://g.example/2", "<div class=post><article class=comment>no</article><p>yes</p></div>")]
    assert [t for _, _, t in extract(spark, wrapped)] == [BODY.format(5), "a", "yes"]


def test_constant_nodes_are_template_where_nothing_is_marked(spark):
    page = "<body><div class=k1>The Daily Page</div><div class=k2><a href=/>{0} one</a> <a href=/>{0} two</a></div>{2}<div class=k3><h2>Head {0}</h2><p>Text {0}</p><p>More</p></div>{1}<div class=k4>All rights are ours</div></body>"
    extra = "<div class=k5>Call us</div>"
    made = [(k, "https://soup.example:80/p?q", page.format(k, extra if k % 2 else "", "" if k % 3 else "<table><tr><td>Weather</table>")) for k in range(12)]
    assert extract(spark, made, fan=2) == extract(spark, made) == sorted([(k, u, f"Head {k}\nText {k}\nMore") for k, u, _ in made], key=repr)
    alone = [(1, "https://one.example/", page.format(1, "", ""))]
    assert extract(spark, alone)[0][2] == "The Daily Page\nHead 1\nText 1\nMore\nAll rights are ours", "one page tells nothing of the template"
    copies = [(k, "https://copies.example/", page.format(1, "", "")) for k in range(5)]
    assert {t for _, _, t in extract(spark, copies)} == {"The Daily Page\nHead 1\nText 1\nMore\nAll rights are ours"}, "nor do copies of one page"


def test_articles_that_are_template_go_if_another_one_varies(spark):
    pages = [(k, "http://t.example/", f"<article class=x>Join us</article><article class=y><p>News {k}</p></article>") for k in range(3)]
    assert [t for _, _, t in extract(spark, pages)] == ["News 0", "News 1", "News 2"]
    same = [(k, "http://u.example/", f"<div>{k}</div><article><h1>Same</h1><p>text</p></article>") for k in range(3)]
    assert {t for _, _, t in extract(spark, same)} == {"Same\ntext"}


def test_nulls_ties_repeated_rows_and_no_pages(spark):
    odd = [(1, None, "<article>a</article>"), (None, "http://a.example", None), (2, "http://a.example", ""), (1, None, "<article>a</article>"), (1, None, "<article>b</article>"), (3, "no url", "plain & simple"), (None, None, None)]
    want = [(1, None, "a"), (None, "http://a.example", ""), (2, "http://a.example", ""), (1, None, "a"), (1, None, "b"), (3, "no url", "plain & simple"), (None, None, "")]
    assert extract(spark, odd) == sorted(want, key=repr)
    assert extract(spark, []) == []


def test_roles_beyond_the_broadcast_size_are_joined(spark, monkeypatch):
    pages = [(k, f"http://h{k % 3}.example/", FULL.format(k)) for k in range(6)]
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    assert extract(spark, pages) == [(k, u, BODY.format(k)) for k, u, _ in pages]
