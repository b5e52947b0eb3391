import random
import re
import time
from html import unescape
from itertools import accumulate

from larkspur.llm import html
from larkspur.llm.common import read_table
from larkspur.llm.html_pages import PAGES

DATA = "/root/testdata/sf0.01"


def test_weights():
    w = html.weights()
    assert w["main"] > 0 and w["word"] > 0 and w["link"] < 0 and w["beside"] < w["word"]
    assert all(v < 0 for f, v in w.items() if f not in ("main", "word", "beside", "link"))


def test_labelled_pages():
    """The regions of the labelled pages themselves come out whole."""
    for page in PAGES:
        want = " ".join(re.sub(r"<[^>]*>", " ", re.sub(r"</?[bi]>", "", part)) for region, part in page if region).split()
        assert unescape(html.extract("".join(part for _, part in page))).split() == want


W = "<p>" + "word " * 30 + "</p>"
WORDS = " ".join(["word"] * 30)


def text_of(body):
    return html.extract(f"<html><body>{body}</body></html>")


def test_names_of_states_do_not_make_boilerplate():
    for body in ('<div class="content no-sidebar">%s</div>', '<div class="post has-comments">%s</div>', '<main class="with-sidebar">%s</main>', '<div class="post category-advertising">%s</div>', '<p title="a hidden gem, class=ad">%s</p>'):
        assert text_of(body % W) == WORDS, body


def test_headlines_of_articles_stay():
    for body in ("<article><header><h1>Head line</h1></header>%s</article>", '<article><div class="article-header"><h1>Head line</h1></div>%s</article>', '<div class="post"><div class="post-header"><h1>Head line</h1></div>%s</div>'):
        assert text_of(body % W) == "Head line\n\n" + WORDS, body


def test_boilerplate_goes_without_an_article_element():
    beside = ['<div class="page-header">site name</div>', '<div class="widget-area">some items in the widget</div>', '<header><h1>Site</h1><p>Motto of it</p></header>', '<div class="sd-sharing">Share this now</div>', '<div class="articleComments"><p>I think so too</p></div>', '<section id="comments"><article class="comment"><p>So do I</p></article></section>', '<form><label>Name</label><button>Go</button></form>', '<div role="complementary">x y z</div>', '<div aria-hidden="true">x y</div>', "<div hidden>x y</div>", '<div class="Cookie-Notice">we use them</div>']
    for b in beside:
        for body in (f"{b}<div>{W}</div>", f'<div class="entry-content">{W}</div>{b}', f"<div>{W}{b}{W}</div>"):
            assert text_of(body).replace("\n\n", " ").split() == ["word"] * body.count("word"), body


def test_the_scan_leaves_out_what_no_name_tells(monkeypatch):
    """Lists of links and lines of small print in plain elements; without the scan they stay."""
    links = "<div><a href=x>Home</a> <a href=y>News of today</a> <a href=z>More of it</a></div>"
    body = f"{links}<div>{W}<table><tr><td>cell one</td></tr></table>{W}</div><div><div><div>{links}</div></div></div>"
    want = f"{WORDS}\n\ncell one\n\n{WORDS}"
    assert text_of(body) == want
    before = sum(r for page in PAGES for r in [html.extract("".join(p for _, p in page)) != ""])
    monkeypatch.setattr(html, "best_run", lambda scores: (0, len(scores)))
    assert text_of(body) != want and "Home" in text_of(body) and before == len(PAGES)


def test_long_attributes_and_deep_nesting():
    for n in (19_990, 20_010, 3_000_000):
        assert text_of(f"<article><p title=\"{'LEAK>' * (n // 5)}\">hello</p>{W}</article>") == "hello\n\n" + WORDS
    for depth in (10, 511, 600, 5_000):
        assert text_of("<article>" + W + "<div>" * depth + "<nav>menu words here</nav>" + "</div>" * depth + W + "</article><div>after</div>") == f"{WORDS}\n\n{WORDS}"


def test_references_do_not_go_on_behind_a_tag():
    assert text_of(f"<article><p>x &am<b>p;</b> &lt<b>x</b></p>{W}</article>") == f"x &amp; <x\n\n{WORDS}"


def test_ties_take_the_first_run():
    assert html.best_run([1.0, -5.0, 1.0]) == (0, 1) and html.best_run([0.0, 2.0, 0.0]) in ((0, 2), (1, 2)) and html.best_run([-1.0]) == (0, 0)


def test_best_run_equals_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = html.best_run(s)
        sums = [0, *accumulate(s)]
        assert sum(s[a:b]) == max(sums[j] - sums[i] for i in range(len(sums)) for j in range(i, len(sums)))


def test_blocks_and_references():
    page = "<body><article><h1> A &amp; B</h1><p>One\n two&nbsp;three<br>four</p>tail <i>x</i>y<p>a &lt;b&gt; &#39;c&#x27; &copyx &am</article></body>"
    assert html.extract(page) == "A & B\n\nOne two three four\n\ntail xy\n\na <b> 'c' ©x &am"


def test_boilerplate_inside_an_article_goes():
    inner = '<aside>see also this</aside><div class="ad-slot">buy now</div><script>if (a < b) "</p>";</script><form><input><button>Send it</button></form><!-- <p>no</p> --><div id="comments"><p>first!</p></div>'
    page = f"<html><head><title>T</title></head><body><nav><a>Home</a></nav><article><h1>Title</h1><p>{'word ' * 30}</p>{inner}<p>The end is near</p></article><footer>(c)</footer></body>"
    assert html.extract(page) == "Title\n\n" + " ".join(["word"] * 30) + "\n\nThe end is near"


def test_broken_pages():
    assert html.extract("<article><p>one <b>two<p>three</i> four<a href='x") == "one two\n\nthree four"
    assert html.extract("<article><p>a < b and c <3 d</p><p title=\"x>y</p>") .startswith("a < b and c <3 d")
    assert html.extract("<script>var x = 1;") == "" and html.extract("") == "" and html.extract(None) == ""
    assert html.extract("plain text only") == "plain text only"
    for c in ("<", "<a ", "<a '", '<p "', "<p a='", '<p a="', "<!--", "</", "&", "<div>", "<script>", "<b><p>", "<p><div><b>", "<i><p></p>", "</x>", "<b></i>", "<li><ul><b>"):
        t = time.time()
        html.extract("<article><p>x</p>" + c * 20_000)
        assert time.time() - t < 5, c


def test_pages_of_the_table(spark):
    """On pages with one article element, extraction equals its blocks read by definition."""
    rows = html.extract_text(read_table(spark, DATA, "pages")).collect()
    assert len(rows) == 250
    for r in rows:
        body = r.html.partition("<article>")[2].partition("</article>")[0]
        body = re.sub(r"<[a-zA-Z/][^>]*$", "", re.sub(r"</?(?:b|i|em|a)>|<br>", " ", body))
        parts = [" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p), r.page_id
        assert r.n_chars == len(r.text)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t", 3), (None, "u", "", None, None), (2, "u", "<p>x y z</p>", "t", 1), (2, "u", "<p>x y z</p>", "t", 1), (3, "u", "<p>" + "word " * 300_000, "t", 1)], "page_id long, url string, html string, text string, n_chars int")
    assert [r.n_chars for r in html.extract_text(df).collect()] == [0, 0, 5, 5, 1_499_999]
    assert html.extract_text(df.limit(0)).count() == 0
