import html as entities
import re

import pytest

from paperproof.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><article>no</article>";</script></head>
<body class="has-sidebar"><header><h1>Site name</h1><nav><ul><li><a href="/">Home</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies. <button>OK</button></div><div id='ad-top'>Buy   now</div><div class="wrap with-sidebar">
<article><header><h1>Real  title</h1></header><p>First&nbsp;para &lt;b&gt; with <b>bold</b>tail &amp more &#233;&#x1F600;.</p><aside>Aside words here</aside>
<p>Second<br>para <a href="x?a>b">link</a><!-- hidden > comment --><p>Third one
 goes on</p><form><label>Mail</label><input name=q></form><ul><li>item one<li>item two</ul><table><tr><td>a</td><td>b</td></tr></table>
<div class="share social">Share this</div><div hidden>unseen</div><footer>By line</footer></article></div>
<section class="comments"><article>I disagree with all of it, really a lot of words go here.</article></section>
<div class="sidebar"><p>Side words side words</p></div><footer>&copy; 2020 &middot; foot</footer></body></html>"""


def test_what_belongs_to_a_page():
    want = "Real title\nFirst para <b> with boldtail & more é😀.\nSecond para link\nThird one goes on\nitem one\nitem two\na b\nShare this"
    assert H.main_text(PAGE, H.Weights()) == want
    assert H.main_text(PAGE, H.Weights(1.0, -1.0, {"p": -0.01, "li": -2.0, "b": -0.01})) == want


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<nav>only menu</nav>", "<html><head><title>x</title></head></html>"])
def test_pages_without_text(page):
    assert H.main_text(page, H.Weights()) in ("", "<", "<p")


def test_an_article_keeps_its_sections():
    body = "<h1>Title of it</h1>" + "".join(f"<{t} {a}>{' '.join(['word'] * 30)} {i}</{t}>" for i, (t, a) in enumerate([("section", "id='related-work'"), ("p", "class=notice"), ("div", 'class="search results"'), ("p", "title=it's class=cookie-recipe")]))
    want = "\n".join(["Title of it", *(" ".join(["word"] * 30) + f" {i}" for i in range(4))])
    assert H.main_text(f"<body><nav>menu</nav><article>{body}<div class='ad'>buy</div></article><div class=comments>{'no ' * 40}</div></body>", H.Weights()) == want


@pytest.mark.parametrize("piece", ["<a ", "<a x=\"", "<a x='<b y=\"", "</p>", "<div>", "<div></p>", "<!", "</ ", "<article></article><div class=menu>", "<", "<li>", "<a x=", "&#", "<script>"])
def test_malformed_pages_take_linear_time(piece):
    import time

    took = []
    for n in (100_000, 800_000):
        page = piece * (n // len(piece))
        began = time.process_time()
        H.main_text(page, H.Weights())
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.2


def test_classes_are_learnt(spark):
    pages = [(i, "u", f"<body><div class='zzpromo wide'>buy it now {i}</div><article><p class=wide>{'some text here ' * 20}</p></article></body>") for i in range(40)]
    w = H.learn(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert set(w.outside) == {"zzpromo"} and w.outside["zzpromo"] <= -1
    assert "buy" not in H.main_text("<body><article><p>a b c d e f g</p><div class=zzpromo>buy it</div><p>more of it here</p></article></body>", w)


def test_best_run_is_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(200):
        pieces = [(rng.choice(["word", "word", "p", "/p", "li", "article"]), "a b " * rng.randint(1, 3), rng.choice([1.0, 1.0, 1.0, 0.0, -1.0]), False) for _ in range(rng.randint(0, 25))]
        w = H.Weights(1.0, -1.5, {"p": -2.5})
        score = lambda x: x[2] * w.word * len(x[1].split()) if x[0] == "word" else -H.EDGE if x[0] == "article" else w.tag.get(x[0].strip("/"), w.other)
        best = max([sum(map(score, pieces[i:j])) for i in range(len(pieces)) for j in range(i + 1, len(pieces) + 1)], default=0)
        p, q = H.region(pieces, w)
        assert sum(map(score, pieces[p:q])) == pytest.approx(max(0, best))


LINKS = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(30))
BARE = "<body><ul>%s</ul>%s<ul>%s</ul></body>"


def unscanned(page, w):
    """All of a page's text that scores above zero, without the scan."""
    return "\n".join(H.blocks(list(H.tokens(page, w.outside))))


@pytest.mark.parametrize("tag", ["div", "section", "article"])
def test_the_scan_decides_where_no_name_does(monkeypatch, tag):
    monkeypatch.setattr(H, "ADVERTS", frozenset())
    monkeypatch.setattr(H, "AROUND", frozenset())
    said = "\n".join(" ".join(["word"] * 40) + f" {i}" for i in range(3))
    page = BARE % (LINKS, f"<{tag}>" + "".join(f"<p>{x}</p>" for x in said.split("\n")) + f"</{tag}>", LINKS)
    w = H.Weights(1.0, -2.0, {"p": -0.5, "div": -0.5})
    assert H.main_text(page, w) == said != unscanned(page, w)


@pytest.mark.parametrize("name", ["share", "reply", "respond", "side-effects", "related-work", "search-algorithms", "notice-board", "login-flow", "recommended", "with-sidebar"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_that_say_little_keep_their_text(name, tag):
    said = [" ".join(["word"] * 30) + f" {i}" for i in range(3)]
    page = f"<body><nav>menu</nav><{tag}><p>{said[0]}</p><div class={name}>{said[1]}</div><p>{said[2]}</p></{tag}></body>"
    assert H.main_text(page, H.Weights()) == "\n".join(said)


@pytest.mark.parametrize("name", ["sidebar", "cookies", "comments", "ad"])
def test_plain_names_score_below_zero(name):
    said = " ".join(["word"] * 30)
    page = f"<body><div class={name}>{'none of it ' * 90}</div><div><p>{said}</p></div><div class={name}>{'none of it ' * 90}</div></body>"
    assert H.main_text(page, H.Weights()) == said
    assert H.main_text(f"<body><div class={name}><article>{said}</article></div></body>", H.Weights()) == ("" if name in H.ADVERTS else said)


def test_whole_table_without_article_elements(spark, monkeypatch):
    """Weights learnt from the labelled pages find the text of all pages as well where a div holds it, without any list of names."""
    monkeypatch.setattr(H, "ADVERTS", frozenset())
    monkeypatch.setattr(H, "AROUND", frozenset())
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    w = H.learn(pages)
    assert "ad" in w.outside
    for r in pages.collect():
        assert H.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>"), w) == article(r.html)


def article(page):
    a = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    parts = (" ".join(entities.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", a))
    return "\n".join(x for x in parts if x)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_odd_pages(spark):
    rows = [(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x y</p>", "t"), (3, "u", "<p>" + "long " * 50_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract(pages).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "x y", 3), (3, "u", ("long " * 50_000).strip(), 249_999)], key=str)
    assert H.extract(pages.limit(0)).count() == 0
