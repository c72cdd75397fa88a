from inkspect.llm import maintext
from inkspect.llm.html import blocks

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><header>Site</header>
<article><header><h1>Title &amp; more</h1></header><p><b>One  two<br>three<p>Four&nbsp;five &copy; <form>Mail</form><ul><li>a<li>b</ul>
<table><tr><td>x<td>y</table><section id="comments"><p>Reader says</p></section></article>
<aside>Side</aside><div class="cookieNotice">Cookies</div><footer>&copy; me</footer>"""


def test_article_text():
    assert maintext.main_text(PAGE, set()).split("\n\n") == ["Title & more", "One two three", "Four five ©", "a", "b", "x", "y"]


def test_names_that_only_hold_a_noise_word_declare_nothing():
    page = '<article><p>Before</p><div class="{}"><p>Inside</p></div><p>After</p></article>'
    for name in ("social-policy", "share-price", "ad-hoc", "related-work", "notice-of-meeting", "replyTheory", "story", ""):
        assert maintext.main_text(page.format(name), set()) == "Before\n\nInside\n\nAfter", name
    for name in ("ad", "ad-slot", "box cookieNotice", "comments__item", "share-buttons", "related-articles", "newsletter-signup", "adTop2"):
        assert maintext.main_text(page.format(name), set()) == "Before\n\nAfter", name
    assert maintext.main_text('<article><p id="share-price">Up</p><p id="cookie-bar">x</p></article>', set()) == "Up"


def test_odd_pages():
    assert maintext.main_text(None, set()) == maintext.main_text("", set()) == ""
    assert maintext.main_text("plain &lt;text&gt;", set()) == "plain <text>"
    assert maintext.main_text("<p>cut of &am", set()) == "cut of &am"
    assert maintext.main_text("<![weird[ <p>kept</p>", set()).endswith("kept")
    deep = "<div>" * 3000 + "x"
    assert blocks(deep)[0][1] == "x"


def test_constant_branches_of_a_host_are_removed(spark):
    page = '<div class="top">Same words on every page</div><div class="text"><p>{}</p></div>'
    rows = [(i, f"http://h.example/{i}", page.format(f"Own text number {i} of this page"), "s") for i in range(40)]
    rows += [(100 + i, f"http://h.example/{i}", rows[0][2], "s") for i in range(200)]  # copies count once
    rows += [(500, "http://small.example/", page.format("alone"), "s"), (501, None, page.format("none"), "s"), (None, "x", None, "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, site string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in maintext.extract(df).collect()}
    assert len(got) == len(rows)
    assert got[3] == ("Own text number 3 of this page", 30) and got[150][0] == "Own text number 0 of this page"
    assert got[500][0] == "Same words on every page\n\nalone"  # one page is no evidence
    assert got[501][0] == "Same words on every page\n\nnone" and got[None] == ("", 0)


def test_undeclared_noise_of_small_hosts_is_removed(spark):
    page = '<div class="strip">All rights kept by us</div><div class="text"><p>{}</p></div><div class="story">{}</div>'
    rows = [(10 * n + i, f"http://h{n}.example/{i}", page.format(f"Own {n} {i}", f"Part {n} {i}")) for n in (1, 2, 3, 7) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in maintext.extract(df).collect()}
    for n in (1, 2, 3, 7):
        for i in range(n):
            own = f"Own {n} {i}\n\nPart {n} {i}"
            assert got[10 * n + i] == (own if n >= 3 else f"All rights kept by us\n\n{own}")


def test_articles_stay(spark):
    page = "<article><h1>Same title</h1><p>{}</p></article>"
    rows = [(i, "http://h.example/", page.format(f"para {i % 30} words")) for i in range(60)]
    got = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"].endswith(f"para {r['page_id'] % 30} words") for r in got)
    assert maintext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
