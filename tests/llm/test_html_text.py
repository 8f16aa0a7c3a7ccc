import re
import time
from html import unescape

from stratus.llm import html_text as H

ARTICLE = "<article><h1>Title &amp; more</h1><p>First   para\n with <a href='x'>a link</a>.</p><p>Second &eacute;&#8364;<br>line</p></article>"
BODY = ("<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav><header>Top</header><div class='ad'>Buy</div>"
        "<div id='cookie-notice'>We use cookies</div>{}<aside>Side</aside><form><p>Name</p></form>"
        "<div class='comments'><p>Nice post, dear author, I like it very much indeed.</p></div><!-- <p>hidden</p> -->"
        "<footer>&copy; all</footer></body></html>")
TEXT = "Title & more\n\nFirst para with a link.\n\nSecond é€ line"


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'z' AS text", "1 AS host", "1 AS paths")
    return {r.page_id: r for r in H.extract_pages(df).collect()}


def test_article_without_the_rest(spark):
    rows = [(i, f"http://h.org/{i}", BODY.format(ARTICLE)) for i in range(5)]
    rows += [(10, "http://h.org/x", None), (11, None, ""), (12, "odd url", "just text"), (13, "http://h.org/c", BODY.format("")),
             (14, "http://o.org/", "<p>open <b>bold<br><p>next &am <i>x"), (15, "http://o.org/2", "<div><p>" + "long " * 50_000 + "</p></div>"),
             (16, "http://o.org/3", "a < b & c > d <unclosed"), (17, "http://o.org/4", "<div>" * 3000 + "deep" + "</div>" * 3000),
             (18, "http://o.org/5", "<table><tr><td>1<td>2<tr><td>3</table>")]
    got = run(spark, rows)
    assert all(got[i].text == TEXT and got[i].n_chars == len(TEXT) for i in range(5))
    assert got[10].text == got[11].text == got[13].text == "" and got[10].n_chars == 0
    assert got[12].text == "just text" and got[14].text == "open bold\n\nnext &am x"
    assert got[15].n_chars == 249_999 and got[16].text.startswith("a < b & c > d") and got[17].text == "deep"
    assert got[18].text == "1\n\n2\n\n3"
    assert len(got) == len(rows)


def test_a_host_never_takes_main_text_from_a_page(spark):
    normal = BODY.format("<div class='post-12'><p>" + "Real text of the article. " * 10 + "</p></div>")
    more = ("Something else entirely. " * 30).strip()
    odd = BODY.format(f"<div class='post-7'><p>Short.</p></div><div class='box'><p>{more}</p></div>")
    rows = [(i, f"http://h.org/{i}", normal) for i in range(30)] + [(99, "http://h.org/odd", odd)]
    assert run(spark, rows)[99].text == f"Short.\n\n{more}"


def test_whole_article_beside_its_largest_part(spark):
    lead, rest = "The lead of the article. " * 8, "The content of the article. " * 32
    whole = f"<article><h1>Title</h1><div class='lead'>{lead}</div><div class='content'>{rest}</div></article>"
    plain = whole.replace("article>", "div>", 2)
    rows = [(i, f"http://a.org/{i}", BODY.format(whole)) for i in range(5)]
    rows += [(10 + i, f"http://b.org/{i}", BODY.format(plain)) for i in range(5)]
    got = run(spark, rows)
    assert {r.text for r in got.values()} == {f"Title\n\n{lead.strip()}\n\n{rest.strip()}"}


def test_a_winning_path_keeps_the_main_text_of_a_page(spark):
    post, long = "<div class='content'><p>Post.</p></div>", "Main text of another template. " * 30
    rows = [(i, f"http://h.org/{i}", BODY.format(f"<div class='page'>{post}</div>")) for i in range(30)]
    rows += [(50, "http://h.org/a", BODY.format(f"<div class='page'>{post}<div class='story'>{long}</div></div>")),
             (51, "http://h.org/b", BODY.format(f"<div class='page'>{post}</div><article>{long}</article>"))]
    got = run(spark, rows)
    assert got[0].text == "Post." and got[50].text == got[51].text == f"Post.\n\n{long.strip()}"


def test_layout_elements_around_the_article(spark):
    text = "<h1>Title</h1><p>" + "Text of the article. " * 20 + "</p>"
    want = "Title\n\n" + ("Text of the article. " * 20).strip()
    wraps = ["<div class='has-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>", "<div class='comments-open'>{}</div>",
             "<div class='with-ads'>{}</div>", "<div class='social-post'>{}</div>", "<form id='all'>{}</form>",
             "<div class='sidebar'>{}</div>", "<div hidden>{}</div>", "<main><form>{}</form></main>"]
    rows = [(10 * i + j, f"http://h{i}-{j}.org/", BODY.format(w.format(inner.format(text))))
            for i, w in enumerate(wraps) for j, inner in enumerate(["<article>{}</article>", "<div class='post'>{}</div>"])]
    ad = "<div class='ad-container'><p>Buy</p></div><div class='related-posts'><article>Teaser.</article></div>"
    rows += [(500, "http://r.org/", BODY.format(f"<article>{text}</article>{ad}")),
             (501, "http://s.org/", f"<form><nav>Home</nav><div class='post'>{text}</div><p class='ad-container'>Buy</p><div id='comments'>{'Nice. ' * 200}</div></form>")]
    got = run(spark, rows)
    assert {i: r.text for i, r in got.items() if r.text != want} == {}
    assert H.extract("<div><p>Text <span class='ad'>Buy</span>and more.</p></div>", []) == "Text and more."


def test_boilerplate_names():
    skipped = ["ad", "ads", "cookie-notice", "comments", "comments-area", "left-sidebar", "sidebar-wrapper", "ad-container", "share-buttons", "site-header"]
    kept = ["has-sidebar", "no-sidebar", "comments-open", "with-ads", "social-post", "menu-open", "post", "is-modal", "12"]
    assert [n for n in skipped if not H._is_boilerplate("div", {"class": n})] == []
    assert [n for n in kept if H._is_boilerplate("div", {"class": n})] == []


def test_unclosed_markup_is_read_in_linear_time():
    start = time.process_time()
    for bad in ("<a ", "<a '", "<p class=\"x", "<", "<!-- x ", "<a <"):
        H.extract("<p>Text</p>" + bad * (1_000_000 // len(bad)), [])
    assert time.process_time() - start < 20
    assert H.extract("<p>Text</p><!-- <p>hidden</p> ", []) == H.extract("<p>Text</p><!-- hidden", []) == "Text"


def test_empty_table_and_join_without_broadcast(spark):
    assert run(spark, []) == {}
    rows = [(i, f"http://h{i % 3}.org/{i}", BODY.format(ARTICLE)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert [r.text for r in H.extract_pages(df, max_broadcast_chars=0).collect()] == [TEXT] * 9


def test_whole_table_equals_a_plain_reading(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", body)
        texts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", p) if "<br" in p else re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert got[r.page_id] == "\n\n".join(t for t in texts if t)
