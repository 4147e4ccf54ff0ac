"""Site template removal."""

import html as H
import re

from paneflow.llm import site_template
from paneflow.llm.site_template import Page


def article(page: str) -> str:
    """The article of the test pages, cut out by hand."""
    a = page.split("<article>")[1].split("</article>")[0].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
    return "\n\n".join(x for x in (" ".join(H.unescape(y).split()) for y in re.split(r"</?(?:p|h1)>", a)) if x)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in site_template.digest(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_template_goes_and_copies_stay(spark):
    box = "<div class='x7'><p>Join our club today</p><p>Call now</p></div>"
    page = "<html><body>{box}<div class=z><h2>Head {i}</h2><p>{t}</p><p>more of it, number {i}, at some length</p></div></body></html>"
    rows = [(i, f"https://h.example/{i}", page.format(box=box, i=i, t=f"paragraph {i} " * 9)) for i in range(8)]
    rows += [(100 + i, f"https://copy.example/{i}", page.format(box="", i=0, t="the same article " * 9)) for i in range(9)]
    rows += [(200, None, None), (201, "", ""), (202, "https://h.example/x", "<p>a" * 3000), (203, "x", "a < b & c &lt; d<!-- open"), (204, "u", "<script>only")]
    df = spark.createDataFrame([(*r, "e", "e") for r in rows], "page_id long, url string, html string, text string, host string")
    got = {r["page_id"]: r["text"] for r in site_template.digest(df).collect()}
    assert all("club" not in got[i] and f"number {i}" in got[i] and f"Head {i}" in got[i] for i in range(8))
    assert all("the same article" in got[100 + i] for i in range(9))
    assert got[200] == got[201] == got[204] == "" and got[203] == "a < b & c < d"
    assert got[202].count("a") == 3000
    assert site_template.extract(df).columns == ["page_id", "url", "host", "text"]
    assert site_template.digest(df.limit(0)).collect() == []


def test_markup():
    t = """<body><header><h1>Site</h1></header><aside>side</aside><div class="cookie-notice">cookies</div><main><article>
    <header><h1>Title &amp; more</h1></header><p>One <b>two</b><i> three</i><br/>four<p>Six&nbsp;&#8212; x<ul><li>a<li>b</ul>
    <div class="ad">buy</div><form><p>mail</p></form><script>var x="</article>";</script><section class="comments"><p>bad</p></section>
    </article></main><footer>f</footer>"""
    assert Page(t).text(set()) == "Title & more\n\nOne two three four\n\nSix — x\n\na\n\nb"


def test_wrappers_keep_the_article():
    body = "<h1>Title</h1><p>" + "one two three " * 20 + "</p><p>four five six</p>"
    want = "\n\n".join(["Title", ("one two three " * 20).strip(), "four five six"])
    side = "<div class='sidebar'><p>side text</p></div><form><p>mail us</p></form>"
    for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div class=post>{body}</div>", f"<div role=main>{body}</div>"):
        for wrap in ("<div class='content-sidebar-wrap'>{}</div>", "<div class='layout has-sidebar'>{}</div>", "<form id='aspnetForm'>{}</form>",
                     "<div role='search'>{}</div>", "<div class='page-header'><form class='has-comments'>{}</form></div>"):
            assert Page("<html><body>" + wrap.format(inner + side) + "</body></html>").text(set()) == want, (inner, wrap)
    # the largest article is the page's, teasers and reader comments are not, however long
    teasers = "<div class='related'><article><p>teaser one</p></article><article><p>teaser two</p></article></div>"
    comments = "<section class='comments'>" + "<p>I think so too.</p>" * 60 + "</section>"
    for inner in (f"<article>{body}</article>", f"<div class=post>{body}</div>"):
        assert Page(f"<body><div class='has-sidebar'>{inner}</div>{teasers}</body>").text(set()) == want
        assert Page(f"<body>{inner}{teasers}{comments}</body>").text(set()) == want


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in site_template.digest(df).collect()}


def test_copies_stay_whole(spark):
    part = [f"part {k} " * 6 for k in range(4)]
    plain = "<h2>Head</h2>" + "".join(f"<p>{t}</p>" for t in part)
    listed = f"<h2>Head</h2><ul><li>{part[0]}</li></ul><table><tr><td>{part[1]}</td></tr></table><div>{part[2]}</div><section>{part[3]}</section>"
    want = "\n\n".join(["Head", *(t.strip() for t in part)])
    box = "<div class='x7'><p>Join our club today and call us now or later</p><p>Call now</p></div>"
    link = "<div class='x8'><a href='/'>Home</a> of us</div>"
    rows = [(k, f"https://copy.example/{k}", f"<body><div class=z>{plain}</div></body>") for k in range(9)]
    rows += [(100 + k, f"https://copy2.example/{k}", f"<body>{link}<article>{listed}</article></body>") for k in range(9)]
    # copies among other pages with the same template
    page = "<body>" + link + box + "<div class=z>{}</div></body>"
    rows += [(200 + k, f"https://both.example/{k}", page.format(plain)) for k in range(9)]
    rows += [(300 + k, f"https://both.example/x{k}", page.format(f"<h2>Head {k}</h2><p>{f'own text {k} ' * 9}</p>")) for k in range(9)]
    got = texts(spark, rows)
    assert {got[i] for i, *_ in rows if i < 300} == {want}
    assert all(got[300 + k] == f"Head {k}\n\n" + (f"own text {k} " * 9).strip() for k in range(9))


def test_all_of_the_article_is_kept():
    a, b = "first half of it " * 12, "second half of it " * 8
    whole = f"Title\n\n{a.strip()}\n\n{b.strip()}"
    menu = "<div class=x1><ul><li><a href='/'>Home</a></li><li><a href='/b'>About</a></li></ul></div>"
    assert Page(f"<body>{menu}<div><h1>Title</h1><div><p>{a}</p></div><div><p>{b}</p></div></div></body>").text(set()) == whole
    assert Page(f"<body>{menu}<div><h1>Title</h1><div><p>{a}</p></div>{b}</div></body>").text(set()) == whole
    assert Page(f"<body>{menu}<div><h1>Title</h1><div><p>{a}</p></div><ul><li>{b}</li></ul></div></body>").text(set()) == whole
    parts = f"<article><h1>Title</h1><p>{a}</p></article><article class='reply'><p>no</p></article><div><article><p>{b}</p></article></div>"
    assert Page(f"<body>{menu}{parts}</body>").text(set()) == whole
    assert Page("<body><p>a <b>b</b></p></body>").text(set()) == "a b"
    # an article of comments alone is not the page's, one that is open to comments is
    assert Page(f"<body><div><h1>Title</h1><p>{a}</p><p>{b}</p></div><article id='comment-1'><p>no</p></article></body>").text(set()) == whole
    inner = f"<div class='has-sidebar'><div class=y><h1>Title</h1><p>{a}</p><p>{b}</p></div><div class='comments'><p>no</p></div></div>"
    assert Page(f"<body>{menu}<main>{inner}</main></body>").text(set()) == whole
    assert Page(f"<body>{menu}<main><div><article class='post comments-open'>{inner}</article></div></main></body>").text(set()) == whole
    assert Page(f"<body><article>{inner}<article class='comment'><p>{a * 9}</p></article></article></body>").text(set()) == whole
    assert Page(f"<body>{menu}<p>side</p><article class='post comments-open'><h1>Title</h1><p>{a}</p><p>{b}</p></article></body>").text(set()) == whole


def test_template_of_one_section_of_a_large_host(spark):
    box = "<div class='x7'><p>Join our club today</p></div>"
    rows = [(k, f"https://large.example/{k}", f"<body>{box if k < 55 else ''}<div class=z><p>{f'own text {k} ' * 9}</p></div></body>") for k in range(600)]
    got = texts(spark, rows)
    assert all(got[k] == (f"own text {k} " * 9).strip() for k in range(600))
