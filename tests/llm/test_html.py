import random
import time

from ferrule.llm import html


def text(source):
    return "\n".join(html.Page(source).main())


def test_parts_that_say_what_they_are():
    source = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="<p>no</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="cookie-notice">no</div>
    <div id="leftSidebar">no</div><article class="post"><header class="article-header"><h1>A &amp; B</h1></header><p>One<br>two <b>th</b>ree&nbsp; four
    <p>Five <!-- no <p> --> six<ul><li>a<li>b</ul><form><input><p>no</p></form><div class="ad">no</div><aside>no</aside>
    <blockquote>q</blockquote>tail<section class="comments"><article><p>no</p></article></section></article><footer>&copy; no</footer></body>"""
    assert text(source) == "A & B\nOne two three four\nFive six\na\nb\nq\ntail"


def test_no_article():
    assert text("<main><h1>T</h1><p>x</p></main><p>outside</p>") == "T\nx"
    assert text("<ul><li><a href=a>menu</a></li></ul><p>x &lt;y&gt;</p><div hidden>no</div><div style='display: none'>no</div>") == "x <y>"
    assert text("<main><h1>T</h1><article><p>x</p></article></main>") == "T\nx"
    assert text("just text") == "just text"


def test_broken_markup():
    assert text("<p>a<p>b</div><b>c<i>d</b>e") == "a\nbcde"
    assert text("<p>x &amp y &#233; < 5 <3</p><script>never closed <p>no") == "x & y é < 5 <3"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    for source in ["<", "<p", "</", "<!--", "<a href='", "<p>" * 3000 + "x", "<div>" * 3000 + "x", "&" * 50_000, "<" * 20_000]:
        html.Page(source).main()


def test_deep_markup_takes_linear_time():
    for source in ("<div>x" * 100_000, "<div>" * 100_000 + "x", "<li><ul>" * 50_000, "<p><b>x" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<td><p>" + "<div>" * 50_000 + "</p>" * 50_000):
        began = time.process_time()
        html.Page(source).main()
        assert time.process_time() - began < 4


def test_site_templates(spark, monkeypatch):
    menu = "<div><div>Menu of the site</div><p>Many words</p></div>"
    rows = [(i, f"https://A.example/{i}", f"{menu}<p>Page {i}</p><p>{'same' if i < 4 else i}</p><p>Bye</p>", 1) for i in range(12)]
    rows += [(100 + i, f"https://b.example/{i}", f"{menu}<p>Page {i}</p>", 1) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    want = {i: f"Page {i}\n{'same' if i < 4 else i}" for i in range(12)} | {100 + i: f"Menu of the site\nMany words\nPage {i}" for i in range(3)}
    for most in (html.BROADCAST, 0):
        monkeypatch.setattr(html, "BROADCAST", most)
        got = html.extract(pages).collect()
        assert {r.page_id: r.text for r in got} == want
        assert all(r.n_chars == len(r.text) for r in got)


def test_articles_keep_their_text(spark):
    """A page that stands on many rows, a sentence that many articles of a host have, and articles that are all the same."""
    rows = [(i, "https://a.example/x", "<article><h1>Title</h1><p>All of it</p></article>") for i in range(12)]
    rows += [(20 + i, f"https://b.example/{i}", f"<article><h1>T{i}</h1><p>He said nothing.</p><div class=box><p>Buy it</p><p>now</p></div><p>End {i}</p></article>") for i in range(12)]
    rows += [(40 + i, f"https://c.example/{i}", f"<p>{i}</p><article><div><h1>Same</h1><p>in all</p></div></article>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert all(got[i] == "Title\nAll of it" for i in range(12))
    assert all(got[20 + i] == f"T{i}\nHe said nothing.\nEnd {i}" for i in range(12))
    assert all(got[40 + i] == "Same\nin all" for i in range(12))


def test_counts_against_brute_force(spark):
    """Subtrees of random trees, counted per host over different pages, in plain Python."""
    rng = random.Random(3)
    stock = [f"<div><p>{rng.random()}</p><ul><li>a{i}<li>b{i}</ul></div>" for i in range(6)]
    rows = []
    for i in range(160):
        host = f"h{i % 4}.example"
        body = "".join(s for k, s in enumerate(stock) if rng.random() < (0.2, 0.45, 0.55, 0.8, 1.0, 0.05)[(k + i) % 4 if k < 4 else k]) + f"<section><p>own {i % 60}</p></section>"
        rows.append((i, f"http://{host}/{i}", body + "<nav><p>menu</p></nav>"))
    seen: dict = {}
    for _, url, source in rows:
        page = html.Page(source)
        of_host = seen.setdefault(html.host_of(url), {})
        for e in page.parted:
            of_host.setdefault(page.hashes[e], set()).add(source)
    pages_of = {h: len({s for _, u, s in rows if html.host_of(u) == h}) for h in seen}
    want = {(html._key(h, 0), html._key(h, k)) for h, keys in seen.items() for k, on in keys.items() if len(on) >= html.MANY and len(on) >= html.SHARE * pages_of[h]}
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {tuple(r) for r in html.templates(frame.union(frame)).collect()}
    assert got == want and len(want) > 8


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://x", "<p>a"), (3, "x", " <p> </p> "), (3, "http://[::1]:80/a", "<p>b"), (4, "HTTP://U@Ex.Org:8/", "<p>" + "w " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.url or "", r.text[:3], r.n_chars) for r in html.extract(pages).collect())
    assert got == [(0, "http://x", "a", 1), (1, "", "", 0), (2, "", "", 0), (3, "http://[::1]:80/a", "b", 1), (3, "x", "", 0), (4, "HTTP://U@Ex.Org:8/", "w w", 199_999)]
    assert html.extract(pages.limit(0)).count() == 0
    assert [html.host_of(r[1]) for r in rows] == ["", "", "x", "", "[::1]", "ex.org"]
