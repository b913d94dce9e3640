from boxloom.llm import pages


def text_of(page):
    has_main, blocks = pages.parse(page)
    return "\n".join(b[1] for b in blocks if not b[3] and (b[2] or not has_main))


def test_parse():
    page = (
        '<html><head><title>x</title><script>var a="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div>'
        "<header>Top</header><article><h1>Head &amp; line</h1><p><b>One  two<br>three<br><p>Four&nbsp;five<form><p>Mail</form><div class='comments'><p>Nice</div>"
        "<aside>side</aside><!-- <p>no</p> --><p>a < b &copy 5</p></article><footer>&copy; me</footer></body></html>"
    )
    assert text_of(page) == "Head & line\nOne two three\nFour five\na < b © 5"
    assert text_of("<article><p>cut &am</p><p>off <b>here</b") == "cut &am\noff here"
    assert text_of("") == "" and text_of("plain") == "plain"


def test_tree(spark):
    def page(i):
        return f"<body><div class='x'><p>Same words on all pages</p></div><div class='y'><p>Story {i} tells {i * 7} things</p><p>More {i}</p></div></body>"

    rows = [(i, f"http://a.example/{i}", page(i), 1) for i in range(12)]
    rows += [(50, "http://b.example/", page(50), 1), (51, None, None, 1), (52, "bad", "", 1), (53, "http://a.example/z", "<article><p>Same words on all pages</p></article>", 1)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in pages.main_text(docs).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i].text == f"Story {i} tells {i * 7} things\nMore {i}" and got[i].n_chars == len(got[i].text)
    assert got[50].text.startswith("Same words") and got[51].text == got[52].text == "" and got[53].text == "Same words on all pages"
    assert pages.main_text(docs.limit(0)).count() == 0


def test_tree_inside_main(spark):
    def page(i):
        return f"<body><article><div class='k3x'><p>Join our list today</p></div><div class='body'><p>Story {i} tells {i * 7} things</p></div></article></body>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)]
    copies = "<article><h1>One</h1><p>The same page</p></article>"  # copies of a page aren't what a site repeats
    rows += [(100 + i, f"http://b.example/{i}", copies) for i in range(12)]
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"Story {i} tells {i * 7} things" and got[i].n_removed == 1 for i in range(12))
    assert all(got[100 + i].text == "One\nThe same page" and got[100 + i].n_removed == 0 for i in range(12))


def test_names():
    for outer in ("layout has-sidebar", "content-with-sidebar", "search-results", "widget", "sidebar"):
        assert text_of(f"<body><div class='{outer}'><article><h1>Head</h1><p>Text</p></article></div></body>") == "Head\nText"
    page = (
        "<article><h2 id='related-work'>Related</h2><h2 id='related'>More</h2><section id='search'><p>Find</p></section><p class='notice'>Note</p>"
        "<div class='notice'>Take care</div><h3 id='social-impact'>Impact</h3><div class='share'>Share</div>"
        "<section class='comments'><article><p>Nice</p></article></section></article><div class='related'>Else</div>"
    )
    assert text_of(page) == "Related\nMore\nFind\nNote\nTake care\nImpact"
    assert text_of("<main><nav><article>no</article></nav><p>yes</p></main>") == "yes"


def test_parser_faults():
    assert text_of("<p>a<svg-icon>b</svg-icon>c</p><title-card>d</title-card><p>e") == "abc\nd\ne"
    assert text_of("<p>a<svg width='1'/>b<iframe src=x />c</p><p>d") == "abc\nd"
    assert text_of('<p><a title="a > b" href=x>link</a> end</p>') == "link end"
    assert text_of("<p>don't<b class=\"x>y\">bold</b> <i n='a\"b'>it's</i>") == "don'tbold it's"
    assert text_of("<p>x</p><script>var a = '<p>no</p>'") == "x" and text_of("<p>x<noscript>y") == "xy"
    for name in ("related-work", "naval-history", "comment-on-results", "widget-text"):
        assert text_of(f"<div class='{name}'><p>Text</p></div>") == "Text"


def test_branches_go_whole(spark):
    """A teaser list differs a little on every page; its branch goes as one, menu and all."""

    def page(i):
        links = "".join(f"<li>Section {k}</li>" for k in range(8)) + f"<li>Page {i}</li>"
        story = "".join(f"<p>Story {i} part {k} on {i * 31 + k}</p>" for k in range(5))
        return f"<body><div class='q7'><ul>{links}</ul></div><div class='z2'>{story}</div></body>"

    rows = [(i, "http://a.example/", page(i)) for i in range(9)] + [(20 + i, f"http://small{i % 5}.example/", page(i)) for i in range(10)]
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].n_removed == 9 and got[i].text.startswith(f"Story {i} part 0") for i in range(9))
    assert all(got[i].n_removed == 0 and got[i].text.startswith("Section 0") for i in range(20, 30))  # two pages tell nothing


def test_near_copies_keep_their_article(spark):
    body = "".join(f"<p>Paragraph {k} of the same story</p>" for k in range(20))
    rows = [(i, "http://a.example/", f"<article>{body}<p>Only {i}</p></article>") for i in range(4)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.count("\n") == 20 and r.n_removed == 0 for r in got)


def test_very_long_page(spark):
    rows = [(1, "http://a.example/", "<article>" + "<p>word " * 60_000 + "</article>" + "<title-x " * 20_000)]
    row = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert row.text.count("word") == 60_000
