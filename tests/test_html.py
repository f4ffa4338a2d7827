from pyspark.sql import functions as F

from foliospark.operators import html_nodes, noise, site_pages, threads
from foliospark.operators.page_metadata import page_metadata
from foliospark.operators.render import to_markdown
from foliospark.plans import shared

PAGE = """<html><head><title>Boats - Harbor Notes</title><meta property="og:site_name" content="Harbor Notes"><meta name="description" content="About boats">
<link rel="canonical" href="https://h.example/"><script type="application/ld+json">{"@graph":[{"headline":"Boats","author":{"name":"Ann"},"datePublished":"2024-01-02"}]}</script><script type="application/ld+json">{broken</script></head>
<body><nav><a href="/a">Home</a></nav><div style="display: none">secret</div><article class="post"><h1>Boats</h1>
<p>The first boat, the second boat, and a third one went <a href="/x">out</a>.<p>Another paragraph of words, with commas, and more words here.<ul><li>one<li>two</ul><img src="i.png" width="10" height="10"></article><footer>© all</footer><script>x()</script></body></html>"""


def nodes(spark, *pages):
    return html_nodes.parse_nodes(spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "id long, html string"), "id", "html")


def test_tree_closes_what_is_open(spark):
    rows = {r["pre"]: r for r in nodes(spark, "<ul><li>a<li>b<ol><li>c</ol></ul><p>x<p>y<div>z").collect()}
    tags = {k: (r["tag"], r["parent"], r["last"]) for k, r in rows.items()}
    assert tags == {0: ("ul", -1, 4), 1: ("li", 0, 1), 2: ("li", 0, 4), 3: ("ol", 2, 4), 4: ("li", 3, 4), 5: ("p", -1, 5), 6: ("p", -1, 6), 7: ("div", -1, 7)}
    assert rows[2]["text"] == "b c" and rows[0]["words"] == 3


def test_content_is_the_article_without_noise(spark):
    found = nodes(spark, PAGE, "", None)
    assert [r["tag"] for r in html_nodes.main_nodes(found).collect()] == ["article"]
    text = html_nodes.main_texts(found).collect()[0]["text"]
    assert text.startswith("Boats The first boat") and "secret" not in text and "Home" not in text and "x()" not in text
    assert html_nodes.small_images(found).count() == 1 and html_nodes.hidden_nodes(found).count() == 1


def test_metadata_precedence(spark):
    pages = spark.createDataFrame([(0, "https://h.example/boats"), (9, "https://h.example/none")], "page_id long, url string")
    found = {r["page_id"]: r for r in page_metadata(nodes(spark, PAGE), pages).collect()}
    one = found[0]
    assert (one["title"], one["author"], one["site"], one["published"], one["description"], one["canonical_url"]) == ("Boats", "Ann", "Harbor Notes", "2024-01-02", "About boats", None)
    assert found[9]["title"] is None and found[9]["canonical_url"] is None


def test_markdown():
    assert to_markdown("<h2>A <em>b</em></h2><p>x <a href='/u'>y</a><br>z<ul><li>1<ul><li>2</ul></ul><pre class='language-py'>q\n</pre><table><tr><th>a<th>b<tr><td>1<td>2|3</table>") == "## A *b*\n\nx [y](/u)\nz\n\n- 1\n  - 2\n\n```py\nq\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2\\|3 |"
    assert to_markdown(None) is None and to_markdown("") == "" and to_markdown("<blockquote><p>a<p>b</blockquote>") == "> a\n>\n> b"


def test_source_sets(spark):
    frame = spark.createDataFrame([("a.png 1x, b.png 2x",), ("a.png 100w, b.png 900w, c.png 900w",), ("a.png",)], "s string")
    assert [r["u"] for r in frame.select(html_nodes.best_source(F.col("s")).alias("u")).collect()] == ["b.png", "b.png", "a.png"]


def test_raw_pages(spark):
    frame = spark.createDataFrame([("<body><script>1</script><noscript><p>hi</p></noscript></body>",), ("a<wbr>b<template shadowrootmode='open'>c</template>",)], "h string")
    assert [r["h"] for r in frame.select(html_nodes.preprocess_html(F.col("h")).alias("h")).collect()] == ["<body><script>1</script><p>hi</p></body>", "abc"]


def test_pages_are_standardised():
    page = """<h1>Boats <a class="anchor" href="#b">#</a></h1><h1>More</h1><p>See <a href="/x">x</a> and <a href="java&#115;cript:alert(1)">bad</a><sup><a href="#fn1">1</a></sup>.</p>
<div class="alert alert-warning"><p>Mind this.</p></div><img src="a.png" srcset="b.png 100w, c.png 900w"><iframe src="https://www.youtube.com/embed/abcdefghijk"></iframe>
<table><tr><td><p>only cell</p></td></tr></table><span class="katex"><math><annotation>x^2</annotation></math></span><figure><img src="f.png"><figcaption>Cap</figcaption></figure><ol class="footnotes"><li id="fn1">Note <a href="#fnref1">↩</a></li></ol><h2>boats</h2>"""
    made = to_markdown(page, "https://h.example/d/", "Boats")
    assert made.startswith("## Boats\n\n## More\n\nSee [x](https://h.example/x) and bad[^1].\n\n> [!warning]\n> Mind this.") and "![](https://h.example/d/c.png)" in made and "(https://www.youtube.com/watch?v=abcdefghijk)" in made
    assert "only cell" in made and "|" not in made and "$x^2$" in made and "*Cap*" in made and "[^1]: Note" in made and not made.rstrip().endswith("boats")


def test_rules_take_out_what_surrounds(spark):
    body = "<body><nav>Home</nav><p class='eyebrow'>News</p><h1>Title of it</h1><p>By Ann Miller</p><p>3 min read</p><p>" + "The first paragraph of the page has many words, and it goes on and on. " * 12 + "</p><div>Share this story</div><h3>Related stories</h3><ul><li><a href='/1'>one two</a></ul><p>© 2024 All rights reserved</p></body>"
    found = nodes(spark, body)
    rules = {r["rule"] for r in noise.removals(found).collect()}
    assert noise.report(found).count() >= 5 and {"noise", "byline", "read_time", "share", "related", "boilerplate"} <= rules
    left = html_nodes.text_of(html_nodes.without_subtrees(found, noise.removals(found))).first()["text"]
    assert left.startswith("Title of it The first paragraph") and "Share" not in left and "rights" not in left


def test_readers_and_threads(spark):
    urls = ["https://github.com/a/b/issues/5", "https://github.com/a/b", "https://news.ycombinator.com/item?id=1", "https://x.com/a/status/9", "https://example.org/"]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r["x"] for r in frame.select(site_pages.reader_of(F.col("u")).alias("x")).collect()] == ["issue", "repository", "news_thread", "post", None]
    rows = "".join(f"<tr class='athing comtr' id='c{k}'><td class='ind' indent='{d}'></td><td><a class='hnuser'>u{k}</a><span class='commtext'>text {k}</span></td></tr>" for k, d in enumerate((0, 1, 2, 1)))
    thread = site_pages.indented_comments(nodes(spark, f"<table>{rows}</table>"))
    found = {r["id"]: r["parent_id"] for r in threads.parents_by_depth(thread.select("thread_id", "pos", "depth", "id")).collect()}
    assert found == {"c0": None, "c1": "c0", "c2": "c1", "c3": "c0"}
    nested = nodes(spark, "<div class='comment'><i class='a'>x</i><p class='b'>one</p><div class='comment'><i class='a'>y</i><p class='b'>two</p></div></div>")
    made = {r["author"]: (r["body"], r["parent_id"]) for r in site_pages.nested_comments(nested, "comment", "a", "b").collect()}
    assert made == {"x": ("one", None), "y": ("two", 0)}
    codes = spark.createDataFrame([("[b]x[/b] [url=https://a.b]y[/url] [list][*]one[*]two[/list]",)], "t string")
    assert codes.select(site_pages.bbcode_html(F.col("t")).alias("h")).first()["h"] == '<strong>x</strong> <a href="https://a.b">y</a> <ul><li>one</li><li>two</li></ul>'


_PROSE = "<p>" + "The keeper of the ferry counted the boats twice, and nobody, he said, had seen the other bank before noon. " * 8 + "</p>"


NOISE_PAGES = [
    ("promo", "<div id=x><a href=/sale>Spring sale on all ropes</a></div><h1>T</h1>" + _PROSE), ("hero", "<header id=x><h1>T</h1><time>2 May 2021</time></header>" + _PROSE), ("orphan_contents", "<h1>T</h1><p id=x>Contents</p>" + _PROSE),
    ("metadata", "<h1>T</h1><p id=x>UTC+2</p>" + _PROSE), ("metadata", "<h1>T</h1>" + _PROSE + "<p id=x>Page of boats</p>"), ("metadata_list", "<ul id=x><li>Harbour</li><li>Two minutes</li></ul><h1>T</h1>" + _PROSE), ("section_breadcrumb", "<h1>T</h1><p id=x><a href=/boats/>Boats</a></p>" + _PROSE),
    ("trailing_links", "<h1>T</h1>" + _PROSE + "<h3 id=x>Elsewhere</h3><ul><li><a href=https://a.org/>A long way off</a></li><li><a href=https://b.org/>Another one</a></li></ul>"), ("related_posts", "<h1>T</h1>" + _PROSE + "<section id=x><p><a href=/a>One story of ours</a></p><p><a href=/b>Two stories of ours</a></p></section>"),
    ("related_intro", "<h1>T</h1>" + _PROSE + "<p id=x>For more on ferries, see our pages.</p>" + _PROSE), ("cards", "<h1>T</h1>" + _PROSE + "<div id=x>" + "<div><a href=/a>A story of boats</a> told again by the keeper</div>" * 4 + "</div>" + _PROSE), ("newsletter_list", "<h1>T</h1>" + _PROSE + "<ul id=x><li>Subscribe to letters</li></ul>" + _PROSE),
    ("contact", "<h1>T</h1>" + _PROSE + "<p id=x>Write to the keeper at keeper@boats.example or call.</p>"), ("scored", "<h1>T</h1>" + _PROSE + "<div id=x>Home Menu Search</div>" + _PROSE), ("noise", "<h1>T</h1><div class=sidebar id=x>words beside it all</div>" + _PROSE),
]
RULES = {"promo": noise.promo_banners, "hero": noise.hero_headers, "orphan_contents": noise.orphan_contents, "metadata": noise.metadata_candidates, "metadata_list": noise.metadata_lists, "section_breadcrumb": noise.section_breadcrumbs, "trailing_links": noise.trailing_links, "related_posts": noise.trailing_related, "related_intro": noise.related_intros, "cards": noise.related_cards, "newsletter_list": noise.newsletter_lists, "contact": noise.author_contacts, "scored": noise.scored_blocks, "noise": html_nodes.noise_nodes}


def test_noise_rules(spark):
    """Each page has one block that its rule, and the rules together, take out; prose stays."""
    pages = [f"<html><head><title>Page of boats</title><link rel=canonical href=https://h.example/boats/ferry></head><body><article>{inside}</article></body></html>" for _, inside in NOISE_PAGES]
    held = "<body><article class=post><header class=banner>Top</header>" + _PROSE + "<pre><span class=widget>code</span></pre><ol class=footnotes><li>note</li></ol></article></body>"
    made = shared.materialise(nodes(spark, *pages, held), "pages")
    roots = {r["page_id"]: r["pre"] for r in made.where("attrs['id'] = 'x'").collect()}
    placed = shared.materialise(noise.with_page(made), "placed")
    for name, rule in RULES.items():
        found = {(r["page_id"], r["pre"]) for r in rule(placed).collect()}
        assert all((k, roots[k]) in found for k, (wanted, _) in enumerate(NOISE_PAGES) if wanted == name), (name, found)
    spans = noise.removals(made).collect()
    assert all(any(r["page_id"] == k and r["pre"] <= root <= r["last"] for r in spans) for k, root in roots.items())
    prose = [(r["page_id"], r["pre"]) for r in made.where("tag = 'p' and words > 100").collect()]
    assert len(prose) >= len(pages) and not [(p, r) for p in prose for r in spans if r["page_id"] == p[0] and r["pre"] <= p[1] <= r["last"]]
    last = len(pages)
    kept = {r["pre"] for r in noise.protected_nodes(made.where(f"page_id = {last}")).collect()}
    assert {r["pre"] for r in made.where(f"page_id = {last} and tag in ('article', 'header', 'pre', 'span', 'ol')").collect()} <= kept
    assert not {r["pre"] for r in spans if r["page_id"] == last and r["rule"] in ("noise", "scored")} & kept


def test_markdown_is_tidy():
    made = to_markdown("<hr><!-- c --><section><div><h1>T</h1></div></section><p></p><ul><li></li><li>one</li></ul><a href='/s'><h3>Card</h3><p>about it</p></a><h2 id=x><a href='#x'>Part</a></h2><p><code>a <a href='/b'>b</a></code> and <span>bare</span><span></span></p><p>end</p><hr>")
    assert made == "# T\n\n- one\n\n### [Card](/s)\n\nabout it\n\n## Part\n\n`a b` and bare\n\nend"
    assert to_markdown("<p>a</p><hr><p>b</p>") == "a\n\n---\n\nb" and to_markdown("<hr>") == "" and to_markdown("") == ""
