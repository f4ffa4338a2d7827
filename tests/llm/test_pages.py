import itertools
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliospark.llm import blocks, labelled_pages, main_content, markup, residue, site_lines
from foliospark.llm.blocks import scan, visible
from tests.conftest import DATA


def test_crf_on_held_out_pages():
    crf = markup.trained()
    right = total = 0
    for page in markup.labelled_pages(300, seed=91):
        path = crf.viterbi([crf.evidence(names) for names, _ in page])
        right += sum(markup.LABELS[k] == label for k, (_, label) in zip(path, page))
        total += len(page)
    assert right / total > 0.99


@pytest.mark.parametrize("text, wanted", [
    ("# a\n\n- x\n- y\n\n```\n# no\n- no\n```\n\nb $x^2$ and ($5 to $7) `$z$`", (1, 2, 1, 1)), ("== a ==\n\n# one\n# two\n\n'''b''' <math>x</math>\n\n<syntaxhighlight>\n== no ==\n</syntaxhighlight>", (1, 2, 1, 1)),
    ("<h2>a</h2>\n\n<p>one <b>two</b> \\(x\\)</p>\n\n<ul>\n<li>x\n<li>y</li>\n</ul>\n\n<pre><code>&lt;li&gt;no</code></pre>", (1, 2, 1, 1)), ("\\section{a}\n\n\\begin{itemize}\n\\item x\n\\end{itemize}\n\n\\begin{verbatim}\n\\item no\n\\end{verbatim}\n\n\\[ x \\]", (1, 1, 1, 1)),
    ("a\n===\n\ntext\n\nb\n---\n\n$$\nx\n$$", (2, 0, 0, 1)), ("Plain title\n\nJust text; more text.", (0, 0, 0, 0)), ("", (0, 0, 0, 0)), (None, (0, 0, 0, 0)), ("```\nnever closed\n# x", (0, 0, 1, 0)), ("1. a\n2. b\n\nIn 1984. it", (0, 2, 0, 0)),
])
def test_elements(text, wanted):
    found = markup.ElementReader(markup.trained(), markup.trained_inline()).counts(text)
    assert (found["heading"], found["item"], found["code"], found["formula"]) == wanted


@pytest.mark.parametrize("text, wanted", [
    ("costs $5 or $6, and $x + 1$ more", ["$x + 1$"]), ("$a$ and $b$", ["$a$", "$b$"]), ("set $HOME and $PATH, then go", []), (r"\(a < b\) and <math>x</math>", [r"\(a < b\)", "<math>x</math>"]), ("it was $ 5", []), ("", []), ("$", []), ("$$x^2$$ is", ["$$x^2$$"]), ("from $3 to $x^2$", ["$x^2$"]),
])
def test_formulas_and_amounts(text, wanted):
    reader = markup.ElementReader(markup.trained(), markup.trained_inline())
    assert [text[a:b] for a, b in reader.formulas(text)] == wanted


def test_inline_chain_on_held_out_lines():
    crf = markup.trained_inline()
    right = total = 0
    for chain in markup.labelled_lines(400, 93):
        path = crf.viterbi([crf.evidence(names) for names, _ in chain])
        right += sum(("other", "formula")[k] == label for k, (_, label) in zip(path, chain))
        total += len(chain)
    assert right / total > 0.98


def test_clean_text_shows_structure():
    reader = markup.ElementReader(markup.trained(), markup.trained_inline())
    clean = markup.clean_marked("== Title ==\n\n* '''one''' [[A|two]]\n* three\n\n<syntaxhighlight lang=\"x\">\na < b\n</syntaxhighlight>\n\nText <math>x^2</math> end.", reader)
    assert clean == "# Title\n\n- one two\n- three\n\n```\na < b\n```\n\nText $x^2$ end."


def test_blocks_cover_every_line_once():
    rng = random.Random(2)
    bits = ["# a", "- b", "```", "", "<li>c", "text", "> q", "$$", "\\[", "===", "<pre>", "</pre>", "| t |", "\\begin{verbatim}"]
    for _ in range(300):
        text = "\n".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        covered = [n for b in scan(text) for n in range(b.start, b.end)]
        assert set(covered) >= {n for n, line in enumerate(text.split("\n")) if line.strip() and not line.strip().startswith("===")} - {n for b in scan(text) for n in range(b.start, b.end)} and max(covered, default=0) < text.count("\n") + 1
    assert visible("**a** [b](https://x.y) <i>c</i> &amp; ''d''") == "a b c & d"


def _judged(model, pages):
    """(own by the first tree, truth) and (own by the second, truth) of the lines of labelled pages, as a corpus."""
    reader = main_content.LineReader()
    trees = [main_content.leaves("\n".join(x for x, _ in lines), site.lower().replace(" ", ""), main_content.page_titles(None, title), reader) for site, title, lines in pages]
    truth = [lines[x.line_no - 1][1] for tree, (_, _, lines) in zip(trees, pages) for x in tree]
    record, found = model.count(trees, range(len(trees)))
    keys, where = np.unique(found.key[found.first], return_inverse=True)
    lexicon = main_content.Lexicon(keys, np.bincount(where, found.own[found.first]), np.bincount(where).astype(float))
    known, low = main_content.known_words(lexicon, found.group, found.leaf, found.key, found.own, len(record))
    cuts = np.cumsum([0, *map(len, trees)])
    placed = [main_content.place([(x.shape, x.long, x.after_blank) for x in tree], known[a:b], low[a:b]) for tree, a, b in zip(trees, cuts, cuts[1:])]
    odds = np.concatenate(model.worded.odds(placed))
    alone = np.array([model.worded.evidence.score(k) for p in placed for k in p.keys])
    return [(o, a, t) for o, a, t in zip(odds > 0, alone > 0, truth) if t >= 0]


def test_main_content_on_held_out_words(monkeypatch):
    """Trained with half of the lines that sites put around pages; judged on pages that have the other half only, with other
    sentences, titles and names."""
    halves = {name: (tuple(getattr(labelled_pages, name)[::2]), tuple(getattr(labelled_pages, name)[1::2])) for name in ("MENU", "AROUND", "NOTICES", "TITLES", "HEADINGS", "SENTENCES", "STOCK", "ITEMS", "NAMES", "SITES")}
    halves["AROUND"] = tuple((*halves["MENU"][h], *labelled_pages.AROUND[len(labelled_pages.MENU) + h :: 2]) for h in (0, 1))
    for name in halves:
        monkeypatch.setattr(labelled_pages, name, halves[name][0])
    model = main_content.ContentModel(900)
    for name in halves:
        monkeypatch.setattr(labelled_pages, name, halves[name][1])
    found = _judged(model, labelled_pages.pages(500, 77))
    around = [(o, a) for o, a, t in found if t == 0]
    assert sum(not o for o, _ in around) / len(around) > 0.95
    assert sum(o == bool(t) for o, _, t in found) / len(found) > 0.96
    # the tree mends what lines by themselves get wrong
    assert sum(o == bool(t) for o, _, t in found) > sum(a == bool(t) for _, a, t in found)


def test_messages_on_a_tree_equal_enumeration():
    """Marginals of random trees of three levels against all assignments."""
    rng = np.random.default_rng(1)
    for _ in range(5):
        score, parents = rng.normal(size=4), (np.array([0, 0, 1, 2]), np.array([0, 1, 1]), np.array([0, 0]))
        levels = tuple((p, np.log(rng.dirichlet((1, 1), (len(p), 2))), n) for p, n in zip(parents, (3, 2, 1)))
        root = np.log(rng.dirichlet((1, 1)))
        found = main_content.marginals(score, levels, root)
        weight = np.zeros((4, 2))
        for states in itertools.product((0, 1), repeat=10):
            at = (states[:4], states[4:7], states[7:9], states[9:])
            value = root[at[3][0]] + sum(s * y for s, y in zip(score, at[0])) + sum(pot[k, at[level + 1][p[k]], at[level][k]] for level, (p, pot, _) in enumerate(levels) for k in range(len(p)))
            for k in range(4):
                weight[k, at[0][k]] += np.exp(value)
        assert np.allclose(found, np.log(weight[:, 1] / weight[:, 0]))


def test_labelled_pages_have_sentences_of_their_own():
    """No labelled line of four words or more stands in the tables."""
    if not DATA.exists():
        pytest.skip("no tables here")
    texts = []
    for name, columns in (("fetch_cache", ("content", "static_content", "browser_content", "title")), ("web_metadata", ("title", "description")), ("documents", ("text", "title")), ("ocr_results", ("text",))):
        for column in pq.read_table(DATA / "sf0.01" / f"{name}.parquet", columns=list(columns)).columns:
            texts += [t for t in column.to_pylist() if t]
    flat = lambda t: re.sub(r"\d+", "0", t.lower())
    whole = flat("\n".join(texts))
    lists = ("AROUND", "NOTICES", "TITLES", "HEADINGS", "SENTENCES", "STOCK", "ITEMS", "CODES", "MESSAGES")
    assert [line for name in lists for line in getattr(labelled_pages, name) if len(line.split()) > 3 and flat(line) in whole] == []


def test_lines_are_remembered_for_every_site():
    reader = main_content.LineReader()
    line = "Become a member of Harbor Notes"
    one, two, three = (reader.read(line, "", site) for site in ("a.example", "harbornotes.example", "b.example"))
    assert one == three and one[2] != two[2] and "site" in two[4] and reader.read("   ---", "", "") is None


def test_main_text_keeps_the_page(spark):
    page = "Home | About | Contact\n\nHow to mend an old clock\n\nThe keeper walked to the gate and counted the boats twice before noon. Nobody expected the bridge to hold.\n\n> We use cookies to improve your visit. Accept all | Settings\n\nShare: Mail | Copy link | Print\n© 2024 River Post. All rights reserved."
    body = page.split("\n\n", 2)
    rng = random.Random(3)
    # a corpus of a few pages knows little: what their headlines are their records say
    heads = [labelled_pages._some_title(rng) for _ in range(14)]
    others = [(k, f"https://river-post.example/{k}", heads[k], "\n\n".join([body[0], heads[k], labelled_pages._prose(rng) + " " + labelled_pages._prose(rng), *body[2].split("\n\n")[2:]]), None, "") for k in range(2, 14)]
    rows = spark.createDataFrame([(1, "https://river-post.example/x", "How to mend an old clock", page, None, ""), *others], "fetch_id long, url string, title string, content string, static_content string, browser_content string")
    found = main_content.main_texts(rows).where("fetch_id = 1").first()
    assert found["content"] == "How to mend an old clock\n\nThe keeper walked to the gate and counted the boats twice before noon. Nobody expected the bridge to hold.\n\n> We use cookies to improve your visit. Accept all | Settings"
    assert found["static_content"] is None and found["browser_content"] == ""


def test_words_of_plain_lines_are_cheap():
    """The words of ASCII and marked lines are those of the general patterns, for less than their time."""
    rng = random.Random(4)
    signs = [*"abZ09 _.|/:*`'<>-\t\x1c", "é", "²", "٣", "Σ", "İ", "…", "»", "''", "**", "site "]
    general = lambda t: main_content._WORD.findall(re.sub(r"\d+", "0", t.lower()))
    emphasis = re.compile(r"'{2,5}|(?<![\w*])\*{1,3}(?=\S)|(?<=\S)\*{1,3}(?![\w*])|(?<![\w])_{1,3}(?=\S)|(?<=\S)_{1,3}(?![\w])|`+")
    for _ in range(5000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 40)))
        assert main_content.tokens(text, "") == general(text) and blocks._EMPHASIS.sub("", text) == emphasis.sub("", text)

    def seconds(read):
        start = time.process_time()
        for _ in range(300):
            read(line)
        return time.process_time() - start

    line = "The keeper walked to the **gate** and counted 12 boats twice before noon; nobody had expected the bridge to hold. " * 2
    ratio = lambda one, two: min(seconds(one) / seconds(two) for _ in range(5))
    assert ratio(lambda t: main_content.tokens(t, ""), general) < 0.7
    assert ratio(lambda t: blocks._EMPHASIS.sub("", t), lambda t: emphasis.sub("", t)) < 0.7


def test_main_content_counts_every_key(spark, monkeypatch):
    """Lines are judged by the keys of two records or more, in a corpus of any size and in parts of any size; LEAST_SHARE
    was the share of all keys under which the former lexicon left a key out."""
    monkeypatch.setattr(main_content, "LEAST_SHARE", 0.02, raising=False)
    monkeypatch.setattr(main_content, "SLICE", 7)
    pages = [(k, f"https://{site.lower().replace(' ', '')}/{k}", title, "\n".join(line for line, _ in lines)) for k, (site, title, lines) in enumerate(labelled_pages.pages(60, 12))]
    reader = main_content.LineReader()
    trees = [main_content.leaves(text, main_content.site_name(url), main_content.page_titles(url, title), reader) for _, url, title, text in pages]
    model = main_content.trained()
    record, found = model.count(trees, range(len(trees)))
    keys, where = np.unique(found.key[found.first], return_inverse=True)
    own, count = np.bincount(where, found.own[found.first]), np.bincount(where).astype(float)
    wanted = {}
    for least in (2, max(2, 0.02 * count.sum())):
        lexicon = main_content.Lexicon(keys[count >= least], own[count >= least], count[count >= least])
        known, low = main_content.known_words(lexicon, found.group, found.leaf, found.key, found.own, len(record))
        cuts = np.cumsum([0, *map(len, trees)])
        odds = model.worded.odds([main_content.place([(x.shape, x.long, x.after_blank) for x in tree], known[a:b], low[a:b]) for tree, a, b in zip(trees, cuts, cuts[1:])])
        wanted[least] = {(k, x.line_no) for k, (tree, o) in enumerate(zip(trees, odds)) for x, one in zip(tree, o) if one <= main_content.OWN_FROM}
    frame = spark.createDataFrame(pages, "fetch_id long, url string, title string, content string").repartition(3)
    judged = {(r["fetch_id"], r["line_no"]) for r in main_content.judged_lines(frame, False, fields=("content",)).collect()}
    assert judged == wanted[2] != wanted[max(2, 0.02 * count.sum())]


def test_main_content_keys_of_a_large_corpus(spark):
    """A key of two records is known among three million others, where the lexicon once had no room for it."""
    parts = spark.range(300).select(F.col("id").alias("part"), F.concat(F.array(F.lit(-1) - F.floor(F.col("id") / 2)), F.sequence(F.col("id") * 10_000, F.col("id") * 10_000 + 9_999)).alias("part_key"))
    lines = parts.select("part", "part_key", F.transform("part_key", lambda _: F.lit(0.25)).alias("part_own"), F.transform("part_key", lambda _: F.lit(1)).alias("part_n"))
    known, prior = main_content.corpus_keys(lines)
    assert [tuple(r) for r in known.orderBy("part", "key").collect()] == [(k, 0, 0.5, 2) for k in range(300)] and prior == 0.25


@pytest.fixture(scope="module")
def index():
    return residue.ResidueIndex({w: 3000 for w in ("the", "to", "this", "page", "your", "a", "of", "is", "for")}, 10_000)


@pytest.mark.parametrize("text, wanted", [
    ("404 Not Found\n\nThe page you requested could not be located on this server.", True), ("Please enable JavaScript to view this page.", True), ("Hello {{ first_name }} and welcome.", True), ("Use `{{ first_name }}` here.", False), ("```\n{{ a_b }}\n```\n\nText.", False),
    ("Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod.", True), ("Printers have set lorem ipsum as dummy copy for centuries.", False), ("Own words of a page, which go on for a while.\n\nSome features of this page need JavaScript.", False),
    ("He saw [INSERT NAME HERE] at the gate.", True), ("Cost {amount} was", True), ("\\emph{amount} of water", False), ("“Your text goes here. Replace this paragraph with your own words.”", False), ("Your text goes here. Replace this paragraph with your own words.", True), ("", False), (None, False), ("x" * 50_000, False),
])
def test_residue(index, text, wanted):
    assert index.content_residue(text) is wanted


@pytest.mark.parametrize("title, wanted", [("Error", True), ("Access denied", True), ("Access denied: the locked kiln of 1950", False), ("404 Not Found", True), ("Why our 404 page became popular", False), ("%TITLE_X%", True), ("Lorem ipsum dolor sit amet", True), ("A short history of lorem ipsum", False), (None, False), ("", False)])
def test_title_residue(index, title, wanted):
    assert index.title_residue(title) is wanted


def test_line_counts_grow_by_deltas(spark, tmp_path):
    pages = [(k, f"k{k % 9}", f"https://a.example/{k % 7}", "The very same footer of this site\n" + ("Another line that stands here often\n" if k % 2 else "") + ("A line of the first few pages only\n" if k < 4 else "") + f"own {k}") for k in range(20)] + [(20 + k, "k1", f"https://a.example/p{k}", f"own {k}") for k in range(30)]
    schema = "fetch_id long, cache_key string, url string, content string"
    metadata = spark.createDataFrame([(f"k{k}", "a.example") for k in range(9)], "cache_key string, domain string")

    def parts(rows):
        frame = spark.createDataFrame(rows, schema)
        return site_lines.page_lines(frame, metadata), site_lines.page_sources(frame.select("cache_key", F.xxhash64("url").alias("url_key")), metadata)

    rows = lambda frame: sorted(map(tuple, frame.collect()))
    made = lambda name: site_lines.LineStore(spark, f"file://{tmp_path}/{name}")
    for name, end in (("growing", 20), ("lapsing", 50)):
        whole = site_lines.repeated_lines([parts(pages[:end])], made(f"{name}-whole"))
        bits = [parts(pages[a:b]) for a, b in ((0, 3), (3, 12), (8, 12), (12, end))]
        assert rows(site_lines.repeated_lines(bits, made(f"{name}-bits"))) == rows(whole), name
    first, second = made("a").add(*parts(pages[:12])).repeated(), made("b").add(*parts(pages[:20])).repeated()
    crossed, lapsed = site_lines.changed(first, second)
    assert crossed.count() + first.count() - lapsed.count() == second.count() and second.count() == 3
    found = site_lines.repeated_lines([parts(pages[:20])], made("c"))
    cleaned = {r["fetch_id"]: r["content"] for r in site_lines.strip_lines(spark.createDataFrame(pages[:20], schema), found).collect()}
    assert cleaned[0] == "own 0" and len(cleaned) == 20


def test_parts_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(site_lines, "MOST_DELTAS", 2)
    store = site_lines.LineStore(spark, f"file://{tmp_path}/lines")
    lines = lambda k: spark.createDataFrame([("s", bytearray(b"x"), u) for u in range(k)], "source string, line_key binary, url_key long")
    for k in (3, 5, 5, 9):
        state = store.add(lines(k), lines(k).drop("line_key"))
        assert state.counts.first()["n_urls"] == k and state.totals.first()["all_urls"] == k and state.seen.count() == k
    assert len(store.parts()["seen"]) == 2 and len(list((tmp_path / "lines").glob("part-*"))) == 8
