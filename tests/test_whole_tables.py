"""Queries that take every row their operator is made for, on small tables."""

import pytest

from foliospark import catalog
from tests.fixtures import write_tables


def test_pages_of_any_length_are_scored(spark, tmp_path):
    texts = ["short", "word " * 100, "".join(f"Line {k} of a long page, with its own words.\n\n" for k in range(60)), None]
    pages = [{"fetch_id": k, "content": t, "browser_content": (t or "x") + " more"} for k, t in enumerate(texts)]
    folder = write_tables(tmp_path, {"fetch_cache": [*pages, {"fetch_id": 9, "content": "text without a browser's"}]})
    found = {r["fetch_id"]: r["score"] for r in catalog.QUERIES["rendering_scores"](spark, folder).collect()}
    assert found == dict.fromkeys(range(4), 100.0)


WORDS = "The keeper walked to the gate, counted the boats twice, and wrote it all down before noon. "


@pytest.mark.parametrize("name", ["html_markdown", "html_texts", "html_links", "noise_report", "extraction_levels", "content_starts"])
def test_pages_with_code_are_read(spark, tmp_path, name):
    body = f"<nav>Home</nav><article><h1>T</h1><p>{WORDS * 6}<a href='/x'>out</a></p>%s</article>"
    codes = ["", "<pre><code class='language-py'>a = 1\n</code></pre>", "<p>~~~ and ```</p>"]
    folder = write_tables(tmp_path, {"fetch_cache": [{"fetch_id": k, "static_content": body % code} for k, code in enumerate(codes)]})
    rows = catalog.QUERIES[name](spark, folder).collect()
    if name == "noise_report":
        rows = [r for r in rows if r["rule"] == "noise"]
    assert {r["fetch_id" if "fetch_id" in r else "page_id"] for r in rows} == {0, 1, 2}
    if name == "html_markdown":
        assert "```py\na = 1\n```" in next(r for r in rows if r["fetch_id"] == 1)["markdown"]


def test_tags_of_pages_with_code_are_counted(spark, tmp_path):
    pages = ["<h2>A</h2><p>x</p>", "<h2>B</h2><ul><li>y</ul><pre>&lt;h2> z</pre>"]
    folder = write_tables(tmp_path, {"fetch_cache": [{"fetch_id": k, "static_content": p} for k, p in enumerate(pages)]})
    assert {r["tag"]: r["n"] for r in catalog.QUERIES["html_tags"](spark, folder).collect()} == {"h2": 2, "li": 1, "ul": 1}
    assert {r["level"]: r["headings"] for r in catalog.QUERIES["html_outline"](spark, folder).collect()} == {"2": 2}


def first_title(text: str) -> str | None:
    """The first level-one heading, line by line: after the front matter, outside fences."""
    lines, fence = text.split("\n"), ""
    if lines[0] == "---":
        lines = lines[lines.index("---", 1) + 1 :]
    for line in lines:
        mark = line[:3]
        if fence:
            fence = "" if mark == fence else fence
        elif mark in ("```", "~~~"):
            fence = mark
        elif line.startswith("# ") and line[2:].strip():
            return line[2:].strip()
    return None


def test_documents_of_any_format_have_titles(spark, tmp_path):
    heads = ["", "---\ntitle: x\n# no: y\n---\n"]
    codes = ["", "```\n# no\n```\n", "~~~sh\n# no\n```\n# no\n~~~\n", "```\n# no, never closed\n"]
    bodies = ["# One\n\n# Two", "## Only two", "text\n# Late\n", ""]
    texts = [h + c + b for h in heads for c in codes for b in bodies]
    documents = [{"doc_id": 100 * f + k, "text": t, "fmt": fmt} for f, fmt in enumerate(("md", "ipynb", "html", "txt", None)) for k, t in enumerate(texts)]
    folder = write_tables(tmp_path, {"documents": [*documents, {"doc_id": 9999, "fmt": "md"}]})
    found = {r["doc_id"]: r["h1"] for r in catalog.QUERIES["document_titles"](spark, folder).collect()}
    assert found == {d["doc_id"]: first_title(d["text"]) for d in documents}
