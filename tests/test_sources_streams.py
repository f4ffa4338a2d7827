import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from foliospark.functions import markdown_text as md
from foliospark.functions import text
from foliospark.operators import documents, images
from foliospark.sources import files, sinks
from foliospark.sources.url_lists import parse_url_lists
from foliospark.streaming import jobs


def test_url_lists(spark):
    rows = [("a", "# note\nhttps://a.org/x\n\nhttps://a.org/y  'my name.md'\nftp://a.org\n"), ("b", json.dumps(["https://b.org", {"url": "https://b.org/2", "output_name": "two"}, 5, {"x": 1}])), ("c", "{}"), ("d", None), ("e", "")]
    found = {(r["file"], r["url"], r["output_name"]) for r in parse_url_lists(spark.createDataFrame(rows, "f string, c string"), "f", "c").collect()}
    assert found == {("a", "https://a.org/x", None), ("a", "https://a.org/y", "my name.md"), ("b", "https://b.org", None), ("b", "https://b.org/2", "two")}


def test_globs(spark):
    paths = ["a.md", "x/a.md", "x/y/a.md", "x/b.txt", ".h/a.md"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    take = lambda *g: [r["p"] for r in frame.where(files.matches_globs(F.col("p"), list(g))).collect()]
    assert take("*.md") == ["a.md"] and take("**/*.md") == ["a.md", "x/a.md", "x/y/a.md", ".h/a.md"] and take("x/**", "!x/y/**") == ["x/a.md", "x/b.txt"] and take() == paths


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": ["x = 1"], "outputs": [{"text": ["1"]}]}]}))
    (tmp_path / "m.eml").write_text("From: a@b.c\nSubject: Hi\nContent-Type: text/html\n\n<p>Body <b>x</b></p>")
    (tmp_path / "h.html").write_text("<h1>x</h1>")
    (tmp_path / "bad.ipynb").write_text("{")
    (tmp_path / "o.doc").write_bytes(b"PK")
    (tmp_path / "p.docx").write_bytes(b"PK")
    found = {r["path"].rsplit("/", 1)[1]: (r["markdown"], r["error"]) for r in files.convert_files(spark, str(tmp_path)).collect()}
    assert found["t.csv"][0] == "| a | b |\n| --- | --- |\n| 1 | 2 |" and found["n.ipynb"][0] == "# T\n\n```python\nx = 1\n```\n\n```\n1\n```" and found["m.eml"][0] == "# Hi\n\n**From:** a@b.c\n\nBody **x**"
    assert found["h.html"][0] == "# x" and found["bad.ipynb"][1].startswith("JSONDecodeError") and found["o.doc"][1] == "no reader for doc" and found["p.docx"][1].startswith("BadZipFile")
    assert {r["relative"] for r in files.discover(spark, str(tmp_path), ["*.csv", "*.html"]).collect()} == {"t.csv", "h.html"}


def test_upserts_and_front_matter(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    put = lambda rows, schema="k int, v string, at int": {(r["k"], r["v"]) for r in sinks.upsert_table(spark, path, spark.createDataFrame(rows, schema), "k", "at").collect()}
    assert put([(1, "a", 1), (2, "b", 1)]) == {(1, "a"), (2, "b")}
    assert put([(1, "new", 2)]) == {(1, "new"), (2, "b")} and put([(3, "c", 1), (1, "old", 0)]) == {(1, "new"), (2, "b"), (3, "c")}
    with pytest.raises(AnalysisException):
        put([(4, 5)], "k int, other int")
    assert put([(4, "d", 9)]) == {(1, "new"), (2, "b"), (3, "c"), (4, "d")}
    assert len(list((tmp_path / "t").glob("base-*"))) == 2
    block = spark.createDataFrame([('a "q"', None)], "t string, l string").select(sinks.frontmatter({"title": F.col("t"), "lang": F.col("l")}).alias("b")).first()["b"]
    assert block == '---\ntitle: "a \\"q\\""\n---\n'


def test_running_lines_and_paragraphs(spark):
    pages = [("d", k, f"Head {k}\nbody {'abcdef'[k]} text\n# Same heading\nmore\nFoot") for k in range(5)] + [("s", k, "Head\nx\ny") for k in range(3)]
    found = {(r["d"], r["p"]): r["text"] for r in documents.strip_running(spark.createDataFrame(pages, "d string, p int, t string"), "d", "p", "t").collect()}
    assert found["d", 0] == "body a text\n# Same heading" and found["s", 0] == "Head\nx\ny"
    long = "word " * 30
    texts = spark.createDataFrame([(1, f"{long}\n\nshort\n\n{long.replace(' ', '  ')}\n\nshort"), (2, None), (3, "")], "id int, t string")
    assert {r["id"]: r["text"] for r in documents.unique_paragraphs(texts, "id", "t").collect()} == {1: f"{long}\n\nshort\n\nshort", 3: ""}


def test_code_hides_headings(spark):
    texts = spark.createDataFrame([(1, "# a\n```\n# no\n~~~\n```\n## b ##\n````\n```\n# no\n````\n#c\n# d")], "id int, t string")
    assert [(r["line_no"], r["level"], r["heading"]) for r in documents.headings(texts, "id", "t").orderBy("line_no").collect()] == [(1, 1, "a"), (6, 2, "b"), (12, 1, "d")]


def test_titles(spark):
    rows = [("", "```\n# no\n```\n\n## Two **x**\n\n# One", "a/b.md"), ("Given [t](u)", "# One", "a.md"), ("", "# One", "data.csv"), (None, None, "https://h.org/x/page.html?q=1"), ("", "<!-- c -->\n![i](u)\nFirst *line*", "z.txt")]
    found = spark.createDataFrame(rows, "e string, c string, s string").select(text.resolve_title(F.col("e"), F.col("c"), F.col("s")).alias("t")).collect()
    assert [r["t"] for r in found] == ["One", "Given t", "data.csv", "page", "First *line*"]


def test_hidden_spans_and_images(spark):
    spans = spark.createDataFrame([(1, 1.0, 12.0, 0, 5.0, 5.0, 9.0, 9.0), (2, 0.0, 12.0, 0, 5.0, 5.0, 9.0, 9.0), (3, 1.0, 1.0, 0, 5.0, 5.0, 9.0, 9.0), (4, 1.0, 12.0, 0xFFFFFF, 5.0, 5.0, 9.0, 9.0), (5, 1.0, 12.0, 0, 500.0, 5.0, 509.0, 9.0)], "id int, alpha double, size double, color int, x0 double, y0 double, x1 double, y1 double")
    page = spans.withColumns({"left": F.lit(0.0), "right": F.lit(100.0), "top": F.lit(0.0), "bottom": F.lit(100.0)})
    assert {r["id"] for r in documents.hidden_spans(page).collect()} == {2, 3, 4, 5}
    texts = spark.createDataFrame([(1, "![a](data:image/png;base64,QUJD) ![b](data:image/png;base64,QUJD) ![c](data:image/gif;base64,!!) ![d](assets/x.png)")], "id int, t string")
    assert [(r["pos"], r["size"]) for r in images.first_of_each(images.embedded(texts, "id", "t"), "id", "pos", "md5").collect()] == [(0, 3)]
    assert [r["name"] for r in images.references(texts, "id", "t").collect()] == ["x.png"]


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    folder = f"{tmp_path}/in"
    spark.createDataFrame([("a", 2, "completed"), ("a", 1, "in_progress"), ("b", 1, "failed")], "item_key string, seq long, status string").coalesce(1).write.parquet(folder)
    spark.createDataFrame([("a", 1, "in_progress"), ("b", 2, "completed")], "item_key string, seq long, status string").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema("item_key string, seq long, status string").option("maxFilesPerTrigger", 1).parquet(folder)
    _drain(jobs.latest_states(source).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/c1").start())
    rows = spark.table("states").groupBy("item_key").agg(F.max_by("status", "seq").alias("s")).collect()
    assert {r["item_key"]: r["s"] for r in rows} == {"a": "completed", "b": "completed"}
    asked = f"{tmp_path}/asked"
    spark.createDataFrame([("c", t) for t in (0, 1, 2, 3, 70)], "client string, ts long").coalesce(1).write.parquet(asked)
    _drain(jobs.admissions(spark.readStream.schema("client string, ts long").parquet(asked), 2).writeStream.outputMode("append").format("memory").queryName("admitted").option("checkpointLocation", f"{tmp_path}/c2").start())
    assert [(r["asked"], r["admitted"]) for r in spark.table("admitted").orderBy("asked").collect()] == [(0, 0), (1, 1), (2, 60), (3, 61), (70, 120)]


def test_held_places_that_stay_are_dropped(spark):
    held, _ = md.protect("a ![i](x.png) b\n<!-- Page number: 3 -->\nc")
    made = spark.createDataFrame([(held,), ("![x](__KEEP_IMAGE_4__) y",), ("no place",), (None,)], "t string").select(text.drop_placeholders(F.col("t")).alias("t")).collect()
    assert "__" in held and [r["t"] for r in made] == ["a  b\nc", " y", "no place", None]


def test_many_paragraphs_and_fences(spark):
    rows = [(1, "\n\n".join(f"{'word ' * 30}{k % 700}" for k in range(3000))), (2, "```\nx\n````\ny\n~~~\nz\n~~~\n```"), (3, ""), (4, None)]
    texts = spark.createDataFrame(rows, "id int, t string")
    assert documents.unique_paragraphs(texts.where("id = 1"), "id", "t").first()["text"] == "\n\n".join(f"{'word ' * 30}{k}" for k in range(700))
    assert [r["in_code"] for r in documents.line_relation(texts.where("id > 1"), "id", "t").orderBy("id", "line_no").collect()] == [True, True, True, False, True, True, True, True, False]
