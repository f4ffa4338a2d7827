import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.functions import stages
from foliospark.operators import cache_tables, extraction, html_nodes, images, reports, sections, threads
from foliospark.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def _rels(**targets):
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{k}" Target="{t}"/>' for k, t in targets.items()) + "</Relationships>"


ARCHIVES = {
    "epub": (_zip(**{"META-INF/container.xml": '<c xmlns="urn:x"><rootfile full-path="O/b.opf"/></c>', "O/b.opf": '<package xmlns="urn:p"><title>Boats</title><item id="two" href="t/2.xhtml"/><item id="one" href="1.xhtml"/><itemref idref="one"/><itemref idref="two"/><itemref idref="lost"/></package>', "O/1.xhtml": "<h2>One</h2><p>first</p>", "O/t/2.xhtml": "<p>second</p>"}), "# Boats\n\n## One\n\nfirst\n\nsecond"),
    "docx": (_zip(**{"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">one </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>two</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>a</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}), "## Head\n\none **two**\n\n- a\n- b\n\n| x | y |\n| --- | --- |"),
    "pptx": (_zip(**{"ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="2" r:id="r2"/><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": _rels(r1="slides/s1.xml", r2="slides/s2.xml"), "ppt/slides/s1.xml": f"<p:sld {P}><p:sp><a:p><a:r><a:t>text</a:t></a:r></a:p></p:sp></p:sld>", "ppt/slides/s2.xml": f'<p:sld {P}><p:sp><p:ph type="title"/><a:p><a:r><a:t>Boats</a:t></a:r></a:p></p:sp></p:sld>', "ppt/slides/_rels/s2.xml.rels": _rels(n="../notesSlides/n1.xml"), "ppt/notesSlides/n1.xml": f"<p:notes {P}><a:p><a:t>say it</a:t></a:p><a:p><a:t>2</a:t></a:p></p:notes>"}), "<!-- Slide number: 1 -->\n\n# Boats\n\n### Notes:\nsay it\n\n<!-- Slide number: 2 -->\n\ntext"),
    "xlsx": (_zip(**{"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Tides" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": _rels(r1="worksheets/sheet1.xml"), "xl/sharedStrings.xml": f"<sst {S}><si><t>port</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>4.5</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>'}), "## Tides\n\n| port |  | 4.5 |\n| --- | --- | --- |\n|  | in | TRUE |"),
}


@pytest.mark.parametrize("kind", sorted(ARCHIVES))
def test_archives(kind):
    data, wanted = ARCHIVES[kind]
    assert files.convert(data, kind) == (wanted, None)
    assert files.convert(b"PK no archive", kind)[0] is None and files.convert(b"", kind)[1]


def _one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'binary' if isinstance(values[n], bytes) else 'int' if isinstance(values[n], int) else 'string'}" for n in names)).select(column.alias("x")).first()["x"]


def test_images(spark):
    assert _one(spark, images.heif_brand(F.col("d")), d=b"\x00\x00\x00\x18ftypheic") and not _one(spark, images.heif_brand(F.col("d")), d=b"\x89PNG....1234")
    assert _one(spark, images.content_address(F.col("d"), F.col("n")), d=b"x", n="A.PNG") == "2d711642b726b044.png"
    assert [_one(spark, images.too_small(F.col("w"), F.col("h")), w=w, h=h) for w, h in ((49, 500), (50, 99), (50, 100), (71, 70))] == [True, True, False, True]
    used, stored = spark.createDataFrame([("a.png",), ("b.png",)], "name string"), spark.createDataFrame([("a.png",)] * 2, "name string")
    assert [r["name"] for r in images.missing_references(used, stored).collect()] == ["b.png"]


def test_prompts_quotes_and_keys(spark):
    assert _one(spark, sections.rendered_prompt("Read {text} of {who}; {x} stays", {"text": F.col("t"), "who": F.col("w")}), t="{who}", w="Ann") in ("Read {who} of Ann; {x} stays", "Read Ann of Ann; {x} stays")
    assert _one(spark, sections.foreign_images(F.col("a"), F.col("b")), a="![x](https://a.org/1.png) ![y](https://b.org/2.png) ![z](c.png)", b="![x](https://a.org/1.png)") == ["https://b.org/2.png"]
    assert _one(spark, threads.quote_block(F.col("t")), t="a\n\nb") == "> a\n>\n> b"
    keys = [_one(spark, cache_tables.prompt_key(F.col("p"), F.col("m"), F.col("c")), p=p, m=m, c="text") for p, m in (("a", "b"), ("a", "c"), ("b", "b"))]
    assert len(set(keys)) == 3 and all(len(k) == 32 for k in keys)


def test_stages(spark):
    rows = [("a", None, None), ("b [c]", 3, "p 1/ä.png"), ("", 1, "")]
    made = spark.createDataFrame([("text\n", rows)], "t string, i array<struct<name:string,page:int,path:string>>").select(stages.reference_images(F.col("t"), F.col("i")).alias("x"), stages.reference_images(F.col("t"), F.array().cast("array<struct<name:string,page:int,path:string>>")).alias("y")).first()
    assert made["x"] == "text\n\n<!-- Page images for reference -->\n<!-- ![Page 3](p%201/%C3%A4.png) -->" and made["y"] == "text\n"
    wrap = lambda t: _one(spark, stages.wrapped_payload(F.col("t"), "items"), t=t)
    assert wrap("[1, 2]") == '{"items":[1, 2]}' and wrap('{"a": 1}') == '{"items":[{"a": 1}]}' and wrap('{"items": [1]}') == '{"items": [1]}' and wrap("7") is None and wrap("{bad") is None


def test_jobs(spark, tmp_path):
    items = spark.createDataFrame([("a", "x.md", None), ("b", "x.md", "failed"), ("c", "y.md", None)], "name string, output string, error string")
    run = reports.recorded_run(items, "j1", F.lit(5))
    job = run.first()
    assert job["status"] == "failed" and [(i["name"], i["output"]) for i in job["items"]] == [("a", "x.md"), ("b", "x (2).md"), ("c", "y.md")]
    path = f"file://{tmp_path}/jobs"
    reports.write_jobs(run, path)
    reports.write_jobs(run.withColumn("job_id", F.lit("j2")).withColumn("status", F.lit("running")), path)
    none = spark.createDataFrame([], "job_id string")
    broken = spark.createDataFrame([("j3", "{no json")], "job_id string, value string").withColumn("written_at", F.current_timestamp())
    snapshots = spark.read.parquet(path).unionByName(broken)
    assert [r["job_id"] for r in reports.read_jobs(snapshots, none).collect()] == ["j1"]
    assert reports.read_jobs(snapshots, spark.createDataFrame([("j1",)], "job_id string")).count() == 0
    old = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-03-01")], "job_id string, at string").withColumn("at", F.to_timestamp("at"))
    assert [r["job_id"] for r in reports.stale(old, "at", F.lit("2024-03-02").cast("timestamp"), 7).collect()] == ["a"]


def test_roots_of_repositories_and_tables(spark):
    words = "The keeper walked to the gate and counted boats before noon again. " * 8
    pages = [f"<body><div id=readme><article class=markdown-body><p>{words}</p></article></div><article class=markdown-body>other</article></body>", f"<body><table width=600><tr><td>menu</td><td>{words}</td></tr></table></body>", f"<body><p>{words}</p></body>"]
    nodes = html_nodes.parse_nodes(spark.createDataFrame(list(enumerate(pages)), "id int, html string"), "id", "html")
    assert [(r["page_id"], r["pre"]) for r in html_nodes.readme_nodes(nodes).collect()] == [(0, 2)]
    assert [(r["page_id"], r["pre"]) for r in extraction.table_content(nodes).collect()] == [(1, 4)]
