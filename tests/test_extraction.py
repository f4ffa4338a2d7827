from pyspark.sql import functions as F

from foliospark.functions import paths
from foliospark.operators import extraction, html_nodes, reports

WORDS = "The keeper walked to the gate, counted the boats twice, and wrote it all down before noon. "


def nodes(spark, *pages):
    return html_nodes.parse_nodes(spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "id long, html string"), "id", "html")


def test_levels_climb_only_when_they_must(spark):
    good = f"<body><nav>Home</nav><article><h1>T</h1><p>{WORDS * 6}</p></article></body>"
    classed = f"<body><article><h1>T</h1><div class='sidebar'><p>{WORDS * 6}</p></div></article></body>"
    hidden = f"<body><article><h1>T</h1><div style='display:none'><p>{WORDS * 6}</p></div></article></body>"
    found = {r["page_id"]: r["level"] for r in extraction.extraction_levels(nodes(spark, good, classed, hidden)).collect()}
    assert found == {0: 1, 1: 2, 2: 3}


def test_content_starts_behind_the_heading(spark):
    page = f"<body><p>{WORDS}</p><h1>T</h1><p>short</p><p>{WORDS}</p></body>"
    starts = {r["page_id"]: r["start"] for r in extraction.content_start(nodes(spark, page, f"<p>{WORDS}</p>")).collect()}
    assert starts == {0: 4, 1: 0}


def test_linked_text_stands_in_for_less(spark):
    page = '<body><script type="application/ld+json">{"articleBody": "one two three four five six seven eight"}</script><div><p>one two three four five six seven eight</p></div></body>'
    found = nodes(spark, page)
    texts = spark.createDataFrame([(0, "one two")], "page_id long, text string")
    assert extraction.schema_fallback(found, texts).first()["from_schema"] and not extraction.schema_fallback(found, texts.withColumn("text", F.lit("a b c d e f"))).first()["from_schema"]
    assert extraction.smallest_holder(found, extraction.schema_bodies(found)).first()["pre"] == 3


def test_layout_tables(spark):
    found = nodes(spark, "<table width='600'><tr><td>a</table><table><tr><td width='10'>a<td>b</table><table><tr><td>a</table>")
    assert {r["pre"] for r in extraction.layout_tables(found).collect()} == {0, 3}


def test_paths(spark):
    frame = spark.createDataFrame([("/a/b/../c", "/a"), ("/a/../../x", "/a"), ("/ab", "/a"), ("/a", "/a")], "p string, b string")
    assert [r["x"] for r in frame.select(paths.within(F.col("p"), F.col("b")).alias("x")).collect()] == [True, False, False, True]
    names = spark.createDataFrame([("a.llm.md", 1), ("a.llm.md", 2), ("x.y.md", 3)], "n string, v int")
    assert [r["x"] for r in names.select(paths.versioned(F.col("n"), F.col("v")).alias("x")).collect()] == ["a.llm.md", "a.v2.llm.md", "x.y.v3.md"]
    assert spark.range(1).select(paths.suffix_of_type(F.lit("image/jpeg; q=1")).alias("x"), paths.output_name(F.lit("d/a.pdf")).alias("y")).first() == ("jpg", "a.pdf.md")


def test_names_of_sets():
    assert reports.pool_name([("b", 1), ("a", 1), ("a", 2), ("c", 0)]) == reports.pool_name([("a", 1), ("b", 3)]) and reports.pool_name([]) == "pool:none"
    assert reports.task_hash({"a": 1, "b": 2}) == reports.task_hash({"b": 2, "a": 1}) and len(reports.task_hash({})) == 6
