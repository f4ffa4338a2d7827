import itertools
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import markdown_text as md
from foliospark.operators import markdown_blocks, sections


@pytest.mark.parametrize("given, wanted", [
    ("![a]![b](x.png)", "![b](x.png)"), ("![a]()\ntext", "text"), ("![a](x.png))", "![a](x.png)"), ("(see ![a](x.png))", "(see ![a](x.png))"), ("![a](x(1).png))", "![a](x(1).png)"), ("no image", "no image"), ("", ""),
])
def test_images(given, wanted):
    assert md.mend_images(given) == wanted


def _made(spark, use, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r["made"] for r in frame.select("id", use(F.col("t")).alias("made")).orderBy("id").collect()]


def test_links_and_spacing(spark):
    assert md.mend_links("[Title\n\nmore](/u) x") == "[Title](/u) x"
    made = _made(spark, markdown_blocks.spaced, "a\n# b\nc  \n```\n# d\n~~~\n```\n\n\n\n# e", "x\n# y\nz", "x\n\n# y\n\nz\n", "", "#a\n<!-- Slide number: 3 -->\nb", None)
    assert made == ["a\n\n# b\n\nc\n```\n# d\n~~~\n```\n\n# e\n", "x\n\n# y\n\nz\n", "x\n\n# y\n\nz\n", "\n", "#a\n\n<!-- Slide number: 3 -->\n\nb\n", None]


def test_slide_footers(spark):
    pages = "\n".join(f"<!-- Slide number: {k} -->\n# T{k}\nbody {k} of this one\nACME\n{k}" for k in range(1, 5))
    two = "\n".join(f"<!-- Page number: {k} -->\nown {k}\nACME" for k in range(1, 3))
    made = _made(spark, markdown_blocks.without_footers, pages, "plain", two, "", None)
    assert "ACME" not in made[0] and "body 3 of this one" in made[0] and "\n3" not in made[0] and made[1:] == ["plain", two, "", None]


def test_repeated_blocks_and_tails(spark):
    long = "A long line of prose that goes on for more than fifty characters"
    rows = [(1, f"{long}\n# h\nAnn @ann {long} 5 likes\n{long} with more"), (2, None), (3, ""), (4, f"x{long}\n{long}y\n{long[:55]}")]
    made = markdown_blocks.unrepeated_blocks(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    assert {r["id"]: r["text"] for r in made.collect()} == {1: f"{long}\n# h", 2: None, 3: "", 4: f"x{long}\n{long}y"}
    assert md.cut_repeated_tail("start\n" + "same\n" * 8) == "start\nsame" and md.cut_repeated_tail("fine text") == "fine text"
    unit = "this stretch has over twenty characters. "
    assert md.cut_repeated_tail("Intro. " + unit * 5).rstrip(". ") == ("Intro. " + unit).rstrip(". ")
    assert md.repeated_tail_at("| a | 1 |\n| a | 2 |\n| a | 3 |") is None and md.cut_repeated_tail("") == ""
    wide = "".join(chr(97 + k * k % 23) for k in range(150_000))
    assert md.repeated_tail_at("start " + wide * 4) == len("start " + wide)


def test_what_was_told_equals_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        said = [None if rng.random() < 0.1 else "".join(rng.choice("ab") for _ in range(rng.randint(4, 9))) for _ in range(12)]
        kept, new = [], []
        for one in said:
            fresh = one is None or not any(one in k or k in one for k in kept)
            new.append(fresh)
            if fresh and one is not None:
                kept.append(one)
        assert md.first_tellings(said, 4) == new


@pytest.mark.parametrize("given, wanted", [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": [1, 2,]}\n```', '{"a": [1, 2]}'), ('Sure: {"a": {"b": "c', '{"a": {"b": "c"}}'), ("[1, 2", "[1, 2]"), ("nothing here", None), ("", None)])
def test_json(given, wanted):
    assert md.repair_json(given) == wanted


def test_marks_survive_and_lost_ones_return():
    text = "<!-- Slide number: 1 -->\n\n# A\n\n![x](y.png)\n\n<!-- Slide number: 2 -->\n\n# B"
    held, kept = md.protect(text)
    assert "<!--" not in held and md.unprotect(held, kept) == text
    lost = held.replace("__KEEP_SLIDE_2__", "").replace("__KEEP_IMAGE_1__", "") + "\n<!-- Page number: 9 -->"
    made = md.unprotect(lost, kept)
    assert made.index("Slide number: 2") < made.index("# B") and made.endswith("![x](y.png)") and "Page number: 9" not in made


def test_tau_equals_counting():
    rng = random.Random(1)
    for _ in range(100):
        order = [rng.randint(0, 6) for _ in range(rng.randint(2, 9))]
        pairs = list(itertools.combinations(order, 2))
        tau = (sum(a <= b for a, b in pairs) - sum(a > b for a, b in pairs)) / len(pairs)
        assert abs(md.order_kept(order) - (tau + 1) * 50) < 1e-9


def test_scores(spark):
    rows = [(1, "# A\n\ntext one\n\ntext two", "a\n\ntext one\n\ntext two"), (2, "x", ""), (3, "", "x"), (4, "one thing\n\nother words", "other words\n\none thing"), (5, "the keeper walked to the gate", "so the keeper walks to the gate again"), (6, None, None), (7, "wholly other words", "zzz qqq jjj")]
    found = {r["id"]: r["score"] for r in markdown_blocks.rendering_scores(spark.createDataFrame(rows, "id int, e string, p string"), "id", "e", "p").collect()}
    assert found[1] == 100.0 and found[2] == 0.0 and found[3] == 100.0 and found[4] == 80.0 and 85 < found[5] < 99 and found[6] == 100.0 and found[7] == 20.0


def test_shared_length_equals_a_table():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert md.shared_length(a, b) == table[-1][-1]


def test_prompt_echo():
    assert md.drop_prompt_echo("<document>\ntext\n\n---\nRemember: keep all marks\n</document>", ("keep all marks",)) == "text"


def test_sections_are_taken_back(spark):
    mark = lambda k, body: f"<!-- Page number: {k} -->\n{body}\n"
    before = [(1, mark(1, "short words here") + mark(2, "![i](x.png)") + mark(3, "says something") + mark(4, "fine")), (2, mark(1, "a") + mark(2, "b")), (3, mark(1, "same"))]
    after = [(1, mark(1, "short words here and there") + mark(2, "![i](x.png)\ninvented text") + mark(3, "") + mark(4, "fine " * 80)), (2, mark(2, "b") + mark(1, "a")), (3, mark(1, "better"))]
    cut = lambda rows: sections.sections(spark.createDataFrame(rows, "d int, t string"), "d", "t")
    found = {(r["d"], r["section_id"]): r["taken_back"] for r in sections.stabilised(cut(before), cut(after), "d").collect()}
    assert found == {(1, "page:1"): False, (1, "page:2"): True, (1, "page:3"): True, (1, "page:4"): True, (2, "page:1"): True, (2, "page:2"): True, (3, "page:1"): False}
