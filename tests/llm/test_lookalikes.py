import pytest

from foliospark.llm.lookalikes import consistent_form, form_keys, lookalike_pairs

SAME = [
    ("paypal", "раураl"), ("Ｆｕｌｌ　width！", "Full width!"), ("café", "cafe\u0301"), ("a\u00a0b", "a b"), ("zero\u200bwidth", "zerowidth"), ("\ufeffstart", "start"), ("soft\u00adhyphen", "softhyphen"), ("ﬁne ﬂow", "fine flow"), ("\u212aelvin", "Kelvin"),
    ("новый дом", "нoвый дoм"), ("в\u2060 доме", "в доме"), ("й", "и\u0306"), ("Αs long", "As long"), ("line\r\nend", "line\nend"), ("trail  \nx", "trail\nx"), ("がある", "か\u3099ある"), ("\u200eleft", "left"), ("А в доме", "A в доме"),
]
DIFFERENT = [
    ("a2", "a²"), ("cafe", "café"), ("Word", "word"), ("one two", "two one"), ("l0", "lO"), ("👩\u200d💻", "👩💻"), ("⚠\ufe0f", "⚠"), ("a  b", "a b"), ("n", "ñ"), ("rn", "m"), ("1", "l"), ("нет", "нёт"), ("a–b", "a-b"), ("“a”", '"a"'), ("x\ty", "x y"), ("می\u200cخواهم", "میخواهم"),
]


@pytest.mark.parametrize("one, two", SAME)
def test_look_alike(one, two):
    assert consistent_form(one) == consistent_form(two)


@pytest.mark.parametrize("one, two", DIFFERENT)
def test_look_different(one, two):
    assert consistent_form(one) != consistent_form(two)


@pytest.mark.parametrize("text", [x for pair in SAME + DIFFERENT for x in pair] + ["", None, " ", "x" * 5000, "Смешанный mixed text"])
def test_forms_are_fixed_points(text):
    form = consistent_form(text)
    assert consistent_form(form) == form


def test_pairs_equal_brute_force(spark):
    texts = ["abc", "аbс", "abc", "ａｂｃ", "abd", None, "", " ", "\u200b", "a²", "a2", "ab\u200bc"]
    rows = [(k, t) for k, t in enumerate(texts)]
    found = {(r["doc_a"], r["doc_b"]) for r in lookalike_pairs(form_keys(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    wanted = {(i, j) for i, a in rows for j, b in rows if i < j and a and b and a != b and consistent_form(a) and consistent_form(a) == consistent_form(b) and not a.isspace()}
    assert found == wanted and (0, 2) not in found and (0, 1) in found
