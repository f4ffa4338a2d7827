import random
from collections import Counter

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import packing, tokens


@pytest.fixture(scope="module")
def coder():
    return tokens.encoder(tokens.VOCABULARY)


@pytest.fixture(scope="module")
def public(coder):
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200) | st.text(alphabet="abcdeT '\n\t01#é日", max_size=80))
def test_ids_equal_the_public_tokenizer(coder, public, text):
    if text and not any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        assert coder.encode_texts([text])[0] == public.encode_ordinary(text)


def test_odd_texts(coder, public):
    texts = ["", None, "a" * 5000, "the" * 4000, "<|endoftext|>", " \n \n  ", "中文" * 500, "x" + " " * 3000]
    for text, ids in zip(texts, coder.encode_texts(texts)):
        assert ids == (public.encode_ordinary(text) if text else [])


def test_exact_merging_of_words(coder, public):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert [list(x) for x in coder.encode_words(words)] == [public.encode_ordinary(w) for w in words]


def test_memory_may_be_emptied(monkeypatch):
    small = tokens.WordEncoder(tokens.VOCABULARY)
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 3)
    texts = ["one two three four five", "six seven", "one two eight"] * 3
    assert small.encode_texts(texts) == [x for t in texts for x in small.encode_texts([t])]


def _check(histogram, capacity):
    runs, used = packing.plan_containers(histogram, capacity)
    fill, seen = Counter(), Counter()
    for run, after in zip(runs, [*runs[1:], None]):
        upto = after.rank if after is not None and after.length == run.length else histogram[run.length]
        for rank in range(run.rank, upto):
            fill[run.container + (rank - run.rank) // run.per] += run.length
            seen[run.length] += 1
    assert seen == Counter({k: v for k, v in histogram.items() if k > 0 and v > 0})
    assert all(v <= capacity for v in fill.values()) and len(fill) == used
    return used


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plans_fit_and_place_every_item(histogram):
    used = _check(histogram, 40)
    total = sum(k * v for k, v in histogram.items())
    assert used >= -(-total // 40)
    spaces: list[int] = []
    for size in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        fits = [s for s in spaces if s >= size]
        if fits:
            spaces.remove(min(fits))
            spaces.append(min(fits) - size)
        else:
            spaces.append(40 - size)
    assert used <= len(spaces)  # never worse than best-fit decreasing of single items


def test_only_long_texts_are_divided(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([0, 0, 5, 5, 16, 17, 40, 3, 3, 3])], "item_id long, n_tokens long")
    targets = spark.createDataFrame([("t", 16), ("t", 16), (None, 4), ("zero", 0)], "target_name string, capacity_tokens int")
    rows = packing.pack(counts, targets).collect()
    assert Counter(r["item_id"] for r in rows) == Counter({0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 3, 7: 1, 8: 1, 9: 1})
    fill = Counter()
    for r in rows:
        fill[r["container_id"]] += r["n_tokens"]
    assert max(fill.values()) <= 16 and sum(fill.values()) == 92 and len(fill) == 6
    assert {(r["piece_no"], r["token_start"], r["n_tokens"]) for r in rows if r["item_id"] == 6} == {(0, 0, 16), (1, 16, 16), (2, 32, 8)}
    assert packing.pack(counts, targets.where("target_name = 'none'")).count() == 0


def test_one_length_may_hold_every_item(spark):
    counts = spark.range(3000).selectExpr("id as item_id", "4L as n_tokens")
    rows = packing.pack(counts, spark.createDataFrame([("t", 10)], "target_name string, capacity_tokens int")).collect()
    fill = Counter(r["container_id"] for r in rows)
    assert len(rows) == 3000 and set(fill.values()) == {2} and len(fill) == 1500
