"""One consistent form of texts that look alike though their characters differ.

A token is a run of letters and marks. The script sets of its characters are intersected: an empty intersection is a
mixed-script token, and one whose letters all have a look-alike in another script is a whole-script confusable. A
mixed token is spelled in the script to which all its other letters can be mapped; a whole-script confusable takes the
script that leads in the tokens of its text that can be of one script only. Full-width forms, ligatures, no-break
spaces, invisible characters and the order and composition of accents are then brought to one form.

What a reader can see is kept: accents, case, superscripts, styled letters, emoji sequences and their variation
selectors, word order, number of blanks.

Defined cases: a null text has a null form, an empty or blank text its own, and none of these has pairs; equal texts
are no pair, but each of their rows takes part in the pairs with other texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialise
from ..sources.tables import table

#: Letters of Cyrillic, Greek and Armenian whose usual shape is that of a Latin letter.
TO_LATIN = {
    "Cyrl": dict(zip("аеорсухѕіјһԁԛԝӏАВЕКМНОРСТХЅІЈԚԜҮҺԌ", "aeopcyxsijhdqwlABEKMHOPCTXSIJQWYhG")),
    "Grek": dict(zip("ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovcjABEZHIKMNOPTYXCJ")),
    "Armn": dict(zip("օհՕՍ", "ohOU")),
}
TO_LATIN["Cyrl"].pop("Һ", None)
FROM_LATIN = {script: {latin: own for own, latin in pairs.items()} for script, pairs in TO_LATIN.items()}
#: Characters that leave no trace in the line.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‎‏⁠⁡⁢⁣⁤﻿"
NO_BREAK = {" ": " ", " ": " ", " ": " ", "　": " ", "‐": "-", "‑": "-"}
_DROP = regex.compile(f"[{INVISIBLE}]+")
#: Joiners have an effect only between emoji and in scripts that join their letters.
_JOINING = r"[\p{Arab}\p{Syrc}\p{Nkoo}\p{Mong}\p{Deva}\p{Beng}\p{Guru}\p{Gujr}\p{Orya}\p{Taml}\p{Telu}\p{Knda}\p{Mlym}\p{Sinh}\p{Khmr}\p{Mymr}]"
_JOINER = regex.compile(rf"(?<!{_JOINING}\p{{M}}*)‌|‌(?!{_JOINING})|(?<!(?:{_JOINING}|\p{{Extended_Pictographic}}|\p{{EMod}})[\p{{M}}️]*)‍|‍(?!{_JOINING}|\p{{Extended_Pictographic}})")
_SELECTOR = regex.compile(r"(?<![\p{Extended_Pictographic}0-9#*])[︀-️]+")
_ENDS = regex.compile(r"\r\n?|[ \u0085]")
_TRAIL = regex.compile(r"[ \t]+(?=\n)|[ \t\n]+\Z")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_OTHER = regex.compile(r"[^\x00-\x7f]")
#: Texts of Latin letters, usual marks and emoji alone are their own form, as soon as they are composed.
_PLAIN = regex.compile(r"[\n -~\t\u00a1-\u00ac\u00ae-\u024f\u2012-\u2026\u2030-\u205e\u3001-\u3098\u309b-\u9fff\uac00-\ud7a3\U0001f000-\U0001f3fa\U0001f400-\U0001faff]*")


@lru_cache(maxsize=65536)
def _fold(char: str) -> str:
    """Full-width and half-width forms, ligatures and Roman numerals as their usual characters."""
    if char in NO_BREAK:
        return NO_BREAK[char]
    shape = unicodedata.decomposition(char)
    code = ord(char)
    if shape.startswith(("<wide>", "<narrow>")) or (shape.startswith("<compat>") and (0xFB00 <= code <= 0xFB17 or 0x2160 <= code <= 0x217F or 0x01C4 <= code <= 0x01CC)):
        return unicodedata.normalize("NFKC", char)
    return char


@lru_cache(maxsize=65536)
def _scripts(char: str) -> frozenset[str]:
    """The scripts a letter can be read as belonging to; empty for marks and characters of all scripts."""
    for script, known in (("Latn", r"\p{Latn}"), ("Cyrl", r"\p{Cyrl}"), ("Grek", r"\p{Grek}"), ("Armn", r"\p{Armn}")):
        if regex.match(known, char):
            return frozenset((script,))
    return frozenset()


@lru_cache(maxsize=65536)
def _readable(char: str) -> frozenset[str]:
    """The scripts in which a letter has this shape."""
    own = _scripts(char)
    if not own:
        return own
    latin = char if "Latn" in own else next((pairs[char] for pairs in TO_LATIN.values() if char in pairs), None)
    if latin is None:
        return own
    return own | {"Latn"} | {script for script, pairs in FROM_LATIN.items() if latin in pairs}


@lru_cache(maxsize=65536)
def _spell(char: str, script: str) -> str:
    own = _scripts(char)
    if not own or script in own:
        return char
    latin = char if "Latn" in own else next((pairs[char] for pairs in TO_LATIN.values() if char in pairs), None)
    if latin is None:
        return char
    return latin if script == "Latn" else FROM_LATIN[script].get(latin, char)


@lru_cache(maxsize=200_000)
def _options(token: str) -> frozenset[str]:
    """The scripts in which the whole token can be spelled with its present shape."""
    options = None
    for char in token:
        if readable := _readable(char):
            options = readable if options is None else options & readable
    return options or frozenset()


@lru_cache(maxsize=200_000)
def _respell(token: str, script: str) -> str:
    return "".join(_spell(c, script) for c in token)


def consistent_form(text: str | None) -> str | None:
    """The form in which texts that look alike are equal and texts that look different stay different."""
    if text is None or (text.isascii() and "\r" not in text):
        return text if text is None else _TRAIL.sub("", text)
    text = _TRAIL.sub("", _ENDS.sub("\n", text))
    if _PLAIN.fullmatch(text):
        return text
    text = "".join([c if c < "\x80" else _fold(c) for c in text])
    text = _SELECTOR.sub("", _JOINER.sub("", _DROP.sub("", text)))
    text = _TRAIL.sub("", unicodedata.normalize("NFD", text))
    tokens = _TOKEN.findall(text)
    leading: dict[str, int] = {}
    ambiguous = False
    for token in tokens:
        options = _options(token)
        if len(options) == 1:
            script = next(iter(options))
            leading[script] = leading.get(script, 0) + len(token)
        elif options:
            ambiguous = True
    foreign = set(leading) - {"Latn"}
    if not foreign and not ambiguous and not leading:
        return unicodedata.normalize("NFC", text)
    lead = max(sorted(leading), key=leading.get) if leading else "Latn"

    def settle(found: regex.Match) -> str:
        token = found.group()
        options = _options(token)
        if len(options) == 1:
            return _respell(token, next(iter(options)))
        if options:
            return _respell(token, lead if lead in options else "Latn")
        return _respell(token, "Latn")

    return unicodedata.normalize("NFC", _TOKEN.sub(settle, text))


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def forms(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, form): the consistent form of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([consistent_form(t.as_py()) for t in batch.column(1)], pa.string())], names=[id_column, "form"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, form string")


def form_keys(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, form_key, text_key): 128-bit keys of the form and of the text itself, of texts that are not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form_keys, text_keys = [], []
            for value in batch.column(1):
                text = value.as_py()
                form = consistent_form(text) if text and not text.isspace() else None
                if not form:
                    form_keys.append(None)
                    text_keys.append(None)
                    continue
                text_keys.append(_key(text))
                form_keys.append(text_keys[-1] if form == text else _key(form))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form_keys, pa.binary()), pa.array(text_keys, pa.binary())], names=[id_column, "form_key", "text_key"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, form_key binary, text_key binary").where("form_key is not null")


def lookalike_pairs(keys: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_a, doc_b) of all documents with equal form and different text. Pairs are first made between the distinct
    texts of a form, so only pairs of the result are ever made, and exact copies are never paired with each other."""
    texts = keys.select("form_key", "text_key").distinct()
    mixed = texts.groupBy("form_key").agg(F.count("*").alias("n")).where("n > 1").select("form_key")
    variants = texts.join(mixed, "form_key", "left_semi")
    left, right = variants.select("form_key", F.col("text_key").alias("text_a")), variants.select("form_key", F.col("text_key").alias("text_b"))
    pairs = left.join(right, "form_key").where("text_a < text_b").select("text_a", "text_b")
    one = keys.join(mixed, "form_key", "left_semi").select(F.col("text_key"), F.col(id_column).alias("doc"))
    joined = pairs.join(one.select(F.col("text_key").alias("text_a"), F.col("doc").alias("x")), "text_a").join(one.select(F.col("text_key").alias("text_b"), F.col("doc").alias("y")), "text_b")
    return joined.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(materialise(form_keys(table(spark, folder, "documents")), "form-keys"))


def p10_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every text."""
    return forms(table(spark, folder, "documents"))
