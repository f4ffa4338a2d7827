"""Texts that lost their end: cut at a fixed length, or in mid transfer, with or without a mark.

Each value gives two kinds of evidence. Its length: for every source a log-normal length distribution, right-censored at
its candidate limits, is fitted by maximum likelihood over the counts of lengths. A cut value stands at a limit, or
anywhere before the end it would have had; so each length has a likelihood for cut values and one for whole ones, and
their ratio speaks for a cut or against it, for every value. Sources with few values lean on the fit over all. Its ending:
marks, open code, formulas, lists, tags and emphasis, the kind of the last line, and, where these leave doubt, corpus
counts of how often the same line stands elsewhere, how lines with the same first words end and whether the last word is
a word. Both are log likelihood ratios and are added; neither decides alone.

Defined cases: null, empty and blank values are complete; a complete value without a final stop (a heading, list item,
byline, menu line, title, list of parts that ends in the site's name) is no case; a text may be its own only line;
repeated rows are judged each; rows without a source get the length evidence of their strategy or of all values; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.web import source_key
from ..plans.shared import materialise
from ..sources.tables import table
from .blocks import CODE_FORMS, INLINE_CODE, Block, scan, visible
from .main_content import _BYLINE, _END, _MARKED, _teaser, site_name, tokens
from .residue import MESSAGES, words as plain_words

#: The Poisson log likelihood ratio against chance from which a length with many open ends is a candidate limit.
SPIKE_EVIDENCE = 12.0
#: Log odds that a value is cut before any evidence.
PRIOR = -2.0
#: Values that the fit over all sources weighs in the fit of one.
POOLED = 20.0
#: Bounds of the evidence of a length, and of that of a length which is no limit.
LEAST_LENGTH, MOST_LENGTH, MOST_ANYWHERE = -5.0, 8.0, 2.0
#: Evidence of endings that say something by themselves, by kind: signs of a cut, then of a whole value.
ENDING = {
    "mark": 7.0, "code open": 6.0, "formula open": 6.0, "open": 5.0, "underline open": 5.0, "title open": 5.0,
    "blank": -8.0, "code": -5.0, "formula": -5.0, "heading": -5.0, "rule": -4.0, "container": -4.0, "stop": -5.0, "item": -4.0, "byline": -4.5, "message": -5.0, "closed": -4.5, "teaser": -4.5, "sign": -4.0, "title": -6.0, "site": -6.0, "loading": -3.0,
}

_MARK = re.compile(r"\s*(?:\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|…|(?<!\.)\.\.\.|\[(?:truncated|cut|continued|more)\]|\((?:truncated|cut|continued|more)\)|(?<=\S) +(?:Read more|Continue reading|Show more|Weiterlesen|Mehr lesen|Lire la suite|Leer más|Seguir leyendo|Читать далее)|\ufffd+)\s*$", re.IGNORECASE)
_OPENERS = re.compile(r"<(ul|ol|blockquote|pre|code|a|b|em|i|strong|span|h[1-6]|div|aside|nav|footer|sup|math|script|table|tr|td)\b[^<>]*>", re.IGNORECASE)
_CLOSERS = re.compile(r"</(ul|ol|blockquote|pre|code|a|b|em|i|strong|span|h[1-6]|div|aside|nav|footer|sup|math|script|table|tr|td)\s*>", re.IGNORECASE)
_BEGIN, _FINISH = re.compile(r"\\begin\{(\w+)\*?\}"), re.compile(r"\\end\{(\w+)\*?\}")
_OPEN_TAG = re.compile(r"<[a-zA-Z/!][^<>]*$|&[a-zA-Z#]\w{0,7}$|<$")
_OPEN_LINK = re.compile(r"\[[^\[\]]*\]\([^()]*$|\[https?://[^\]]*$|\[\[[^\[\]]*$|(?<![\w\]])\[[^\[\]]{1,80}$")
_OPEN_COMMAND = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{[^{}]*$|\\[a-zA-Z]*$|\\href\{[^{}]*\}(?:\{[^{}]*)?$")
_SEVERAL = re.compile(r"[.!?]\s+\S")
_LAST_WORD = re.compile(r"([^\W\d_]+)$")
_ITEM_FORMS = frozenset(("bullet", "numbered", "htmlitem", "wikistars", "wikihash", "texitem"))
_HEADING_FORMS = frozenset(("hash1", "hash2", "htmlheading", "wikiheading", "texheading"))

#: Signs that may follow a whole line.
_ORNAMENT = re.compile(r"\s+[→←↑—–]+\s*$|^[—–]\s+(?=\S+ \S+ \S)")
_TRAILING = re.compile(r"\s[→←↑—–]+\s*$")
#: Words of one letter, in the languages that have them.
_LETTER_WORDS = "a", "i", "y", "o", "e", "à", "ù", "и", "в", "с", "к", "о", "у", "я", "а"

#: Kinds of endings that leave doubt.
DOUBTFUL = ("sentence", "item last", "heading last", "year", "long", "text", "parts")


def start_key(line: str) -> str:
    """The first two words in lower case, figures as 0."""
    return re.sub(r"\d+", "0", " ".join(line.lower().split()[:2]))


#: Blanks from which a line without a stop is longer than titles and menu lines are.
LONG_TITLE = 9
#: A line that ends in a year reads as a title or a date more often than as a cut sentence.
_YEAR = re.compile(r"\b(?:1[89]|20)\d\d$")
#: Messages that stand in place of a page, by their longest word: their words, and how many others a name may add.
_MESSAGE_WORDS: dict[str, list[tuple[frozenset[str], int]]] = {}
for _message in MESSAGES:
    _bag = frozenset(plain_words(_message))
    _MESSAGE_WORDS.setdefault(max(_bag - {"x"}, key=lambda w: (len(w), w)), []).append((_bag - {"x"}, 3 * ("x" in _bag)))


def is_message(seen: str) -> bool:
    """Whether a line is one of the messages that stand in place of a page, names in it aside."""
    bag = frozenset(plain_words(seen)) if len(seen) < 200 else frozenset()
    return any(m <= bag and len(bag) - len(m) <= free for w in bag & _MESSAGE_WORDS.keys() for m, free in _MESSAGE_WORDS[w])


class Ending(NamedTuple):
    """How a value ends: the kind; whether with a mark; of a doubtful end the first words, the last word and the letters of
    the last line."""

    kind: str
    mark: bool = False
    start: str = ""
    word: str = ""
    letters: str = ""


def ending(text: str, site: str) -> Ending:
    bare = text.rstrip()
    found = _MARK.search(bare)
    body = bare[: found.start()] if found else bare
    mark = found is not None
    if not body.strip():
        return Ending("blank")
    blocks = scan(body)
    form, start, _, inner = blocks[-1]
    line = body.rsplit("\n", 1)[-1]
    if form in CODE_FORMS:
        last = line.strip()
        closed = last[:3] in ("```", "~~~") and len(set(last)) == 1 and body.count("\n") > start if form == "fence" else bool(re.search(r"</\w+>\s*$|\\end\{\w+\*?\}\s*$", last))
        return Ending("code open" if mark or not closed else "code", mark)
    if form == "display":
        closed = bool(re.search(r"\\\]\s*(?:</\w+>)?\s*$|\\end\{\w+\*?\}\s*$|</\w+>\s*$", line)) or (inner.lstrip().startswith("$$") and inner.count("$$") == 2)
        return Ending("formula open" if mark or not closed else "formula", mark)
    shown = visible(line) if _MARKED.search(line) else line.strip()
    seen = _ORNAMENT.sub("", shown)
    if mark:
        # a teaser and a loading message end in dots when whole
        dots = found.group().strip() in ("…", "...") and not _SEVERAL.search(seen)
        return Ending("teaser" if dots and _teaser(seen, False) else "loading" if dots and is_message(seen) else "mark", not (dots and (_teaser(seen, False) or is_message(seen))))
    if _open(blocks, body, line, form, bool(_END.search(seen))):
        return Ending("open")
    if form == "setext":
        title, under = body.rsplit("\n", 2)[-2:]
        return Ending("heading" if len(under.strip()) >= len(title.strip()) - 1 else "underline open")
    if form in ("rule", "container"):
        return Ending(form)
    if _END.search(seen):
        return Ending("stop")
    last = _LAST_WORD.search(seen)
    word = last.group(1).lower() if last else ""
    letters = "".join([c for c in seen.lower() if c.isalpha()])
    if is_message(seen):
        return Ending("message")
    if _TRAILING.search(shown):
        return Ending("sign")
    if form in _ITEM_FORMS or form in _HEADING_FORMS:
        kind = "item" if form in _ITEM_FORMS else "heading"
        return Ending(f"{kind} last", False, "", word, letters) if word else Ending(kind)
    if _BYLINE.match(seen) or re.match(r"[—–]\s*\S+ \S+$", seen):
        return Ending("byline")
    if re.match(r"\s*<(\w+)[^>]*>.*</\1>\s*$", line):
        return Ending("closed")
    if _teaser(seen, False) and not _SEVERAL.search(seen):
        return Ending("teaser")
    if re.search(r"[»”’)\]↑→←—*!]$", seen) and not _SEVERAL.search(seen):
        return Ending("sign")
    if form == "quote" or _SEVERAL.search(seen) or re.search(r"[,\-–(„“«]$", seen):
        return Ending("sentence", False, "", word, letters)
    return Ending("year" if _YEAR.search(seen) else "long" if seen.count(" ") >= LONG_TITLE else "text", False, start_key(seen), word, letters)


def _open(blocks: list[Block], body: str, line: str, form: str, stop: bool) -> bool:
    """Whether something that was opened is not closed: a tag, link, command, list or emphasis."""
    if "<" in body:
        if _OPEN_TAG.search(line):
            return True
        if form in ("container", "htmlitem"):
            marked = "\n".join(b.text for b in blocks if b.form not in CODE_FORMS).lower()
            if max(marked.rfind("<ul"), marked.rfind("<ol")) > max(marked.rfind("</ul"), marked.rfind("</ol")):
                return True
        opened: dict[str, int] = {}
        part = INLINE_CODE.sub("", line)
        if form not in ("container", "htmlitem"):
            for name in _OPENERS.findall(part):
                opened[name.lower()] = opened.get(name.lower(), 0) + 1
            for name in _CLOSERS.findall(part):
                opened[name.lower()] = opened.get(name.lower(), 0) - 1
        if line.startswith("<p>") and "</p>" not in line and all("</p>" in x for x in body.split("\n")[:-1] if x.startswith("<p>")):
            return not stop
        if any(n > 0 for n in opened.values()) or line.count("<ref") > line.count("</ref") + line.count("/>"):
            return True
    if "\\begin{" in body and form in ("texitem", "container", "paragraph"):
        part = "\n".join(b.text for b in blocks if b.form not in CODE_FORMS and b.form != "display")
        if len(_BEGIN.findall(part)) > len(_FINISH.findall(part)):
            return True
    if stop:
        return False
    line = INLINE_CODE.sub("", line.replace("``", ""))
    if _OPEN_LINK.search(line) or ("\\" in line and _OPEN_COMMAND.search(line)):
        return True
    if line.count("**") % 2 or "`" in line or line.count("'''") % 2 or len(re.findall(r"\$(?!\d)", line)) % 2 or line.count("{{") > line.count("}}"):
        return True
    return form == "paragraph" and line.startswith("==") and not line.rstrip().endswith("=")


ENDINGS = "field_name string, row_id long, source string, strategy string, chars int, kind string, mark boolean, start string, word string, letters string"


def endings(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """The ending of every content and description. ``chars`` is the length without a mark; ``source`` is the domain
    of the page, or of the description's row."""
    host = source_key(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1))
    contents = pages.where("content <> ''").select(F.lit("content").alias("field_name"), F.col("fetch_id").alias("row_id"), host.alias("source"), F.col("strategy_used").alias("strategy"), F.col("content").alias("value"), F.lit(None).cast("string").alias("title"))
    texts = metadata.where("description <> ''").select(F.lit("description").alias("field_name"), F.col("meta_id").alias("row_id"), source_key(F.col("domain")).alias("source"), F.lit(None).cast("string").alias("strategy"), F.col("description").alias("value"), "title")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites = batch.column("source").to_pylist()
            titles = batch.column("title").to_pylist()
            fields = batch.column("field_name").to_pylist()
            found, chars = [], []
            for field, site, title, value in zip(fields, sites, titles, batch.column("value")):
                text = value.as_py()
                site = site_name("//" + site if site else "")
                judged = ending(text, site)
                if field == "description":
                    judged = _described(text, title, site, judged)
                found.append(judged)
                mark = _MARK.search(text.rstrip()) if judged.mark else None
                chars.append(mark.start() if mark else len(text))
            columns = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("field_name"), batch.column("row_id"), batch.column("source"), batch.column("strategy"), pa.array(chars, pa.int32()), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string())))],
                names=["field_name", "row_id", "source", "strategy", "chars", "kind", "mark", "start", "word", "letters"],
            )

    return contents.unionByName(texts).mapInArrow(run, ENDINGS)


_PARTS = re.compile(r"\s+[|·•/–—-]\s+|,\s+|\s*;\s+")


def _described(text: str, title: str | None, site: str, judged: Ending) -> Ending:
    """A description may be the page's title, the title among others, or a list that ends in the name of the site."""
    if judged.mark or judged.kind in ("open", "code open", "formula open", "stop"):
        return judged
    own, name = " ".join(text.split()), " ".join((title or "").split())
    if name and own == name:
        return Ending("title")
    if name and len(own) < len(name) and name.startswith(own):
        return Ending("title" if re.match(r"\s*[|–—-] ", name[len(own) :]) else "title open")
    parts = _PARTS.split(own)
    last = parts[-1]
    if len(parts) > 1 and site and set(tokens("| | " + last, site)) == {"site", "|"}:
        return Ending("site")
    if " | " in own:
        last = own.rsplit(" | ", 1)[1]
        return Ending("stop") if _END.search(last) else Ending("parts", False, start_key(last), (_LAST_WORD.search(last) or [""])[0].lower(), "".join([c for c in own.lower() if c.isalpha()]))
    return judged


#: Lines and words of the corpus, for values that are in doubt.
_LINE_END = r"[.!?…:;][\"”»)\]*_`']*\s*(?:</\w+>)?\s*$"


def corpus_lines(pages: DataFrame) -> DataFrame:
    """(part, text, n_stop, n_bare): how the lines end that have the same first two words (part 2) or first word (1), how
    many lines end in a word (0), and how many have the same letters (3), over all contents."""
    lines = pages.select(F.explode(F.split("content", "\n", -1)).alias("line")).where("line <> ''")
    plain = lines.select(F.lower(F.regexp_replace("line", r"^\s*(?:<[^>]*>)+|</\w+>\s*$|[*`]+|'{2,}|^\s*[#=>+\-]+\s*", "")).alias("plain"), F.col("line").rlike(_LINE_END).alias("stop"))
    two = F.regexp_replace(F.regexp_replace(F.regexp_extract("plain", r"^\s*(\S+\s+\S+)", 1), r"\d+", "0"), r"\s+", " ")
    one = F.regexp_replace(F.regexp_extract("plain", r"^\s*(\S+)\s+\S", 1), r"\d+", "0")
    last = F.regexp_extract("plain", r"(\p{L}+)[^\p{L}]*$", 1)
    whole = F.when(~F.col("stop") & (F.char_length("plain") < LINE_CHARS), F.regexp_replace("plain", r"[^\p{L}]+", "")).otherwise("")
    kinds = F.array(*[F.struct(F.lit(part).alias("part"), text.alias("text")) for part, text in ((2, two), (1, one), (0, last), (3, whole))])
    return plain.select("stop", F.inline(kinds)).where("text <> ''").groupBy("part", "text").agg(F.sum(F.col("stop").cast("long")).alias("n_stop"), F.sum((~F.col("stop")).cast("long")).alias("n_bare"))


#: Longer lines are never asked for as a whole: an end in doubt is a line without a stop in it.
LINE_CHARS = 1000


def corpus_words(pages: DataFrame) -> DataFrame:
    """(word, n): in how many contents each word stands."""
    return pages.select(F.explode(F.array_distinct(F.split(F.lower("content"), r"[^\p{L}]+"))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


class Fit(NamedTuple):
    """A log-normal distribution of the lengths of whole values, and the share of cut values at each limit."""

    mean: float
    spread: float
    limits: dict[int, float]


def _beyond(z: np.ndarray | float) -> np.ndarray | float:
    return 0.5 * _erfc(z / math.sqrt(2))


_erfc = np.vectorize(math.erfc, otypes=[float])


def fit_lengths(lengths: np.ndarray, n: np.ndarray, ends: np.ndarray, pooled: Fit | None) -> Fit:
    """Maximum likelihood over ascending lengths with their counts ``n`` and open ends ``ends``, by expectation
    maximisation: open ends at a limit are known only to reach it. ``pooled`` counts as POOLED further values, and its
    limits are limits here too."""
    width, sums = np.maximum(20, lengths // 10), np.concatenate([[0.0], np.cumsum(n)])
    around = sums[np.searchsorted(lengths, lengths + width, "right")] - sums[np.searchsorted(lengths, lengths - width, "left")] - n
    expected = np.maximum(around / (2 * width), 0.01)
    evidence = ends * np.log(np.maximum(ends, 1) / expected) - (ends - expected)
    limit = (ends >= 0.5 * n) & (evidence >= SPIKE_EVIDENCE)
    if pooled is not None:
        limit |= np.isin(lengths, list(pooled.limits)) & (ends > 0)
    cut, whole, logs = np.where(limit, ends, 0.0), np.where(limit, n - ends, n), np.log(np.maximum(lengths, 1))
    extra, mean, spread = (0.0, 0.0, 1.0) if pooled is None else (POOLED, pooled.mean, pooled.spread)
    total = n.sum() + extra
    if pooled is None:
        mean = float(np.average(logs, weights=n))
        spread = max(0.2, float(np.sqrt(np.average((logs - mean) ** 2, weights=n))))
    at = np.flatnonzero(cut)
    for _ in range(30):
        z = (logs[at] - mean) / spread
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / np.maximum(_beyond(z), 1e-12)
        first, second = mean + spread * hazard, mean * mean + spread * spread + spread * hazard * (logs[at] + mean)
        base, square = (0.0, 0.0) if pooled is None else (pooled.mean, pooled.mean**2 + pooled.spread**2)
        one = (whole @ logs + cut[at] @ first + extra * base) / total
        two = (whole @ logs**2 + cut[at] @ second + extra * square) / total
        mean, spread = float(one), max(0.2, math.sqrt(max(float(two) - float(one) ** 2, 1e-4)))
    shares = dict(pooled.limits) if pooled is not None else {}
    weight = POOLED if pooled is not None else 1.0
    open_ends = ends.sum() + weight
    shares = {length: share * weight / open_ends for length, share in shares.items()}
    for k in at:
        shares[int(lengths[k])] = shares.get(int(lengths[k]), 0.0) + cut[k] / open_ends
    return Fit(mean, spread, shares)


def length_evidence(fit: Fit, lengths: np.ndarray) -> np.ndarray:
    """The log likelihood ratio of a cut against a whole value of each length. A cut that is at no limit may be anywhere
    before the end: the density of such lengths is that of whole ones over their length, from this one on."""
    logs = np.log(np.maximum(lengths, 1))
    z = (logs - fit.mean) / fit.spread
    whole = np.exp(-0.5 * z * z) / (fit.spread * np.maximum(lengths, 1) * math.sqrt(2 * math.pi))
    anywhere = math.exp(-fit.mean + fit.spread**2 / 2) * _beyond(z + fit.spread)
    at = np.array([fit.limits.get(int(x), 0.0) for x in lengths])
    # neither tail of the fit is trusted further than this
    cut = (1 - min(sum(fit.limits.values()), 0.95)) * np.clip(anywhere, math.exp(-MOST_ANYWHERE) * whole, math.exp(MOST_ANYWHERE) * whole) + at
    return np.clip(np.log(np.maximum(cut, 1e-12) / np.maximum(whole, 1e-12)), LEAST_LENGTH, MOST_LENGTH)


LENGTHS = "field_name string, scope string, source string, chars int, llr double"


def _counts(counts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = counts.sort_values("chars")
    return counts["chars"].to_numpy(), counts["n"].to_numpy(float), counts["n_open"].to_numpy(float)


def lengths(judged: DataFrame) -> DataFrame:
    """(field_name, scope, source, chars, llr) of every length of every domain, every strategy and all values. A source's
    lengths come as counts, so a source with any share of the rows is one small group; the fit over all is two rows."""
    judged = materialise(
        judged.where("not mark").select("field_name", "source", "strategy", "chars", F.col("kind").isin("open", "code open", "formula open", "title open", *DOUBTFUL).alias("open")), "ends"
    )
    scopes = [judged.select("field_name", F.lit(scope).alias("scope"), F.coalesce(F.col(name), F.lit("")).alias("source"), "chars", "open").where((F.lit(scope) == "all") | F.col(name).isNotNull()) for scope, name in (("domain", "source"), ("strategy", "strategy"))]
    both = scopes[0].unionByName(scopes[1]).unionByName(judged.select("field_name", F.lit("all").alias("scope"), F.lit("").alias("source"), "chars", "open"))
    counts = materialise(both.groupBy("field_name", "scope", "source", "chars").agg(F.count("*").alias("n"), F.sum(F.col("open").cast("long")).alias("n_open")), "length-counts")

    def fit_all(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fit = fit_lengths(*_counts(group), None)
        return pd.DataFrame({"field_name": [str(key[0])], "mean": [fit.mean], "spread": [fit.spread], "limits": [list(fit.limits)], "shares": [list(fit.limits.values())]})

    rows = counts.where("scope = 'all'").groupBy("field_name").applyInPandas(fit_all, "field_name string, mean double, spread double, limits array<long>, shares array<double>").collect()  # one a field
    pooled = {r["field_name"]: Fit(r["mean"], r["spread"], dict(zip(r["limits"], r["shares"]))) for r in rows}

    def fit_one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own, over_all = _counts(group), pooled[str(key[0])]
        fit = over_all if key[1] == "all" else fit_lengths(*own, over_all)
        return pd.DataFrame({"field_name": str(key[0]), "scope": str(key[1]), "source": str(key[2]), "chars": own[0], "llr": length_evidence(fit, own[0])})

    return counts.groupBy("field_name", "scope", "source").applyInPandas(fit_one, LENGTHS)


def cut_values(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """(field_name, row_id, source, strategy, by_ending, by_length, log_odds) of every value: the two kinds of evidence, and
    the log odds that it was cut."""
    judged = materialise(endings(pages, metadata), "endings")
    known = materialise(lengths(judged), "lengths")
    of = lambda scope, names: known.where(F.col("scope") == scope).select("field_name", *names, "chars", F.col("llr").alias(f"{scope}_llr"))
    doubtful = judged.where(F.col("kind").isin(*DOUBTFUL)).select("field_name", "row_id", "kind", "word", "letters", F.col("start").alias("two"), F.split("start", " ")[0].alias("one"))
    contents = pages.where("content <> ''").select("content")
    asked = doubtful.select(F.inline(F.array(*[F.struct(F.lit(part).alias("part"), F.col(name).alias("text")) for part, name in ((2, "two"), (1, "one"), (0, "word"), (3, "letters"))]))).where("text <> ''").distinct()
    lines = materialise(corpus_lines(contents).join(asked, ["part", "text"], "left_semi"), "line-ends")
    words = corpus_words(contents).join(doubtful.select("word").where("word <> ''").distinct(), "word", "left_semi")
    weighed = doubtful
    for part, name in ((2, "two"), (1, "one"), (0, "word"), (3, "letters")):
        weighed = _with_counts(weighed, lines.where(F.col("part") == part).select(F.col("text").alias(name), F.col("n_stop").alias(f"{name}_stop"), F.col("n_bare").alias(f"{name}_bare")), name)
    weighed = _with_counts(weighed, words, "word").select(F.col("field_name").alias("f"), F.col("row_id").alias("r"), _doubt(judged.where("field_name = 'content'").count()).alias("doubt")).distinct()
    joined = judged.join(of("domain", ["source"]), ["field_name", "source", "chars"], "left").join(of("strategy", [F.col("source").alias("strategy")]), ["field_name", "strategy", "chars"], "left").join(of("all", []), ["field_name", "chars"], "left")
    joined = joined.join(weighed, (F.col("row_id") == F.col("r")) & (F.col("field_name") == F.col("f")), "left")
    table_of = F.create_map(*[F.lit(x) for pair in ENDING.items() for x in pair])
    by_ending = F.coalesce(F.element_at(table_of, F.col("kind")), F.col("doubt"), F.lit(0.0))
    # a mark takes the place of a length: what the limit was before it is not known
    by_length = F.when(F.col("mark"), 0.0).otherwise(F.coalesce(F.greatest("domain_llr", "strategy_llr"), F.col("all_llr"), F.lit(0.0)))
    return joined.select("field_name", "row_id", "source", "strategy", by_ending.alias("by_ending"), by_length.alias("by_length"), (F.lit(PRIOR) + by_ending + by_length).alias("log_odds"))


def _with_counts(rows: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """A left join by ``name``; rows without it, which may be many, stay out of the join."""
    lacking = rows.where(F.col(name) == "")
    for column in counts.columns:
        if column != name:
            lacking = lacking.withColumn(column, F.lit(None).cast("long"))
    return rows.where(F.col(name) != "").join(counts, name, "left").unionByName(lacking)


def _doubt(contents: int) -> F.Column:
    """Evidence of values in doubt: the same line stands elsewhere; the last word is no word of the corpus, or hardly ever
    ends a line; lines that begin alike end in a stop. The value's own line does not count."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = zero("n")
    letter = (F.char_length("word") == 1) & ~F.col("word").isin(*_LETTER_WORDS)
    broken = F.when(F.col("word") == "", 0.0).when(letter | (n <= max(1.0, 1e-4 * contents)), 4.5).when(n <= max(3.0, 4e-4 * contents), 1.0).otherwise(-1.5)
    rare = (F.col("word") == "") | (n <= max(3.0, 1e-4 * contents))
    rate = (F.greatest(zero("word_bare") - 1, F.lit(0)) + 0.3) / (n + 3)
    final = F.when(rare, 0.0).otherwise(F.least(F.greatest(F.log(0.03 / rate), F.lit(-1.5)), F.lit(4.5)))
    # words that nearly always stand at the end of a line
    closing = F.when(~rare & (zero("word_bare") + zero("word_stop") - 1 > 0.5 * n), -4.0).otherwise(0.0)
    seen = zero("two_stop") + zero("two_bare") >= 6
    stop, bare = F.when(seen, zero("two_stop")).otherwise(zero("one_stop")), F.when(seen, zero("two_bare")).otherwise(zero("one_bare"))
    alike = F.log((stop + 0.5) / (F.greatest(bare - 1, F.lit(0)) + 0.5))
    begun = F.when(F.col("kind").isin("text", "long", "year", "parts"), F.least(F.greatest(alike * 1.5, F.lit(-4.5)), F.lit(5.5))).otherwise(-1.0)
    # a page that was fetched again has the same end, cut or not
    elsewhere = F.when(zero("letters_bare") > 4, -5.0).when(zero("letters_bare") > 2, -1.0).otherwise(0.0)
    return elsewhere + closing + F.when(F.col("kind") == "sentence", F.greatest(broken, F.lit(0.0)) + 4.0).otherwise(broken + final + begun) + F.when(F.col("kind") == "year", -4.0).when(F.col("kind") == "long", 2.5).otherwise(0.0)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return cut_values(table(spark, folder, "fetch_cache"), table(spark, folder, "web_metadata")).where("log_odds > 0").select("field_name", "row_id")


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """For each domain, and each strategy_used, the values of each field and the share of them that was cut."""
    values = materialise(cut_values(table(spark, folder, "fetch_cache"), table(spark, folder, "web_metadata")), "cut-values")
    both = values.select("field_name", F.lit("domain").alias("scope"), "source", "log_odds").unionByName(values.where("strategy is not null").select("field_name", F.lit("strategy").alias("scope"), F.col("strategy").alias("source"), "log_odds"))
    cut = F.sum(F.when(F.col("log_odds") > 0, 1).otherwise(0))
    return both.groupBy("field_name", "scope", "source").agg(F.count("*").alias("n_values"), cut.alias("n_cut"), F.round(cut / F.count("*"), 6).alias("cut_share"))
