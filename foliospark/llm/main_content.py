"""A page's own text, told from what its site puts around and between it.

Each value is a tree: the page, its regions (the text before, between and after its long paragraphs, and these), their
blocks (elements of HTML, lines without a blank one between them) and the lines. Parent-child potentials join the levels;
messages pass upward from the lines and back down (sum-product, exact on a tree) and give each line's marginal. A line's own
evidence is a maximum-entropy model over its marks, the lines beside it, the record's title and what the corpus knows of
it. Evidence and potentials are trained on labelled pages.

What the corpus knows: no words of any site are built in. A first tree, without words, judges every line of the corpus by
marks and places. Over all records it is then counted how often the same line, the same parts of a row, the same first and
last words were own text by that judgement: a menu line is met in menus and behind the last paragraph, a heading before
paragraphs. The second tree judges with these counts, a record's own words taken out of them first. Every key that two
records have counts, however large the corpus is: records are read in parts of bounded size, totals of keys are brought to
the parts that have them by shuffles, and each part is judged with the totals of its own keys only.

Defined cases: null, empty and blank values have no lines; lines without visible text are no cases; a message in place
of a page is own text; repeated rows get their lines each; very long lines are one node; an empty table gives an empty
result.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as _hash

from ..plans.shared import materialise
from ..sources.tables import table
from .blocks import CODE_FORMS, scan, visible
from .labelled_pages import pages as labelled_pages

FIELDS = ("content", "static_content", "browser_content")
#: Characters from which one sentence is a paragraph; two are always one.
PARAGRAPH = 110
#: Log odds from which a line is own text: a little more than even, since a line left in harms more than one left out.
OWN_FROM = 0.25
#: How many occurrences the prior weighs against the counts of a key.
PRIOR_COUNT = 2.0
#: The same for first words against their shorter ones.
SMOOTH = 4.0
#: Log odds of a key's counts below which a line is taken for one around the page when the lines beside it are judged.
AROUND_BELOW = -1.5

_WORD = re.compile(r"[^\W\d_]+|\d+|[©↑→←»|·/…:]")
_LETTER = re.compile(r"[^\W_]")
_TAG_NAME = re.compile(r"\s*<([a-zA-Z][a-zA-Z0-9]*)")
_RELATIVE_LINK = re.compile(r"\s*(?:[-*+]\s+)?\*{0,2}\[[^\[\]]+\]\(/[^)]*\)\*{0,2}\s*$|.*<a href=\"/[^t\"][^\"]*\">[^<]*</a>\s*(?:</\w+>)?\s*$|.*<a href=\"/\">[^<]*</a>\s*(?:</\w+>)?\s*$")
_BOLD = re.compile(r"\s*\*\*[^*]+\*\*\s*$|\s*'''[^']+'''\s*$|\s*\\textbf\{[^{}]*\}\s*$")
_SIGNATURE = re.compile(r"[—–]\s*(?:[A-ZÀ-ÞА-Я][\w'’\-]+[ .]+){1,3}[A-ZÀ-ÞА-Я][\w'’\-]+\s*$")
_QUOTED = re.compile(r"\s*[“„«\"].*[”“»\"]\s*$")
_LIST_LINE = re.compile(r"\s*[^;.\s]+(?: [^;.\s]+){0,4}(?:; [^;.\s]+(?: [^;.\s]+){0,4})+\.?\s*$")
_FORMULA_LINE = re.compile(r"\s*(?:\$\$|\\\[|\\begin\{|<math|<script|<span class=\"math)|\s*\w = \d+ · \w\s*$")
_SHOWN_ONLY_TAGS = re.compile(r"(?:\s*</?[a-zA-Z][^<>]*>)*\s*$|\s*\\(?:begin|end)\{[a-zA-Z*]+\}(?:\[[^\]]*\])?\s*$|\s*[=\-_*~`|#>$+]*\s*$")
_BYLINE = re.compile(r"(?:[^\W\d_]{2,6} )?(?:[A-ZÀ-ÞА-Я][\w'’\-]+ ){0,2}[A-ZÀ-ÞА-Я][\w'’\-]+ ?[,·|] ?(?:\d{1,2}\.? )?(?:de )?[^\W\d_]{3,12}\.? (?:de )?(?:19|20)\d\d\W*$")
_ROW = re.compile(r" [|/·»>] |\S {3,}\S")
_ROW_SIGNS = (" | ", " / ", " · ", " » ", " > ")
_QUOTES = frozenset("“„«\"")
_PARTS = re.compile(r"\s+[|/·»>]\s+|\s{3,}")
_SENTENCE_END = re.compile(r"[.!?]\s+")
_END = re.compile(r"[.!?…:;][\"”»)\]*_`']*$")


def shows_text(line: str) -> bool:
    """Whether a reader sees anything of the line."""
    if line[:1].isalnum():
        return True
    return bool(_LETTER.search(line)) and not _SHOWN_ONLY_TAGS.match(line) or (bool(line.strip()) and not line.isascii() and not _SHOWN_ONLY_TAGS.match(line))


def site_name(url: str | None) -> str:
    """The host of a url, in which the words of its site's name are looked for."""
    if not url:
        return ""
    return re.sub(r"^[a-z]+://", "", url).split("/")[0].lower().removeprefix("www.")


def tokens(text: str, site: str) -> list[str]:
    """Words and signs in lower case; figures are 0, words of the site's name are ``site`` in lines of some length."""
    if not text.isascii():
        found = ["0" if w.isdecimal() else w for w in _WORD.findall(text.lower())]
    else:
        text = text.translate(_PLAIN)
        if "0" in text:
            text = _ZEROS.sub(" 0 ", text)
        found = _PLAIN_SIGN.sub(r" \g<0> ", text).split() if "|" in text or "/" in text or ":" in text else text.split()
    if site and len(found) > 2 and not (names := _names(site)).isdisjoint(found):
        return ["site" if w in names else w for w in found]
    return found


_FIGURES = re.compile(r"\d+")
#: ASCII as words are written: in lower case, figures as 0, a blank for what is no part of a word and no sign.
_PLAIN = "".join([c if c in "|/:" else "0" if c.isdigit() else c.lower() if c.isalpha() else " " for c in map(chr, range(128))])
_ZEROS = re.compile("0+")
_PLAIN_SIGN = re.compile("[|/:]")


@lru_cache(maxsize=4096)
def _names(site: str) -> frozenset[str]:
    """The words of a site's name: the parts of its host, and what of a part may be one of two words."""
    parts = [p for p in re.split(r"[.\-:]", site) if len(p) > 3]
    return frozenset(parts) | {w for p in parts for k in range(4, len(p) - 2) for w in (p[:k], p[-k:])}

_MARKED = re.compile(r"[<\\\]*'`&_]")
_OWN_KINDS = frozenset(("code", "display", "formula", "quote", "list", "signature"))
_SEPARATED = re.compile(r"(.{8,110}?)(?: [–|] |: ?)(\S.*)$")


def _teaser(seen: str, stop: bool) -> bool:
    """A title, a separator and the first words of another page, perhaps cut or with a figure at the end."""
    if seen[:1] == "←" or seen[-1:] == "→":
        return len(seen) > 8
    if len(seen) < 40 or not (":" in seen or " – " in seen or " | " in seen):
        return False
    found = _SEPARATED.match(seen)
    if not found:
        return False
    head, rest = found.groups()
    if _END.search(head) or not rest[:1].isupper() and rest[:1] not in "¿«“\"" and not rest[:1].isdigit():
        return False
    if " – " in seen[: len(head) + 3] or " | " in seen[: len(head) + 3]:
        return True
    return bool(re.search(r"» ?\d+\s*$|…\s*$", seen)) or not stop or len(rest.split()) > 3 and rest[:1].isupper()


_MARKS = {f: "item" for f in ("bullet", "numbered", "htmlitem", "wikistars", "wikihash", "texitem")} | {f: "heading" for f in ("hash1", "hash2", "htmlheading", "wikiheading", "texheading", "setext")}


_SIGNS = {k: None for k in range(128) if not chr(k).isalnum()}


def _same(text: str) -> str:
    if text.isascii():
        return text.lower().translate(_SIGNS)
    return "".join([c for c in normalize("NFKD", text.lower()) if c.isalnum()])


def page_titles(url: str | None, title: str | None) -> tuple[str, ...]:
    """What a page's headline may be: the record's title, and the words of its address. Only letters and figures."""
    found = [_same(title)] if title else []
    slug = re.sub(r"[?#].*$", "", url or "").rstrip("/").rsplit("/", 1)[-1]
    slug = _same(re.sub(r"-\d+$", "", slug))
    if len(slug) >= 12 and not slug.isdigit():
        found.append(slug)
    return tuple(x for x in found if x)


def _is_title(seen: str, titles: tuple[str, ...]) -> bool:
    first = seen[0].lower()
    if first.isascii() and first.isalnum() and not any([t[0] == first for t in titles]):
        return False
    own = _same(seen)
    return any(own == t or (len(t) >= 12 and own.startswith(t)) for t in titles)




class Leaf(NamedTuple):
    """A visible line by itself: its number, its shape, whether it is long like a paragraph, whether a blank line stands
    before it, and the keys of its words: of the whole line, of its parts, of its first and last words."""

    line_no: int
    shape: tuple
    long: bool
    after_blank: bool
    keys: tuple[tuple[int, ...], ...]


#: What a key is made of: the whole line, a part of it, its first three, two and one words, its last two.
GROUPS = ("whole", "part", "first three", "first two", "first", "last two")
_NO_KEYS: tuple[tuple[int, ...], ...] = ((),) * len(GROUPS)


def _size(count: int) -> str:
    return "1" if count == 1 else "2-3" if count < 4 else "4-8" if count < 9 else "9-16" if count < 17 else "17+"


def _words_of(seen: str, site: str, row: bool) -> tuple[list[str], list[list[str]]]:
    """A line's words, and those of its parts: of a row the parts between its signs, of other lines their sentences."""
    if row:
        return tokens(seen, site), [tokens(x, site) for x in _PARTS.split(seen.strip()) if x]
    if not (". " in seen or "! " in seen or "? " in seen):
        return tokens(seen, site), []
    cuts = [0, *[m.end() for m in _SENTENCE_END.finditer(seen)], len(seen)]
    parts = [tokens(seen[a:b], site) for a, b in zip(cuts, cuts[1:]) if a < b]
    return [w for part in parts for w in part], parts


def word_keys(words: list[str], parts: list[list[str]], row: bool, long: bool) -> tuple[tuple[int, ...], ...]:
    """The keys of a line's words by GROUPS, as unsigned numbers."""
    some = len(words)
    if not some:
        return _NO_KEYS
    joined = [" ".join(c) for c in parts if c] if len(parts) > 1 else []
    return (
        (_hash("w" + " ".join(words if row or not joined else joined)),), tuple([_hash("w" + c) for c in joined]),
        (_hash("p" + " ".join(words[:3])),) if some > 3 else (), (_hash("p" + " ".join(words[:2])),) if some > 2 else (), (_hash("p" + words[0]),) if some > 1 else (),
        (_hash("s" + " ".join(words[-2:])),) if some > 2 and not row and not long else (),
    )


class LineReader:
    """Reads lines by themselves and remembers them: sites share their lines, and a page's renderings share theirs. The
    memory is emptied and filled again when it is full."""

    SIZE = 30_000

    def __init__(self):
        self.memory: dict[tuple, tuple | None] = {}

    def read(self, line: str, mark: str, site: str) -> tuple | None:
        """(shape, long, keys, what may be a title) of a line; None for one without visible text. What is remembered of a
        line holds for every site of whose name it has no word."""
        at = (line, mark)
        found = self.memory.get(at, at)
        if found is None:
            return None
        if found is not at and (not site or found[4].isdisjoint(_names(site))):
            return found
        if len(self.memory) >= self.SIZE:
            self.memory.clear()
        if not shows_text(line):
            self.memory[at] = None
            return None
        made = self._read(line, mark, site)
        if "site" not in made[4]:
            self.memory[at] = made
        return made

    def _read(self, line: str, mark: str, site: str) -> tuple:
        if mark == "code" or mark == "display":
            return (mark, mark, "", "", False, "", False, ""), False, _NO_KEYS, "", frozenset()
        tag = ""
        if "<" in line and (m := _TAG_NAME.match(line)):
            tag = m.group(1).lower()
            tag = "h" if tag[0] == "h" and tag[1:].isdigit() else tag
        seen = visible(line) if _MARKED.search(line) else line.strip()
        row = len(seen) < 300 and ("   " in seen or any([sign in seen for sign in _ROW_SIGNS])) and _ROW.search(seen) is not None
        words, parts = _words_of(seen, site, row)
        count, distinct = sum(map(str.isalpha, words)), frozenset(words)
        stop = not seen[-1:].isalnum() and bool(_END.search(seen[-16:]))
        sentence = count >= 6 and len(seen) >= 40 and (stop or count >= 14)
        long = sentence and (len(seen) >= PARAGRAPH or len(parts) > 1)
        linked = ("<a href" in line or "](/" in line) and _RELATIVE_LINK.match(line) is not None
        if mark == "quote" or tag == "blockquote" or (seen[:1] in _QUOTES and _QUOTED.match(seen)) or "\\begin{quote}" in line:
            kind = "quote"
        elif ("=" in line or "\\" in line or "$" in line or "<math" in line or "<script" in line) and _FORMULA_LINE.match(line):
            kind = "formula"
        elif seen[:1] in "—–" and _SIGNATURE.match(seen):
            kind = "signature"
        elif not mark and _teaser(seen, stop):
            kind, long = "teaser", False
        elif not stop and len(seen) < 100 and _FIGURES.search(seen[-8:]) and _BYLINE.match(seen):
            kind = "byline"
        elif not long and ";" in seen and _LIST_LINE.match(seen):
            kind = "list"
        elif ("**" in line or "'''" in line or "\\textbf" in line) and _BOLD.match(line):
            kind = "bold"
        else:
            kind = "text"
        sign = "row" if row else "colon" if not long and ":" in seen[:40] else ""
        shape = (kind, mark, tag, "sentence" if sentence and not long else _size(count), stop, sign, linked, _hint(seen, distinct))
        return shape, long, word_keys(words, parts, row, long), seen if kind in ("text", "bold") and count and not long and len(seen) <= 160 else "", distinct


def leaves(text: str, site: str, titles: tuple[str, ...], reader: LineReader) -> list[Leaf]:
    """The visible lines of a value."""
    lines = text.split("\n")
    marks: list[str] = [""] * len(lines)
    for form, start, end, _ in scan(text):
        if form in CODE_FORMS:
            marks[start:end] = ["code"] * (end - start)
        elif form == "display" or form == "quote":
            marks[start:end] = [form] * (end - start)
        else:
            marks[start] = _MARKS.get(form, "")
    found: list[Leaf] = []
    after_blank = True
    for at, line in enumerate(lines):
        if not line or line.isspace():
            after_blank = True
            continue
        if (read := reader.read(line, marks[at], site)) is not None:
            shape, long, keys, title, _ = read
            if title and titles and _is_title(title, titles):
                shape = ("title", *shape[1:])
            found.append(Leaf(at + 1, shape, long, after_blank, keys))
        after_blank = False
    return found

def _hint(seen: str, words: frozenset[str]) -> str:
    """A sign that lines around a page's text often bear: a mark of rights, the site's own name, an arrow, an address."""
    return "rights" if "©" in seen else "arrow" if seen[:1] in "←→↑" or seen[-1:] in "←→↑" else "site" if "site" in words else "address" if "@" in seen else "field" if "[" in seen else ""




def prior_of(own: float | None, count: float | None) -> float:
    """The share of own text among all that the corpus knows."""
    return float(np.clip(own / count, 0.05, 0.95)) if count else 0.5


#: Borders between the classes of a key's log odds, and of the number of other pages that have it.
BINS = np.array([-3.0, -1.5, -0.5, 0.5, 1.5])
OFTEN = np.array([1, 3, 10])


class Lexicon:
    """What the corpus knows of keys: in how many records each stands, and in how many of these as own text."""

    def __init__(self, keys: np.ndarray, own: np.ndarray, count: np.ndarray, prior: float | None = None):
        order = np.argsort(keys)
        self.keys, self.own, self.count = keys[order], own[order], count[order]
        self.prior = prior_of(own.sum(), count.sum()) if prior is None else prior

    def without(self, keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(records with the key as own text, records with it), without the record that asks, in which the key was own text
        with chance ``own``."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys)), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        count = np.where(hit, self.count[at] - 1, 0.0)
        return np.clip(np.where(hit, self.own[at] - own, 0.0), 0.0, count), count


def known_words(lexicon: Lexicon, group: np.ndarray, leaf: np.ndarray, key: np.ndarray, own: np.ndarray, size: int) -> tuple[list[tuple], np.ndarray]:
    """For each of ``size`` lines the classes of what is known of its whole, its parts, its first and its last words and of
    how many others have the whole, and whether this makes it a line around. First words are smoothed from the longest
    down to the first alone."""
    kept, count = lexicon.without(key, own)
    prior = lexicon.prior
    base = np.log(prior / (1 - prior))
    at = [group == g for g in range(len(GROUPS))]
    spread = lambda g, values: np.bincount(leaf[at[g]], values[at[g]], size)
    logit = lambda share: np.log(share / (1 - share)) - base
    share = np.full(size, prior)
    for g in (4, 3, 2):
        n = spread(g, count)
        share = np.where(n > 0, (spread(g, kept) + SMOOTH * share) / (n + SMOOTH), share)
    alone = (kept + PRIOR_COUNT * prior) / (count + PRIOR_COUNT)
    parts = np.where(count > 0, logit(alone), 0.0)
    known_parts = np.bincount(leaf[at[1]], (count > 0)[at[1]], size)
    values = (np.bincount(leaf[at[0]], parts[at[0]], size), np.bincount(leaf[at[1]], parts[at[1]], size) / np.maximum(known_parts, 1), logit(share), np.bincount(leaf[at[5]], parts[at[5]], size))
    seen = (spread(0, count), np.bincount(leaf[at[1]], count[at[1]], size), spread(4, count), spread(5, count))
    classes = [np.where(n > 0, np.digitize(v, BINS), -1) for v, n in zip(values, seen)] + [np.digitize(seen[0], OFTEN)]
    low = np.zeros(size, bool)
    for v, n, below in zip(values, seen, (AROUND_BELOW, AROUND_BELOW, AROUND_BELOW - 0.5, AROUND_BELOW - 0.5)):
        low |= (v < below) & (n > 1)
    # a line that is known as a whole is judged by that
    return list(map(tuple, np.stack(classes, 1).tolist())), low & ~(classes[0] >= 3)


_UNKNOWN = (-1, -1, -1, -1, -1)


def line_features(key: tuple) -> tuple[str, ...]:
    shape, known, low, alone = key
    kind, mark, tag, size, stop, row, link, hint = shape
    names = [f"kind={kind}", f"mark={mark}", f"tag={tag}", f"kind={kind},mark={mark}", f"tag={tag},kind={kind}", f"size={size},stop={stop}", f"row={row},kind={kind},mark={mark}", f"link={link},kind={kind},mark={mark}", f"hint={hint},size={size},mark={mark}", f"hint={hint},kind={kind}", f"alone={alone},kind={kind}"]
    if known != _UNKNOWN:
        names += [f"{g}{c}" for g, c in zip("wrps", known) if c >= 0]
        names += [f"w={known[0]},mark={mark}", f"w={known[0]},kind={kind}", f"w={known[0]},r={known[1]},p={known[2]}", f"p={known[2]},mark={mark},kind={kind}", f"p={known[2]},s={known[3]}", f"r={known[1]},row={row}", f"low={low},mark={mark},kind={kind}", f"n={known[4]},size={size},stop={stop}", f"n={known[4]},w={known[0]},size={size}", f"n={known[4]},mark={mark}", f"low={low},alone={alone}"]
    if kind == "text" and not mark:
        names += [f"bare,size={size},stop={stop}", f"bare,w={known[0]},p={known[2]}", f"bare,alone={alone},size={size}"]
    return tuple(names)


class Placed(NamedTuple):
    """The lines of a value in their tree: each line's features, block and region, and the kinds of these."""

    keys: list[tuple]
    block: list[int]
    block_kinds: list[tuple]
    region: list[int]
    region_kinds: list[tuple]


_CLOSING = frozenset(("code", "display", "formula", "quote", "list", "signature"))
_NOT_FOLLOWING = frozenset(("teaser", "byline"))
_NAV_TAGS = frozenset(("nav", "aside", "footer", "div"))


def place(tree: Sequence[tuple[tuple, bool, bool]], known: Sequence[tuple], low: Sequence[bool]) -> Placed:
    """The tree over a value's lines (shape, long, after_blank). Long lines known as lines around bound no region."""
    few = lambda n: 1 if n == 1 else 2 if n < 4 else 3
    total = len(tree)
    body = [long and not k for (_, long, _), k in zip(tree, low)]
    first = next((k for k, b in enumerate(body) if b), total)
    final = next((k for k in range(total - 1, -1, -1) if body[k]), -1)
    follows, follow = [""] * total, "end"
    for k in range(total - 1, -1, -1):
        follows[k] = follow
        if not low[k]:
            kind, mark, _, size = tree[k][0][:4]
            if kind not in _NOT_FOLLOWING:
                follow = "long" if body[k] else kind if kind in _CLOSING else mark if mark else "sentence" if size == "sentence" else "short"
    keys, block, region = [], [], []
    block_kinds: list[tuple] = []
    region_kinds: list[tuple] = []
    alone = "" if final >= 0 and total > 3 else few(total)
    before = group = lead = None
    count = start = 0
    marked = False
    for k, (shape, _, after_blank) in enumerate(tree):
        kind, mark, tag, size, stop, _, link, _ = shape
        where = "body" if body[k] else "alone" if final < 0 else "top" if k < first else "tail" if k > final else "gap"
        own = "nav" if tag in _NAV_TAGS else tag or mark
        if where != before or after_blank or group != own:
            if count:
                block_kinds.append((group, few(count), marked, lead, *ends))
            if where != before:
                if count:
                    region_kinds.append((before, few(k - start)))
                before, start = where, k
            lead = "first" if k == 0 else "body" if body[k - 1] else "around" if low[k - 1] or tree[k - 1][0][0] == "teaser" else "short"
            group, count, marked = own, 0, False
            region.append(len(region_kinds))
        count += 1
        if low[k] or link:
            marked = True
        ends = follows[k], "" if mark else kind, size if stop else "open"
        block.append(len(block_kinds))
        keys.append((shape, known[k], low[k], alone))
    if count:
        block_kinds.append((group, few(count), marked, lead, *ends))
        region_kinds.append((before, few(total - start)))
    return Placed(keys, block, block_kinds, region, region_kinds)


class Evidence:
    """A maximum-entropy model over discrete features, trained by gradient ascent with Adam steps and an L2 penalty over
    the distinct sets of features. ``score`` is the log likelihood ratio of own text."""

    def __init__(self, samples: Counter, steps: int = 250, rate: float = 0.2, penalty: float = 3e-5):
        sets = sorted({names for names, _ in samples})
        index = {name: k for k, name in enumerate(sorted({n for names in sets for n in names}))}
        rows = np.repeat(np.arange(len(sets)), [len(names) for names in sets])
        columns = np.array([index[n] for names in sets for n in names])
        own = np.array([samples[names, 1] for names in sets], float)
        total = own + np.array([samples[names, 0] for names in sets])
        weights, bias = np.zeros(len(index)), 0.0
        first, second = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
        for step in range(1, steps + 1):
            chance = 1 / (1 + np.exp(-(np.bincount(rows, weights[columns], len(sets)) + bias)))
            gap = (own - total * chance) / total.sum()
            slope = np.append(np.bincount(columns, gap[rows], len(index)) - penalty * weights, gap.sum())
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            weights, bias = weights + move[:-1], bias + move[-1]
        share = own.sum() / total.sum()
        self.bias = bias - float(np.log(share / (1 - share)))
        self.weights = dict(zip(index, weights.tolist()))
        self.memory: dict[tuple, float] = {}

    def score(self, key: tuple) -> float:
        found = self.memory.get(key)
        if found is None:
            if len(self.memory) > MEMORY:
                self.memory.clear()
            weights = self.weights
            found = self.memory[key] = max(-12.0, min(12.0, self.bias + sum([weights.get(n, 0.0) for n in line_features(key)])))
        return found


#: Scores kept by a worker; beyond them the memory is emptied and filled again.
MEMORY = 200_000
#: Weights of a line's own evidence among which training chooses.
SCALES = (0.4, 0.55, 0.7, 0.85, 1.0)


class TreeModel:
    """A line's evidence, and the potentials of lines in blocks, blocks in regions and regions in pages."""

    def __init__(self, placed: Sequence[Placed], truth: Sequence[Sequence[int]]):
        samples: Counter = Counter()
        for tree, labels in zip(placed, truth):
            for key, label in zip(tree.keys, labels):
                if label >= 0:
                    samples[line_features(key), label] += 1
        self.evidence = Evidence(samples)
        lines, blocks, regions, pages = Counter(), Counter(), Counter(), Counter()
        for tree, labels in zip(placed, truth):
            kept = [k for k, label in enumerate(labels) if label >= 0]
            if not kept:
                continue
            most = lambda of: {b: int(2 * sum(labels[k] for k in kept if of[k] == b) >= sum(of[k] == b for k in kept)) for b in {of[k] for k in kept}}
            region_of = [tree.region[b] for b in tree.block]
            state, above = most(tree.block), most(region_of)
            page = int(2 * sum(labels[k] for k in kept) >= len(kept))
            pages[page] += 1
            for b, s in state.items():
                blocks[tree.block_kinds[b], above[tree.region[b]], s] += 1
            for r, s in above.items():
                regions[tree.region_kinds[r], page, s] += 1
            for k in kept:
                lines[tree.block_kinds[tree.block[k]], state[tree.block[k]], labels[k]] += 1
        self.tables = tuple(map(_potentials, (lines, blocks, regions)))
        self.page = np.log(np.array([pages[0] + 1.0, pages[1] + 1.0]) / (sum(pages.values()) + 2))
        self.scale = 1.0
        right = {}
        for scale in SCALES:
            self.scale = scale
            found = self.odds(placed)
            right[scale] = sum(int(o > 0) == label for odds, labels in zip(found, truth) for o, label in zip(odds, labels) if label >= 0)
        self.scale = max(right, key=lambda s: (right[s], -s))

    def potentials(self, level: int, kinds: Sequence[tuple]) -> np.ndarray:
        at, tables = self.tables[level]
        return tables[[at.get(k, 0) for k in kinds]]

    def odds(self, placed: Sequence[Placed]) -> list[np.ndarray]:
        """Log odds of own text of every line, by messages upward and downward over all trees at once."""
        sizes = [len(tree.keys) for tree in placed]
        if not sum(sizes):
            return [np.zeros(0) for _ in placed]
        score = self.scale * np.array([self.evidence.score(key) for tree in placed for key in tree.keys])
        block, region, page, n_blocks, n_regions = [], [], [], 0, 0
        for k, tree in enumerate(placed):
            block += [n_blocks + b for b in tree.block]
            region += [n_regions + r for r in tree.region]
            page += [k] * len(tree.region_kinds)
            n_blocks += len(tree.block_kinds)
            n_regions += len(tree.region_kinds)
        levels = (
            (np.array(block), self.potentials(0, [tree.block_kinds[b] for tree in placed for b in tree.block]), n_blocks),
            (np.array(region), self.potentials(1, [kind for tree in placed for kind in tree.block_kinds]), n_regions),
            (np.array(page), self.potentials(2, [kind for tree in placed for kind in tree.region_kinds]), len(placed)),
        )
        return np.split(marginals(score, levels, self.page), np.cumsum(sizes)[:-1])


def _potentials(counts: Counter) -> tuple[dict, np.ndarray]:
    """Where each kind stands, and log P(child | parent) as [kind, parent, child]; first that of kinds that were never seen."""
    def logs(table: np.ndarray) -> np.ndarray:
        return np.log(table / table.sum(1, keepdims=True))

    every = np.ones((2, 2))
    tables: dict[tuple, np.ndarray] = {}
    for (kind, parent, child), n in counts.items():
        every[parent, child] += n
    share = every / every.sum(1, keepdims=True)
    for (kind, parent, child), n in counts.items():
        tables.setdefault(kind, 4 * share.copy())[parent, child] += n
    return {kind: k for k, kind in enumerate(tables, 1)}, np.array([logs(t) for t in (every, *tables.values())])


def marginals(score: np.ndarray, levels: Sequence[tuple[np.ndarray, np.ndarray, int]], root: np.ndarray) -> np.ndarray:
    """Sum-product on forests: ``levels`` from the leaves up are (parent of each node, log potentials [node, parent state,
    state], parents). Gives the log odds of state 1 of each leaf, whose evidence for it is ``score``."""
    belief = np.stack([np.zeros(len(score)), score], 1)
    said, ups = [belief], []
    for parent, potential, parents in levels:
        up = np.logaddexp(potential[:, :, 0] + belief[:, :1], potential[:, :, 1] + belief[:, 1:])
        belief = np.stack([np.bincount(parent, up[:, s], parents) for s in (0, 1)], 1)
        ups.append(up)
        said.append(belief)
    down = np.broadcast_to(root, belief.shape)
    for (parent, potential, _), up, below in zip(reversed(levels), reversed(ups), reversed(said[1:])):
        rest = (down + below)[parent] - up
        down = np.logaddexp(potential[:, 0, :] + rest[:, :1], potential[:, 1, :] + rest[:, 1:])
    total = down + said[0]
    return total[:, 1] - total[:, 0]


class Counted(NamedTuple):
    """The keys of many records' lines, flat: of which line, of which group, the chance of own text where the key stands in
    its record, and whether it is the key's first place there."""

    key: np.ndarray
    leaf: np.ndarray
    group: np.ndarray
    own: np.ndarray
    first: np.ndarray


def counted(lines: Sequence[Leaf], record: np.ndarray, chance: np.ndarray) -> Counted:
    """``record`` of each line, ascending, and its ``chance`` of own text."""
    by_group = [keys for leaf in lines for keys in leaf.keys]
    key = np.array([key for keys in by_group for key in keys], np.uint64).view(np.int64)
    if not len(key):
        return Counted(*(np.zeros(0, t) for t in (np.int64, np.int32, np.int8, np.float32, bool)))
    leaf, group = np.divmod(np.repeat(np.arange(len(by_group), dtype=np.int32), list(map(len, by_group))), len(GROUPS))
    group = group.astype(np.int8)
    order = np.lexsort((key, record[leaf]))
    new = np.ones(len(key), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(record[leaf[order]]) != 0)
    run = np.cumsum(new) - 1
    mean = np.bincount(run, chance[leaf[order]]) / np.bincount(run)
    own, first = np.empty(len(key), np.float32), np.empty(len(key), bool)
    own[order], first[order] = mean[run], new
    return Counted(key, leaf, group, own, first)


def unworded(trees: Sequence[Sequence[Leaf]]) -> list[Placed]:
    return [place([(x.shape, x.long, x.after_blank) for x in tree], [_UNKNOWN] * len(tree), [False] * len(tree)) for tree in trees]


class ContentModel:
    """The tree without words, and the tree with them."""

    def __init__(self, count: int = 3600, seed: int = 3):
        pages, reader = labelled_pages(count, seed), LineReader()
        trees = [leaves("\n".join(line for line, _ in lines), site.lower().replace(" ", ""), page_titles(None, title), reader) for site, title, lines in pages]
        truth = [[lines[x.line_no - 1][1] for x in tree] for tree, (_, _, lines) in zip(trees, pages)]
        self.plain = TreeModel(unworded(trees), truth)
        record, found = self.count(trees, range(len(trees)))
        kinds, where = np.unique(found.key[found.first], return_inverse=True)
        own, count = np.bincount(where, found.own[found.first], len(kinds)), np.bincount(where, minlength=len(kinds)).astype(float)
        lexicon = Lexicon(kinds[count > 1], own[count > 1], count[count > 1])
        known, low = known_words(lexicon, found.group, found.leaf, found.key, found.own, len(record))
        cuts = np.cumsum([0, *map(len, trees)])
        self.worded = TreeModel([place([(x.shape, x.long, x.after_blank) for x in tree], known[a:b], low[a:b]) for tree, a, b in zip(trees, cuts, cuts[1:])], truth)

    def count(self, trees: Sequence[Sequence[Leaf]], records: Sequence[int]) -> tuple[np.ndarray, Counted]:
        """The record of each line of trees of these records, and the keys of all with the first tree's judgement."""
        record = np.repeat(np.array(records, np.int64), [len(tree) for tree in trees])
        odds = self.plain.odds(unworded(trees))
        return record, counted([leaf for tree in trees for leaf in tree], record, 1 / (1 + np.exp(-np.concatenate(odds))) if odds else np.zeros(0))


@lru_cache(maxsize=1)
def trained() -> ContentModel:
    return ContentModel()


@lru_cache(maxsize=50_000)
def _encoded(shape: tuple) -> str:
    return "\t".join([str(int(x)) if isinstance(x, bool) else x for x in shape])


@lru_cache(maxsize=50_000)
def _decoded(text: str) -> tuple:
    kind, mark, tag, size, stop, row, link, hint = text.split("\t")
    return kind, mark, tag, size, stop == "1", row, link == "1", hint


#: Records of a part, which are read and judged together; bounds a worker's memory.
SLICE = 200
#: Objects made between a worker's collections of garbage: lines are remembered in many small ones, none in a cycle.
COLLECT = (100_000, 20, 50)
#: The lines of a record and their keys, which are numbered within its part. A part's first record bears what its keys are,
#: and for each in how many of its records it stands and in how many of these as own text.
LEAVES = (
    "part bigint, part_key array<bigint>, part_own array<double>, part_n array<int>, "
    "field array<tinyint>, line_no array<int>, shape array<string>, long array<boolean>, after_blank array<boolean>, "
    "key array<int>, key_leaf array<int>, key_group array<tinyint>, key_own array<float>"
)


def _lists(counts: np.ndarray, values: np.ndarray | list, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def line_table(pages: DataFrame, kept: tuple[str, ...], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A row for each record, with the columns ``kept``, its visible lines and their keys, as judged by the tree without
    words. Written once, since both the counts and the second tree read it."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(*COLLECT)
        reader = LineReader()
        part = TaskContext.get().partitionId() << 32
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                part += 1
                trees, at = [], []
                columns = [batch.column(f).to_pylist() for f in fields]
                for k, (url, title) in enumerate(zip(batch.column("url").to_pylist(), batch.column("title").to_pylist())):
                    site, titles = site_name(url), page_titles(url, title)
                    for f, texts in enumerate(columns):
                        if texts[k]:
                            trees.append(leaves(texts[k], site, titles, reader))
                            at.append((k, f))
                record, found = model.count(trees, [k for k, _ in at])
                lines = np.bincount(record, minlength=batch.num_rows)
                keys = np.bincount(record[found.leaf], minlength=batch.num_rows)
                first = np.concatenate([[0], np.cumsum(lines)])[record[found.leaf]]
                flat = [leaf for tree in trees for leaf in tree]
                kinds, key = np.unique(found.key, return_inverse=True)
                once, of_part = key[found.first], np.append(len(kinds), np.zeros(batch.num_rows - 1, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], pa.array(np.full(batch.num_rows, part)), _lists(of_part, kinds, pa.int64()), _lists(of_part, np.bincount(once, found.own[found.first], len(kinds)), pa.float64()), _lists(of_part, np.bincount(once, minlength=len(kinds)), pa.int32()),
                     _lists(lines, np.repeat(np.array([f for _, f in at], np.int8), [len(t) for t in trees]), pa.int8()), _lists(lines, [x.line_no for x in flat], pa.int32()),
                     _lists(lines, [_encoded(x.shape) for x in flat], pa.string()), _lists(lines, [x.long for x in flat], pa.bool_()), _lists(lines, [x.after_blank for x in flat], pa.bool_()),
                     _lists(keys, key, pa.int32()), _lists(keys, (found.leaf - first).astype(np.int32), pa.int32()), _lists(keys, found.group, pa.int8()), _lists(keys, found.own, pa.float32())],
                    names=[*kept, *_NAMES],
                )

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    read = dict.fromkeys([*kept, "url", "title", *fields])
    return materialise(pages.select(*read).mapInArrow(run, f"{kinds}, {LEAVES}"), "page-lines")


_NAMES = [column.split(" ")[0] for column in LEAVES.split(", ")]


def corpus_keys(lines: DataFrame) -> tuple[DataFrame, float]:
    """(part, key, own, n): of every key of every part in how many records of the corpus it stands, and in how many of these
    as own text, and the prior over all. Only keys of one record are left out, since they say nothing of another. A key has
    one row for each part that has it, so none is hot."""
    pairs = lines.where(F.size("part_key") > 0).select("part", F.posexplode(F.arrays_zip("part_key", "part_own", "part_n")).alias("key", "x")).select("part", "key", "x.*")
    same = Window.partitionBy("part_key")
    totals = pairs.select("part", "key", "part_own", "part_n", F.sum("part_own").over(same).alias("own"), F.sum("part_n").over(same).alias("n"))
    known = materialise(totals.where(F.col("n") > 1), "corpus-keys")
    return known.select("part", "key", "own", "n"), prior_of(*known.agg(F.sum("part_own"), F.sum("part_n")).first())


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def judged(model: ContentModel, lexicon: Lexicon, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, field, line_no, own) of every visible line of rows of the line table."""
    lines = np.array([len(x) for x in batch.column("line_no")])
    keys = np.array([len(x) for x in batch.column("key")])
    starts = np.concatenate([[0], np.cumsum(lines)])
    leaf = _numbers(batch, "key_leaf") + np.repeat(starts[:-1], keys)
    known, low = known_words(lexicon, _numbers(batch, "key_group"), leaf, _numbers(batch, "key"), _numbers(batch, "key_own"), starts[-1])
    row, field = np.repeat(np.arange(len(lines)), lines), _numbers(batch, "field")
    tree = list(zip(map(_decoded, batch.column("shape").flatten().to_pylist()), _numbers(batch, "long").tolist(), _numbers(batch, "after_blank").tolist()))
    cuts = [0, *(np.flatnonzero(np.diff(row * 8 + field)) + 1).tolist(), len(tree)] if tree else [0]
    flags = low.tolist()
    odds = model.worded.odds([place(tree[a:b], known[a:b], flags[a:b]) for a, b in zip(cuts, cuts[1:])])
    return row, field, _numbers(batch, "line_no"), (np.concatenate(odds) if odds else np.zeros(0)) > OWN_FROM


def judged_parts(lines: DataFrame, kept: tuple[str, ...], answer: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """What ``answer`` makes of a batch of the line table and of what ``judged`` finds in it: each part of the table meets what
    the corpus knows of its keys."""
    known, prior = corpus_keys(lines)
    model = trained()

    def run(part: pa.Table, keys: pa.Table) -> pa.Table:
        lexicon = Lexicon(*(keys.column(c).to_numpy().astype(t) for c, t in (("key", np.int64), ("own", np.float64), ("n", np.float64))), prior)
        return pa.Table.from_batches([answer(batch, *judged(model, lexicon, batch)) for batch in part.combine_chunks().to_batches()])

    read = lines.select(*dict.fromkeys(kept), "part", *(c for c in _NAMES if not c.startswith("part")))
    return read.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, schema)


def judged_lines(pages: DataFrame, wanted: bool, id_column: str = "fetch_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field_name, line_no) of the visible lines that are own text (``wanted``) or are not."""
    names = pa.array(fields, pa.string())

    def answer(batch: pa.RecordBatch, row: np.ndarray, field: np.ndarray, number: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        chosen = own == wanted
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[chosen], pa.int32())), names.take(pa.array(field[chosen], pa.int32())), pa.array(number[chosen], pa.int32())], names=[id_column, "field_name", "line_no"])

    kind = pages.schema[id_column].dataType.simpleString()
    return judged_parts(line_table(pages, (id_column,), fields), (id_column,), answer, f"`{id_column}` {kind}, field_name string, line_no int")


def main_texts(pages: DataFrame, id_column: str = "fetch_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, fields...) with only the page's own lines of each value, in order; blank lines and those without visible
    text stay beside them."""

    def answer(batch: pa.RecordBatch, *found: np.ndarray) -> pa.RecordBatch:
        drop: dict[tuple[int, int], set[int]] = {}
        for row, field, number, own in zip(*(x.tolist() for x in found)):
            if not own:
                drop.setdefault((row, field), set()).add(number)
        columns = [[_without(text, drop.get((k, f), ())) for k, text in enumerate(batch.column(name).to_pylist())] for f, name in enumerate(fields)]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=[id_column, *fields])

    kept = (id_column, *fields)
    kind = pages.schema[id_column].dataType.simpleString()
    return judged_parts(line_table(pages, kept, fields), kept, answer, f"`{id_column}` {kind}, " + ", ".join(f"`{f}` string" for f in fields))


def _without(text: str | None, drop: set[int]) -> str | None:
    if text is None:
        return None
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for n, x in enumerate(text.split("\n"), 1) if n not in drop)).strip("\n")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return judged_lines(table(spark, folder, "fetch_cache"), False)


def p3_main(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(table(spark, folder, "fetch_cache"))
