"""Text of scanned pages repaired into paragraphs: running lines out, broken words joined, misread words corrected.

Correction is a noisy channel: for each word of a line the candidates that known character confusions could have turned
into it, weighed by the confusions' probabilities at the page's confidence and by the corpus's n-grams, are decoded by
Viterbi. Running lines are found by their repetition near the edges of neighbouring pages of the scan, by their form and
by the sentence they interrupt. A word is broken when its joined form, not its hyphenated one, is a word of the corpus.

Defined cases: a null or empty text has no lines; a null confidence takes the rate of all pages, one over 1 is in
percent; a page delivered twice is read each time, its neighbours take the first; a missing page leaves the words at its
edges unjoined but still broken; numbers have no corpus and are misread only when they hold letters or signs; boxes,
lang and other columns are not needed; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialise
from ..sources.tables import table

#: What a scanner reads, and what was printed.
CONFUSIONS = (
    ("0", "o"), ("0", "O"), ("1", "l"), ("1", "i"), ("1", "I"), ("5", "s"), ("5", "S"), ("6", "b"), ("6", "é"), ("8", "B"), ("9", "g"), ("2", "Z"), ("2", "z"), ("@", "a"), ("(", "c"), ("(", "C"), ("$", "S"), ("!", "l"), ("|", "l"),
    ("cl", "d"), ("b", "h"), ("f", "t"), ("c", "e"), ("ii", "u"), ("ii", "ü"), ("rn", "m"), ("m", "rn"), ("im", "nn"), ("vv", "w"), ("VV", "W"), ("h", "li"), ("lc", "k"), ("l", "I"), ("I", "l"), ("li", "h"), ("ﬁ", "fi"), ("ﬂ", "fl"),
    ("a", "ä"), ("a", "à"), ("a", "â"), ("a", "á"), ("o", "ö"), ("o", "ô"), ("o", "ó"), ("u", "ü"), ("u", "ù"), ("u", "ú"), ("e", "é"), ("e", "è"), ("e", "ê"), ("i", "ï"), ("i", "í"), ("i", "î"), ("n", "ñ"), ("c", "ç"), ("e", "c"), ("h", "b"), ("t", "f"),
)
_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _confusion in CONFUSIONS:
    _BY_FIRST.setdefault(_confusion[0][0], []).append(_confusion)
#: Words whose candidates a worker remembers; beyond them the memory is emptied and filled again.
MEMORY = 200_000
#: At most this many confusions in one word.
MOST_EDITS = 3
#: Share of all words from which a word, or a pair of words, is kept in the model that every executor reads: so it has
#: at most one million words and one million pairs, whatever the corpus.
LEAST_SHARE = 1e-6
#: Share of all words up to which a word is rare, so that it may be a misreading that was made again and again; two
#: occurrences are rare in any corpus.
RARE_SHARE = 5e-6
#: How much more frequent than a word its correction must be before the context is asked.
LEAST_RATIO = 2.0
#: A rare word is taken for misreading up to this many times what the confusions lead one to expect of it.
NOISE_SHARE = 6
#: Lines at either end of a page that may be running, and pages over which their repetition counts.
EDGE = 3
REACH = 3
HYPHENS = "-‐‑­¬"

_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"^[\"'“”„«»¿¡\[{*_—–]*(.*?)[\"'“”„«»\]}*_.,;:?—–]*$")
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "5": "s", "6": "b", "8": "b", "9": "g", "@": "a", "(": "c", "!": "l", "|": "l", "c": "e", "f": "t", "h": "b", "ä": "a", "à": "a", "â": "a", "á": "a", "é": "e", "è": "e", "ê": "e", "ö": "o", "ô": "o", "ó": "o", "ü": "u", "ù": "u", "ú": "u", "í": "l", "ï": "l", "î": "l", "ñ": "n", "ç": "e"})
_DIGITS = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "S": "5", "s": "5", "B": "8", "b": "6", "g": "9", "q": "9", "Z": "2", "z": "2", "@": "0", "G": "6"})
_N = r"([0-9OolIi|!SsBbgqZz@G]{1,4})"
_NUMBER_LINES = tuple(re.compile(x + r"\s*$", re.IGNORECASE) for x in (rf"\s*\[\s*{_N}\s*\]", rf"\s*{_N} ?/ ?{_N}", rf"\s*(?:P[a@]ge|Seite|P[aá]gina|S\.|p\.|Стр\.?) ?{_N}(?: (?:of|von|de|sur) {_N})?", rf"\s*[-–—] ?{_N}(?: ?[-–—])?", rf"\s*\(\s*{_N}\s*\)"))
_BARE_NUMBER = re.compile(rf"\s*{_N}\s*$")
_ROMAN = re.compile(r"\s*(?:[-–—\[(] ?)?(?:[xlvci1]{1,7}|[XLVCI1]{1,7})(?: ?[-–—\])])?\s*$")
_WITH_NUMBER = re.compile(rf"\s*{_N} +(\S.*)$")
_DOTTED = re.compile(rf"(.*?)\s*\.{{3,}}\s*{_N}\s*$")
_CHAPTER = re.compile(r"\s*(?:Ch[a@]pter|Kapitel|Chapitre|Cap[ií]tulo|Section|Teil|Part|Глава) ?[0-9lIO]{1,3}\s*[:.—–-]", re.IGNORECASE)
_COPY = re.compile(r"\((?:proof copy|draft|copy|entwurf|kopie|épreuve|borrador)\)\s*$", re.IGNORECASE)
_NAME_LINE = re.compile(r"\s*[A-ZÀ-Þ][^\W\d_]+ [A-ZÀ-Þ][^\W_]+\s*$")


def fold_key(line: str) -> str:
    """The letters of a line in a form that misreading hardly changes; figures and spaces are left out."""
    low = line.lower().replace("rn", "m").replace("cl", "d").replace("vv", "w").replace("ii", "u").replace("li", "h").replace("lc", "k").replace("im", "nn").replace("ﬁ", "fi")
    return "".join([c for c in re.sub(r"(?<![^\W_])[0-9|!]+(?![^\W_])|[^\w@(!|]", "", low).translate(_FOLD) if c.isalpha()])


def page_number(line: str) -> tuple[str, int | None]:
    """(form, value) of a line that may be a page number: marked, bare, roman, or empty."""
    for shape in _NUMBER_LINES:
        if found := shape.match(line):
            digits = found.group(1).translate(_DIGITS)
            return "marked", int(digits) if digits.isdigit() else None
    if found := _BARE_NUMBER.match(line):
        digits = found.group(1).translate(_DIGITS)
        if any(c.isdigit() for c in found.group(1)) and digits.isdigit():
            return "bare", int(digits)
    if _ROMAN.match(line):
        return "roman", None
    return "", None


EDGES = "ocr_id long, scan_id long, page_no int, line_no int, top int, bottom int, edge_key string, form string"


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first and last EDGE lines of each page that have text."""
    for batch in batches:
        rows = []
        for ocr, scan, page, text in zip(batch["ocr_id"], batch["scan_id"], batch["page_no"], batch["text"]):
            if not text:
                continue
            lines = [(k, x) for k, x in enumerate(text.split("\n"), 1) if x.strip()]
            for at, (number, line) in enumerate(lines):
                top, bottom = at + 1, len(lines) - at
                if top > EDGE and bottom > EDGE:
                    continue
                form, value = page_number(line)
                if form == "bare" and value != page and not (len(str(value)) == len(str(page)) and sum(a != b for a, b in zip(str(value), str(page))) == 1 and re.search(r"[^\d\s]", line)):
                    form = ""
                if form == "roman" and top != 1 and bottom != 1:
                    form = ""
                if not form:
                    if _CHAPTER.match(line) and top == 1:
                        form = "chapter"
                    elif _COPY.search(line):
                        form = "copy"
                    elif found := _DOTTED.match(line):
                        digits = found.group(2).translate(_DIGITS)
                        form = "dotted" if digits.isdigit() and int(digits) == page else ""
                    elif found := _WITH_NUMBER.match(line):
                        digits = found.group(1).translate(_DIGITS)
                        form = "numbered" if digits.isdigit() and int(digits) == page and top == 1 and len(found.group(2)) < 70 and found.group(2)[:1].isupper() and not re.search(r"[.,;]\s*$", found.group(2)) else ""
                    if not form and top == 1:
                        letters = [c for c in line if c.isalpha()]
                        if len(letters) > 6 and sum(c.isupper() for c in letters) > 0.85 * len(letters):
                            form = "capitals"
                        elif _NAME_LINE.match(line):
                            form = "name"
                key = fold_key(re.sub(r"^\s*[0-9OolISBZ]{1,4} (?=[A-ZÀ-Þ])|\s*\.{3,}\s*\S{1,4}\s*$", "", line))
                rows.append((ocr, scan, page, number, top, bottom, key, form))
        yield pd.DataFrame(rows, columns=["ocr_id", "scan_id", "page_no", "line_no", "top", "bottom", "edge_key", "form"])


def running_lines(pages: DataFrame) -> DataFrame:
    """(ocr_id, line_no) of headers, footers and page numbers."""
    edges = materialise(pages.where("text is not null").select("ocr_id", "scan_id", "page_no", "text").mapInPandas(_edges, EDGES), "edges")
    own = edges.where("form in ('marked', 'bare', 'roman', 'chapter', 'copy', 'dotted', 'numbered', 'capitals', 'name')")
    # a key is running where a page at most REACH away has it near an edge too; joined on the page itself, so that a
    # scan of any size spreads over all tasks
    keyed = edges.where(F.char_length("edge_key") >= 8)
    near = keyed.select("scan_id", "edge_key", "page_no").distinct().select("scan_id", "edge_key", F.explode(F.array(*[(F.col("page_no") + d) for d in range(-REACH, REACH + 1) if d])).alias("page_no")).distinct()
    again = keyed.where(f"top <= 2 or bottom <= {EDGE}").join(near, ["scan_id", "edge_key", "page_no"], "left_semi")
    return own.select("ocr_id", "line_no").unionByName(again.select("ocr_id", "line_no")).distinct()


class Line(NamedTuple):
    number: int
    text: str
    words: list[tuple[int, int]]


def text_lines(text: str | None, running: set[int]) -> list[Line]:
    """The lines of a page's text, with the places of their words."""
    if not text:
        return []
    return [Line(k, x, [m.span() for m in _TOKEN.finditer(x)]) for k, x in enumerate(text.split("\n"), 1) if k not in running and x.strip()]


def _broken(line: str) -> str | None:
    """The last word of a line that ends in a hyphen, without it."""
    end = line.rstrip()
    if len(end) < 3 or end[-1] not in HYPHENS or not (end[-2].isalnum() or end[-2] in "@("):
        return None
    return end.rsplit(None, 1)[-1].rstrip(HYPHENS)


def core(token: str) -> str:
    return _CORE.match(token).group(1)


SUMMARY = "ocr_id long, scan_id long, page_no int, first_line int, first_word string, first_lower boolean, second_lower boolean, last_open boolean, title_like boolean, last_line string"


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for ocr, scan, page, text, running in zip(batch["ocr_id"], batch["scan_id"], batch["page_no"], batch["text"], batch["running"]):
            lines = text_lines(text, set(running) if running is not None else set())
            if not lines:
                continue
            first = lines[0].text.strip()
            second = lines[1].text.strip() if len(lines) > 1 else ""
            last = lines[-1].text.rstrip()
            widest = max(len(x.text) for x in lines)
            alone = not any(n < lines[0].number for n in (running if running is not None else ()))
            title = alone and len(first) < 0.75 * widest and first[:1].isupper() and not re.search(r"[.!?;,]\s|[.,;:!?\-‐\u00ad¬]$", first)
            rows.append((ocr, scan, page, lines[0].number, first.split()[0], first[:1].islower(), second[:1].islower(), not re.search(r"[.!?:…][\"”»)]*$", last), title, last))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMMARY.split(", ")])


def _with_running(pages: DataFrame, running: DataFrame) -> DataFrame:
    return pages.join(running.groupBy("ocr_id").agg(F.collect_list("line_no").alias("running")), "ocr_id", "left")


def interrupting(pages: DataFrame, running: DataFrame) -> DataFrame:
    """(ocr_id, line_no) of short first lines that stand between the two parts of a sentence: the page before ends in
    mid sentence, this line looks like a title, and the next goes on in lower case."""
    own = _with_running(pages.select("ocr_id", "scan_id", "page_no", "text"), running).mapInPandas(_summaries, SUMMARY)
    before = own.groupBy("scan_id", (F.col("page_no") + 1).alias("page_no")).agg(F.min_by("last_open", "ocr_id").alias("before_open"))
    return own.join(before, ["scan_id", "page_no"]).where("before_open and title_like and second_lower").select("ocr_id", F.col("first_line").alias("line_no"), "first_word")


COUNTS = "kind int, one string, two string, n long"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words (1), pairs of words (2) and the words at either side of a hyphen within a line (3)."""
    for batch in batches:
        words, pairs, hyphened = Counter(), Counter(), Counter()
        for text, running in zip(batch["text"], batch["running"]):
            lines = text_lines(text, set(running) if running is not None else set())
            before, carry = "", ""
            for at, line in enumerate(lines):
                tokens = [line.text[a:b] for a, b in line.words]
                if carry:
                    tokens[0] = carry + tokens[0]
                carry = ""
                if at + 1 < len(lines) and (part := _broken(line.text)) is not None:
                    carry, tokens = part, tokens[:-1]
                for token in tokens:
                    word = model_word(token)
                    if not word:
                        continue
                    words[word] += 1
                    if before:
                        pairs[before, word] += 1
                    before = word
                    if "-" in word and not carry:
                        hyphened[word.split("-", 1)[0]] += 1
        rows = [(1, w, "", n) for w, n in words.items()] + [(2, a, b, n) for (a, b), n in pairs.items()] + [(3, w, "", n) for w, n in hyphened.items()]
        yield pd.DataFrame(rows, columns=["kind", "one", "two", "n"])


@lru_cache(maxsize=200_000)
def model_word(token: str) -> str:
    """A word in the form in which it is counted: without outer signs, figures as 0."""
    word = core(token)
    return re.sub(r"\d+(?:[.,]\d+)*", "0", word) if word.replace(".", "").replace(",", "").isdigit() else word


class ScanModel:
    """Words, pairs and confusion probabilities of the corpus. ``lower`` holds words by their lower case."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int], hyphened: dict[str, int], total: int):
        self.words, self.pairs, self.hyphened, self.total = words, pairs, hyphened, max(total, 1)
        self.rare = max(2, self.total * RARE_SHARE)
        self.lower: dict[str, int] = {}
        for w, n in words.items():
            self.lower[w.lower()] = self.lower.get(w.lower(), 0) + n
        self.sorted = sorted(self.lower)
        #: Occurrences of the words before each one of ``sorted``, those with a hyphen left out.
        self.sums = [0, *accumulate(0 if "-" in w else self.lower[w] for w in self.sorted)]
        self.log_confusion = self._learn()
        self.memory: dict[str, list[tuple[str, float]]] = {}
        self.genuine: dict[str, float] = {}

    def _learn(self) -> dict[tuple[str, str], float]:
        """Confusion probabilities: how often each confusion explains a rare word by one much more frequent, per
        occurrence of what was printed."""
        seen = dict.fromkeys(CONFUSIONS, 0.05)
        printed: Counter = Counter()
        for word, n in self.words.items():
            for read, true in CONFUSIONS:
                if true in word:
                    printed[true] += n * word.count(true)
        for word, n in self.words.items():
            if not any(c.isalpha() for c in word):
                continue
            best = None
            for made, edits in self.variants(word, 1):
                other = self.words.get(made, 0)
                if other > max(20 * n, 8) and (best is None or other > best[0]):
                    best = (other, edits)
            if best is not None:
                for edit in best[1]:
                    seen[edit] += n
        return {c: math.log(min(0.2, max(seen[c] / (printed[c[1]] + 50), 1e-6))) for c in CONFUSIONS}

    def known(self, word: str) -> int:
        """Occurrences of a word, at a line's beginning or in capitals too."""
        n = self.words.get(word, 0)
        if word[:1].isupper():
            n = max(n, self.words.get(word.lower(), 0), self.words.get(word.capitalize(), 0) if word.isupper() else 0)
        else:
            n = max(n, self.words.get(word.capitalize(), 0))
        return n

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """(word, log channel) of what may have been printed; the word itself first."""
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
                self.genuine.clear()
            own = self.known(word)
            found = [(word, 0.0)]
            noise = 0.0
            for made, edits in self.variants(word, MOST_EDITS if own <= self.rare and not word.isdigit() else 1):
                if self.known(made) >= max(2, LEAST_RATIO * own if own > 2 else 2 * own + 1):
                    channel = sum(self.log_confusion[e] for e in edits)
                    found.append((made, channel))
                    noise += self.known(made) * math.exp(channel)
            if len(found) > 1:
                # what misreading of other words leaves of the word's own count, without this occurrence
                self.genuine[word] = max(0.02, own - 1 - NOISE_SHARE * noise)
            self.memory[word] = found
        return found

    def beginning(self, part: str) -> int:
        """Occurrences of longer words without a hyphen that begin with this part: a stretch of the sorted words."""
        low = part.lower()
        start = bisect_left(self.sorted, low)
        end = bisect_left(self.sorted, low + "\U0010ffff", start)
        own = 0 if "-" in low else self.lower.get(low, 0)
        return self.sums[end] - self.sums[start] - own

    def variants(self, word: str, most: int) -> list[tuple[str, tuple[tuple[str, str], ...]]]:
        """The words of the corpus, in any case, that could have been printed if up to ``most`` confusions of separate
        places made this word. Only beginnings that some word has are followed, so no word is too long."""
        found: dict[str, tuple] = {}
        size, words = len(word), self.sorted
        stack: list[tuple[int, str, tuple]] = [(0, "", ())]
        while stack:
            at, made, edits = stack.pop()
            if at == size:
                if edits and made != word and made.lower() in self.lower and (made not in found or len(edits) < len(found[made])):
                    found[made] = edits
                continue
            steps = [(at + 1, word[at], None)]
            if len(edits) < most:
                steps += [(at + len(c[0]), c[1], c) for c in _BY_FIRST.get(word[at], ()) if word.startswith(c[0], at)]
            for to, piece, edit in steps:
                longer = made + piece
                low = longer.lower()
                k = bisect_left(words, low)
                if k < len(words) and words[k].startswith(low):
                    stack.append((to, longer, edits if edit is None else (*edits, edit)))
        return list(found.items())

    def transition(self, before: str, word: str) -> float:
        n = self.genuine.get(word)
        if n is None:
            n = self.known(word)
        single = (n + 0.02) / (self.total + 1)
        if not before:
            return math.log(single)
        first = self.words.get(before, 0)
        pair = self.pairs.get((before, word), 0) if n >= 1 else 0
        return math.log(0.8 * pair / first + 0.2 * single) if first else math.log(single)

    def decode(self, words: list[str], rate: float) -> list[str]:
        """The most likely printed words of a line: Viterbi over the candidates. ``rate`` scales the confusions."""
        columns = []
        for word in words:
            columns.append(self.candidates(word) if word and any(c.isalpha() or c in "@(" for c in word) else [(word, 0.0)])
        if all(len(c) == 1 for c in columns):
            return words
        scale = math.log(max(rate, 0.02))
        best = [(self.transition("", _figures(w)) + channel + (scale if w != words[0] else 0.0), (w,)) for w, channel in columns[0]]
        for at in range(1, len(words)):
            reached = []
            for w, channel in columns[at]:
                form = _figures(w)
                cost = channel + (scale if w != words[at] else 0.0)
                score, path = max(((s + self.transition(_figures(p[-1]), form), p) for s, p in best), key=lambda x: x[0])
                reached.append((score + cost, (*path, w)))
            best = reached
        return list(max(best, key=lambda x: x[0])[1])


def _figures(word: str) -> str:
    return "0" if word and word.replace(".", "").replace(",", "").isdigit() else word


_FIGURE_NOISE = re.compile(r"(?=.*\d)[\dOolISBZGgqbs@|!]+(?:[.,][\dOolISBZGgqbs@|!]+)*$")


def shape_misread(word: str, model: ScanModel) -> bool:
    """Whether a word without a candidate shows by its signs that it was misread."""
    if not word or word.replace(".", "").replace(",", "").isdigit() or model.known(word) > model.rare:
        return False
    if _FIGURE_NOISE.match(word):
        return True
    inner = word.strip("()")
    return bool(re.search(r"[^\W\d_][@(|!][^\W\d_]|[@(|!][^\W\d_]{2}|[^\W\d_]{2}[@|]", word) or re.search(r"[^\W\d_]\d[^\W\d_]|^\d[^\W\d_]{3,}$|[^\W\d_]{3,}\d$", inner))


class PageReader:
    """Reads one page after another with one model."""

    def __init__(self, model: ScanModel, rates: dict[int, float]):
        self.model, self.rates = model, rates

    def rate(self, confidence: float | None) -> float:
        return self.rates.get(confidence_band(confidence), self.rates[-1])

    def split(self, line: str, following: str | None) -> bool:
        """Whether the hyphen at a line's end breaks a word. ``following`` is the next word, None when it is missing."""
        part = _broken(line)
        if part is None:
            return False
        left = core(part)
        if not left:
            return False
        stem = left.rsplit("-", 1)[-1]
        if following is None:
            compounds = self.model.hyphened.get(left, 0)
            return compounds < 2 or compounds < self.model.beginning(left)
        right = core(following.rstrip(HYPHENS)) or following
        whole, joined = self._best(left + "-" + right), self._best(left + right)
        if whole == joined == 0 and stem != left:
            joined = self._best(stem + right)
        if whole > joined:
            return False
        if joined == 0 and whole == 0:
            return not (self.model.hyphened.get(left, 0) >= 2 and self.model.known(right) > 2)
        return True

    def _best(self, word: str) -> int:
        found = self.model.lower.get(word.lower(), 0)
        if found:
            return found
        return max((self.model.lower.get(w.lower(), 0) for w, _ in self.model.candidates(word)), default=0)

    def read(self, lines: list[Line], confidence: float | None, after: str | None, before: str | None = None) -> tuple[list[tuple[int, str]], list[str]]:
        """((line, kind), corrected lines). A broken word is judged as a whole; its errors belong to the line where
        they stand. ``after`` is the first word of the next page, None when that page is missing or has none."""
        rate = self.rate(confidence)
        found: list[tuple[int, str]] = []
        fixed: list[str] = []
        head = 0  # letters of the first word that stand on the line before
        carried = ""
        if lines and before and self.split(before, lines[0].text.split()[0]):
            carried = core(_broken(before))
        for at, line in enumerate(lines):
            tokens = [line.text[a:b] for a, b in line.words]
            following = lines[at + 1].text.split()[0] if at + 1 < len(lines) else after
            broken = self.split(line.text, following)
            head, own_head = len(carried), carried
            words = [core(t) for t in tokens]
            if own_head:
                words[0] = own_head + words[0]
            tail = 0
            if broken:
                left = core(_broken(line.text))
                base = (own_head + left) if own_head and len(tokens) == 1 else left
                if following is not None:
                    words[-1] = base + core(following.rstrip(HYPHENS) if at + 1 < len(lines) else following)
                else:
                    words[-1] = base
                tail = len(base)
            decoded = self.model.decode(words, rate)
            wrong = False
            for k, (word, true) in enumerate(zip(words, decoded)):
                if broken and k == len(words) - 1 and following is None and not self.model.known(word):
                    wrong |= _odd(word)
                    continue
                bad = word != true
                if not bad and shape_misread(word, self.model):
                    bad, true = True, word
                    places = [i for i, c in enumerate(word) if not c.isalpha()] if not _FIGURE_NOISE.match(word) else [i for i, c in enumerate(word) if not c.isdigit()]
                elif bad:
                    places = _differences(word, true)
                if not bad:
                    continue
                low = head if k == 0 else 0
                high = tail if broken and k == len(words) - 1 else len(word)
                wrong |= any(low <= p < high for p in places)
            if wrong:
                found.append((line.number, "misread"))
            if broken:
                found.append((line.number, "split"))
            fixed.append(self._rebuild(line, tokens, words, decoded, own_head, broken, following))
            carried = (core(_broken(line.text)) if not (own_head and len(tokens) == 1) else own_head + core(_broken(line.text))) if broken and at + 1 < len(lines) else ""
        return found, fixed

    @staticmethod
    def _rebuild(line: Line, tokens: list[str], words: list[str], decoded: list[str], head: str, broken: bool, following: str | None) -> str:
        """The line with its words corrected. A broken word stands whole on its first line; a word that began on the
        line before is left out."""
        out = []
        for k, (token, word, true) in enumerate(zip(tokens, words, decoded)):
            if k == 0 and head:
                rest = token[len(core(token)) + token.find(core(token)) :] if core(token) else ""
                if len(tokens) == 1 and broken:
                    continue
                if rest:
                    out.append("\x00" + rest)
                continue
            if broken and k == len(tokens) - 1:
                out.append(token[: token.find(core(token))] + true if core(token) else true)
            else:
                own = core(token)
                out.append(token.replace(own, true, 1) if own and own != true else token)
        return " ".join(out)


def _odd(word: str) -> bool:
    return bool(re.search(r"[^\W\d_][@(|!\d]|[@(|!\d][^\W\d_]", word))


def _differences(read: str, true: str) -> list[int]:
    """The places of the read word that differ from what was printed."""
    start = 0
    while start < min(len(read), len(true)) and read[start] == true[start]:
        start += 1
    end = 0
    while end < min(len(read), len(true)) - start and read[-1 - end] == true[-1 - end]:
        end += 1
    if len(read) == len(true):
        return [i for i in range(len(read)) if read[i] != true[i]]
    return list(range(start, max(start + 1, len(read) - end)))


def confidence_band(confidence: float | None) -> int:
    """Tenths of a confidence between 0 and 1; -1 for none."""
    if confidence is None or confidence != confidence:
        return -1
    value = confidence / 100 if confidence > 1 else confidence
    return min(9, max(0, int(value * 10)))


def scan_model(pages: DataFrame) -> ScanModel:
    """The corpus's words and pairs of words. What every executor gets is bounded by LEAST_SHARE."""
    counted = materialise(pages.select("text", "running").mapInPandas(_counted, COUNTS).groupBy("kind", "one", "two").agg(F.sum("n").alias("n")), "scan-words")
    total = counted.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    least = max(2, math.ceil(total * LEAST_SHARE))
    kept = counted.where((F.col("n") >= least) | ((F.col("kind") == 1) & (F.col("n") >= max(1, total * LEAST_SHARE))))
    words: dict[str, int] = {}
    pairs: dict[tuple[str, str], int] = {}
    hyphened: dict[str, int] = {}
    for row in kept.toLocalIterator():
        if row["kind"] == 1:
            words[row["one"]] = row["n"]
        elif row["kind"] == 2:
            pairs[row["one"], row["two"]] = row["n"]
        else:
            hyphened[row["one"]] = row["n"]
    return ScanModel(words, pairs, hyphened, total)


def _rates(pages: DataFrame, model: ScanModel) -> dict[int, float]:
    """By band of confidence, the share of words that are rare and explained by a confusion, over that of all pages."""
    schema = "band int, n long, wrong long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen, wrong = Counter(), Counter()
            for text, confidence in zip(batch["text"], batch["confidence"]):
                band = confidence_band(confidence)
                for token in (text or "").split():
                    word = core(token)
                    if len(word) < 3:
                        continue
                    seen[band] += 1
                    if model.known(word) <= model.rare and len(model.candidates(word)) > 1:
                        wrong[band] += 1
            yield pd.DataFrame([(b, n, wrong[b]) for b, n in seen.items()], columns=["band", "n", "wrong"])

    rows = pages.select("text", "confidence").mapInPandas(run, schema).groupBy("band").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong")).collect()  # eleven rows at most
    n, wrong = sum(r["n"] for r in rows), sum(r["wrong"] for r in rows)
    mean = (wrong + 1) / (n + 100)
    rates = {r["band"]: min(3.0, max(0.05, ((r["wrong"] + 100 * mean) / (r["n"] + 100)) / mean)) for r in rows}
    return {-1: 1.0} | rates


class Prepared(NamedTuple):
    pages: DataFrame
    running: DataFrame
    reader: PageReader


def prepare(pages: DataFrame) -> Prepared:
    """Running lines, the model, and each page with its running lines and its neighbours' words."""
    source = pages.select("ocr_id", "scan_id", "page_no", "text", "confidence")
    running = materialise(running_lines(source), "running")
    more = interrupting(source, running).select("ocr_id", "line_no")
    running = materialise(running.unionByName(more).distinct(), "running")
    own = materialise(_with_running(source, running), "scan-pages")
    summary = materialise(own.select("ocr_id", "scan_id", "page_no", "text", "running").mapInPandas(_summaries, SUMMARY), "scan-summaries")
    after = summary.groupBy("scan_id", (F.col("page_no") - 1).alias("page_no")).agg(F.min_by("first_word", "ocr_id").alias("after_word"), F.min_by("first_lower", "ocr_id").alias("after_lower"))
    before = summary.groupBy("scan_id", (F.col("page_no") + 1).alias("page_no")).agg(F.min_by("last_line", "ocr_id").alias("before_line"))
    joined = materialise(own.join(after, ["scan_id", "page_no"], "left").join(before, ["scan_id", "page_no"], "left"), "scan-neighbours")
    model = scan_model(joined)
    return Prepared(joined, running, PageReader(model, _rates(joined, model)))


def page_findings(prepared: Prepared) -> DataFrame:
    """(ocr_id, line_no, kind)."""
    reader = prepared.reader

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ocr, text, running, confidence, after, before in zip(batch["ocr_id"], batch["text"], batch["running"], batch["confidence"], batch["after_word"], batch["before_line"]):
                lines = text_lines(text, set(running) if running is not None else set())
                rows += [(ocr, n, kind) for n, kind in reader.read(lines, confidence, after if isinstance(after, str) else None, before if isinstance(before, str) else None)[0]]
            yield pd.DataFrame(rows, columns=["ocr_id", "line_no", "kind"])

    found = prepared.pages.select("ocr_id", "text", "running", "confidence", "after_word", "before_line").mapInPandas(run, "ocr_id long, line_no int, kind string")
    return found.unionByName(prepared.running.select("ocr_id", "line_no", F.lit("running").alias("kind")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return page_findings(prepare(table(spark, folder, "ocr_results")))


PARTS = "scan_id long, page_no int, part int, last boolean, goes_on boolean, text string"


def paragraphs(pages: DataFrame) -> DataFrame:
    """(scan_id, page_no, part, text): the continuous paragraphs of each scan, by the page and place where they begin.
    Parts of a paragraph on following pages are found by pointers that double their reach, so that no task takes a
    whole scan."""
    prepared = prepare(pages)
    reader = prepared.reader

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for scan, page, text, running, confidence, after, lower, before in zip(batch["scan_id"], batch["page_no"], batch["text"], batch["running"], batch["confidence"], batch["after_word"], batch["after_lower"], batch["before_line"]):
                lines = text_lines(text, set(running) if running is not None else set())
                if not lines:
                    continue
                after = after if isinstance(after, str) else None
                _, fixed = reader.read(lines, confidence, after, before if isinstance(before, str) else None)
                made: list[str] = []
                for at, (line, good) in enumerate(zip(lines, fixed)):
                    fresh = at == 0 or line.number > lines[at - 1].number + 1 or (line.text[:2] == "  " and re.search(r"[.!?:]\s*$", lines[at - 1].text)) or re.match(r"\s*(?:[-*•]|\d+[.)]) ", line.text)
                    if good.startswith("\x00") and (made or at == 0):
                        made[-1:] = [(made[-1] if made else "") + good[1:].rstrip()]
                    elif fresh or not made:
                        made.append(good.strip())
                    elif good.strip():
                        made[-1] = (made[-1] + " " + good.strip()).strip()
                made = [m.replace(" \x00", "").replace("\x00", "") for m in made if m.strip("\x00 ")]
                open_end = not re.search(r"[.!?:…][\"”»)]*$", lines[-1].text.rstrip()) and after is not None and (bool(lower) or _broken(lines[-1].text) is not None)
                rows += [(scan, page, k, k == len(made), k == len(made) and open_end, m) for k, m in enumerate(made, 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    first = prepared.pages.groupBy("scan_id", "page_no").agg(F.min("ocr_id").alias("ocr_id"))
    source = prepared.pages.join(first.select("ocr_id"), "ocr_id", "left_semi")
    parts = materialise(source.select("scan_id", "page_no", "text", "running", "confidence", "after_word", "after_lower", "before_line").mapInPandas(run, PARTS), "scan-parts")
    link = parts.where("goes_on").select("scan_id", (F.col("page_no") + 1).alias("page_no"), F.lit(1).alias("part"), F.col("page_no").alias("root_page"), F.col("part").alias("root_part"))
    link = materialise(link, "scan-links")
    while True:
        up = link.select("scan_id", F.col("page_no").alias("root_page"), F.col("part").alias("root_part"), F.col("root_page").alias("p"), F.col("root_part").alias("q"))
        step = link.join(up, ["scan_id", "root_page", "root_part"], "left")
        if step.where("p is not null").isEmpty():
            break
        link = materialise(step.select("scan_id", "page_no", "part", F.coalesce("p", "root_page").alias("root_page"), F.coalesce("q", "root_part").alias("root_part")), "scan-links")
    rooted = parts.join(link, ["scan_id", "page_no", "part"], "left").select("scan_id", F.coalesce("root_page", "page_no").alias("root_page"), F.coalesce("root_part", "part").alias("root_part"), "page_no", "part", "text")
    whole = rooted.groupBy("scan_id", "root_page", "root_part").agg(F.array_sort(F.collect_list(F.struct("page_no", "part", "text"))).alias("parts"))
    return whole.select("scan_id", F.col("root_page").alias("page_no"), F.col("root_part").alias("part"), F.array_join(F.col("parts.text"), " ").alias("text"))


def p2_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs(table(spark, folder, "ocr_results"))
