"""Functions on one Markdown text whose steps depend on each other, for use in Arrow batches.

All take and give a text; they leave a text without anything to mend as it is.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter


def mend_images(text: str) -> str:
    """Doubled alternative texts, images without a path and brackets too many at the end of an image."""
    text = re.sub(r"!\[[^\]]*\](?=!\[[^\]]*\]\()", "", text)
    text = re.sub(r"!\[[^\]]*\]\((?:\.?[\w./-]*assets/)?\)\s*\n?", "", text)
    return _drop_surplus_brackets(text)


def _drop_surplus_brackets(text: str) -> str:
    """Closing brackets behind an image that close nothing are left out; a path may hold balanced ones."""
    out, at = [], 0
    for found in re.finditer(r"!\[[^\]]*\]\(", text):
        if found.start() < at:
            continue
        depth, end = 1, found.end()
        while end < len(text) and depth and text[end] != "\n":
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        if depth:
            continue
        out.append(text[at:end])
        before = text[: found.start()].rsplit("\n", 1)[-1]
        spare = max(0, before.count("(") - before.count(")"))
        while end < len(text) and text[end] == ")":
            if spare:
                out.append(")")
                spare -= 1
            end += 1
        at = end
    return "".join(out) + text[at:]


def mend_links(text: str) -> str:
    """Links whose label runs over several lines keep its first one."""
    while True:
        made = re.sub(r"\[([^\]\n]*?)\n+[^\]]*?\]\(([^)]+)\)", lambda m: f"[{m.group(1).strip()}]({m.group(2)})", text)
        if made == text:
            return text
        text = made


def first_tellings(said: list[str | None], least: int) -> list[bool]:
    """For each entry whether it says something new: it neither stands in one that was kept nor holds one. Nulls always
    do. Kept ones are searched as one text, and are known by their first ``least`` characters, which are looked up at each
    place of an entry."""
    told, known = "", {}
    new = []
    for one in said:
        if one is None:
            new.append(True)
            continue
        holds = any(one.startswith(k, at) for at in range(len(one) - least + 1) for k in known.get(one[at : at + least], ()))
        new.append(not holds and one not in told)
        if new[-1]:
            told += one + "\n"
            known.setdefault(one[:least], []).append(one)
    return new


def repeated_tail_at(text: str, least_unit: int = 20, least_repeats: int = 4, least_lines: int = 6) -> int | None:
    """Where the superfluous part of a text begins that ends in the same line six times or more, or in the same stretch
    of 20 characters or more four times or more; None when it does not."""
    lines = text.split("\n")
    full = [k for k, x in enumerate(lines) if x.strip()]
    run = 0
    while run < len(full) and lines[full[-1 - run]].strip() == lines[full[-1]].strip():
        run += 1
    if run >= least_lines:
        return sum(len(x) + 1 for x in lines[: full[-run] + 1]) - 1
    back = text[::-1]
    border = [0] * len(back)
    for at in range(1, len(back)):
        k = border[at - 1]
        while k and back[at] != back[k]:
            k = border[k - 1]
        border[at] = k + (back[at] == back[k])
    for size in range(len(back), least_unit * least_repeats - 1, -1):
        period = size - border[size - 1]
        if period >= least_unit and period * least_repeats <= size:
            return len(text) - size + period
    return None


def cut_repeated_tail(text: str) -> str:
    """The text with one of the repeated units at its end."""
    at = repeated_tail_at(text) if text else None
    return text[:at] if at else text


def repair_json(text: str) -> str | None:
    """A JSON text out of one with fences, words around it, commas too many or brackets too few; None when there is
    none."""
    tried = [text, *(re.findall(r"```(?:json)?\s*\n(.*?)```", text, re.DOTALL))]
    start = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    if start >= 0:
        tried.append(text[start:])
        end = max(text.rfind("}"), text.rfind("]"))
        if end > start:
            tried.append(text[start : end + 1])
    for one in list(tried):
        tried.append(re.sub(r",(\s*[}\]])", r"\1", one))
    for one in list(tried):
        tried.append(_closed(one))
    for one in tried:
        try:
            return json.dumps(json.loads(one), ensure_ascii=False)
        except ValueError:
            continue
    return None


def _closed(text: str) -> str:
    """Open strings, lists and objects closed at the end."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted, escaped = (escaped or c != '"') if c == '"' else True, c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    return re.sub(r",\s*$", "", text.rstrip() + ('"' if quoted else "")) + "".join(reversed(stack))


#: Structural marks that a later stage must not lose, and the kinds of their placeholders.
PROTECTED = (("PAGE", re.compile(r"<!-- Page number: ?\d+ -->")), ("SLIDE", re.compile(r"<!-- Slide (?:number: ?)?\d+ -->")), ("IMAGE", re.compile(r"!\[[^\]]*\]\([^)]+\)")))


def protect(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with its structural marks as numbered placeholders, and what each stands for."""
    kept: list[tuple[str, str]] = []
    for kind, pattern in PROTECTED:
        number = 0

        def hold(found: re.Match) -> str:
            nonlocal number
            number += 1
            kept.append((f"__KEEP_{kind}_{number}__", found.group()))  # noqa: B023
            return kept[-1][0]

        text = pattern.sub(hold, text)
    return text, kept


def unprotect(text: str, kept: list[tuple[str, str]]) -> str:
    """Placeholders as what they stand for. Invented page and slide marks go; lost images come at the end, lost slide
    marks before the heading of their number, lost page marks do not come back."""
    text = re.sub(r"(?m)^[ \t]*<!-- (?:Page|Slide) (?:number: ?)?\d+ -->[ \t]*\n?", "", text)
    lost: list[tuple[str, str]] = []
    for name, what in kept:
        if name not in text:
            lost.append((name, what))
        elif "_IMAGE_" in name:
            text = text.replace(name, what)
        else:
            text = re.sub(r"\n*" + re.escape(name) + r"\n*", lambda _, w=what: f"\n\n{w}\n\n", text)
    text = re.sub(r"__KEEP_[A-Z]+_\d+__", "", text)
    for name, what in lost:
        if "_SLIDE_" in name:
            number = int(re.search(r"_(\d+)__$", name).group(1))
            headings = list(re.finditer(r"(?m)^#{1,2} ", text))
            if number <= len(headings):
                at = headings[number - 1].start()
                text = text[:at] + what + "\n\n" + text[at:]
        elif "_IMAGE_" in name:
            text = text.rstrip() + "\n\n" + what
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def order_kept(places: list[int]) -> float:
    """The share of the pairs that stand in order, 0 to 100; equal places are in order. Pairs out of order are counted by
    insertion into a sorted list."""
    n = len(places)
    if n <= 1:
        return 100.0
    out, seen = 0, []
    for place in places:
        at = bisect_right(seen, place)
        out += len(seen) - at
        seen.insert(at, place)
    return 100 * (1 - out / (n * (n - 1) / 2))


def shared_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, with the rows of the table as bits of one number."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & where.get(c, 0)
        rows = (rows + hit | rows - hit) & full
    return len(a) - rows.bit_count()


def pieces(text: str, size: int) -> dict[str, list[int]]:
    """Where each stretch of ``size`` characters stands in a text."""
    found: dict[str, list[int]] = {}
    for k in range(len(text) - size + 1):
        found.setdefault(text[k : k + size], []).append(k)
    return found


def alignment(block: str, text: str, grams: dict[str, list[int]], size: int) -> tuple[float, int]:
    """The best likeness of the shorter of two texts to a stretch of the longer, 0 to 100, and where it begins in
    ``text``. Stretches are tried where the two share most pieces of ``size`` characters."""
    at = text.find(block)
    if at >= 0:
        return 100.0, at
    if len(block) > len(text):
        return alignment(text, block, pieces(block, size), size)[0], 0
    votes: Counter[int] = Counter()
    for k in range(0, len(block) - size + 1):
        places = grams.get(block[k : k + size], ())
        for place in places:
            votes[max(0, place - k)] += 1.0 / len(places)
    best, begin = 0.0, 0
    for start, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0]))[:TRIED]:
        start = min(start, len(text) - len(block))
        likeness = 200 * shared_length(block, text[start : start + len(block)]) / (2 * len(block))
        if likeness > best:
            best, begin = likeness, start
    return best, begin


#: Stretches tried for a block, those with most shared pieces first.
TRIED = 6
#: Characters of the pieces that texts share.
PIECE = 5


def score_blocks(blocks: list[str], text: str, least: float) -> float:
    """How well a text renders the blocks, 0 to 100; one aligned less than ``least`` counts as missing, at the beginning."""
    if not blocks:
        return 100.0
    if not text:
        return 0.0
    sizes = [min(PIECE, max(1, len(b) // 3)) for b in blocks]
    grams = {size: pieces(text, size) for size in set(sizes)}
    found = [alignment(b, text, grams[size], size) for b, size in zip(blocks, sizes)]
    found = [(s, at) if s >= least else (0.0, 0) for s, at in found]
    match = sum(s * len(b) for (s, _), b in zip(found, blocks)) / sum(map(len, blocks))
    return round(0.8 * match + 0.2 * order_kept([at for _, at in found]), 2)


def drop_prompt_echo(text: str, phrases: tuple[str, ...]) -> str:
    """Without lines that repeat one of the phrases of an instruction, the blank lines and rules above them, and a pair of
    tags around the whole."""
    lines = text.split("\n")
    out: list[str] = []
    for line in lines:
        if any(p.lower() in line.lower() for p in phrases):
            while out and (not out[-1].strip() or out[-1].strip() == "---"):
                out.pop()
            continue
        out.append(line)
    return re.sub(r"\A\s*<(document|content|markdown)>\s*|\s*</(?:document|content|markdown)>\s*\Z", "", "\n".join(out))
