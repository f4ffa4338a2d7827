"""Leaf blocks of a text value in Markdown, HTML, wiki text, LaTeX or plain text, or in a mixture of them.

``scan`` reads the lines once and gives each block's form (how it is marked), its lines and its text. It decides
nothing that needs context: one form, such as ``hash1``, may be a heading in one language and a list item in another.

Defined cases: null and empty texts have no blocks; a code block that is never closed ends with the text; very long
lines are single blocks; nothing is cut off.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple


class Block(NamedTuple):
    form: str
    start: int
    end: int
    text: str


CODE_FORMS = frozenset(("fence", "pre", "wikicode", "verbatim"))
_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})\s*([^`\s]*)[^`]*$")
_ENVIRONMENT = re.compile(r"\s*\\begin\{(verbatim|Verbatim|lstlisting|minted|alltt)\*?\}")
_MATH_ENVIRONMENT = re.compile(r"\s*\\begin\{(equation|align|gather|displaymath|eqnarray|multline|math)(\*?)\}")
_TAGGED_CODE = re.compile(r"<(pre|syntaxhighlight|source)\b[^>]*>", re.IGNORECASE)
_ATX = re.compile(r"\s{0,3}(#{1,6})(\s+|$)(.*?)(?:\s+#+)?\s*$")
_SETEXT = re.compile(r"\s{0,3}(=+|-{2,})\s*$")
_WIKI_HEADING = re.compile(r"(={1,6})\s*([^=\s](?:.*[^=\s])?)\s*\1\s*$")
_TEX_HEADING = re.compile(r"\s*\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]]*\])?\{(.*?)\}?\s*$")
_HTML_HEADING = re.compile(r"<h([1-6])\b[^>]*>(.*?)(?:</h\1\s*>|$)", re.IGNORECASE)
_BULLET = re.compile(r"(\s*)([-+*])\s+(\S.*)$")
_NUMBERED = re.compile(r"(\s*)(\d{1,9})[.)]\s+(\S.*)$")
_WIKI_ITEM = re.compile(r"([*#]{2,})\s+(\S.*)$|([*#])([^*#\s].*)$")
_TEX_ITEM = re.compile(r"\s*\\item\b\s*(?:\[[^\]]*\])?(.*)$")
_HTML_ITEM = re.compile(r"<li\b[^>]*>", re.IGNORECASE)
_QUOTE = re.compile(r"\s{0,3}>+ ?")
_CONTAINER = re.compile(r"\s*(?:</?(?:ul|ol|div|nav|aside|footer|header|main|section|article|body|html|table|tr|blockquote|p|dl)\b[^>]*>\s*)+$|\s*\\(?:begin|end)\{[a-zA-Z*]+\}(?:\[[^\]]*\])?\s*$", re.IGNORECASE)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->")
_BLANK = frozenset(" \t\r\f\v\xa0")

#: Inline code, in every language; what stands inside is no element.
INLINE_CODE = re.compile(
    r"(?<!`)(`+)(?!`)(?:.*?[^`])??\1(?!`)|<(code|tt|kbd|samp|nowiki)\b[^>]*>.*?</\2\s*>|\\texttt\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|\\verb\*?([^\sa-zA-Z*]).*?\3|\\lstinline\{[^{}]*\}",
    re.IGNORECASE,
)
#: Formulas within a line. An amount such as $5 is none: the closing sign follows no blank and precedes no digit.
INLINE_FORMULA = re.compile(
    r"\$\$(?=[^$\s]|\s*[^$\s])[^$]+\$\$|(?<![\\$\w])\$(?![\s$])(?:[^$\\\n]|\\.)*?(?<!\s)\$(?![\d$])|\\\((?:.|\n)+?\\\)|\\\[(?:.|\n)+?\\\]|<math\b[^>]*>.*?</math\s*>|<script\b[^>]*math/tex[^>]*>.*?</script\s*>",
    re.IGNORECASE,
)


def blank(line: str) -> bool:
    return not line or line.isspace()


def scan(text: str | None) -> list[Block]:
    """The leaf blocks of ``text`` in order; ``start`` and ``end`` are its lines, counted from 0, ``end`` excluded."""
    if not text:
        return []
    lines = text.split("\n")
    blocks: list[Block] = []
    add, at, total = blocks.append, 0, len(lines)
    while at < total:
        line = lines[at]
        bare = line.lstrip()
        if not bare:
            at += 1
            continue
        first = bare[0]
        if first in "`~" and (found := _FENCE.match(line)):
            mark, end = found.group(1), at + 1
            while end < total:
                closing = lines[end].strip()
                if closing[:1] == mark[0] and len(closing) >= len(mark) and not closing.strip(mark[0]):
                    break
                end += 1
            add(Block("fence", at, min(end + 1, total), "\n".join(lines[at + 1 : end])))
            at = min(end + 1, total)
            continue
        if first == "\\":
            if found := _ENVIRONMENT.match(line):
                at = _until(lines, at, "\\end{" + found.group(1), "verbatim", add)
                continue
            if found := _MATH_ENVIRONMENT.match(line):
                at = _until(lines, at, "\\end{" + found.group(1), "display", add)
                continue
            if bare.startswith("\\["):
                if "\\]" not in line:
                    at = _until(lines, at, "\\]", "display", add)
                    continue
                if bare.rstrip().endswith("\\]") and bare.count("\\]") == 1:
                    add(Block("display", at, at + 1, bare))
                    at += 1
                    continue
            if found := _TEX_HEADING.match(line):
                add(Block("texheading", at, at + 1, found.group(1)))
                at += 1
                continue
            if found := _TEX_ITEM.match(line):
                add(Block("texitem", at, at + 1, found.group(1)))
                at += 1
                continue
        elif first == "$" and bare.startswith("$$"):
            rest = bare.rstrip()
            if rest == "$$" or "$$" not in rest[2:]:
                end = at + 1
                while end < total and "$$" not in lines[end]:
                    end += 1
                add(Block("display", at, min(end + 1, total), "\n".join(lines[at : end + 1])))
                at = min(end + 1, total)
                continue
            if rest.endswith("$$") and rest.count("$$") == 2:
                add(Block("display", at, at + 1, rest))
                at += 1
                continue
        elif first == "#":
            if found := _ATX.match(line):
                add(Block("hash1" if len(found.group(1)) == 1 else "hash2", at, at + 1, found.group(3)))
                at += 1
                continue
            if found := _WIKI_ITEM.match(line):
                add(Block("wikihash", at, at + 1, found.group(2) or found.group(4)))
                at += 1
                continue
        elif first == "=" and (found := _WIKI_HEADING.match(line)):
            add(Block("wikiheading", at, at + 1, found.group(2)))
            at += 1
            continue
        elif first in "-+*":
            if found := _BULLET.match(line):
                add(Block("bullet", at, at + 1, found.group(3)))
                at += 1
                continue
            if first == "*" and bare[1:2] == "*" and (found := _WIKI_ITEM.match(line)) and found.group(1):
                add(Block("wikistars", at, at + 1, found.group(2)))
                at += 1
                continue
            if len(set(bare.strip().replace(" ", ""))) == 1 and len(bare.strip()) > 2:
                add(Block("rule", at, at + 1, bare))
                at += 1
                continue
        elif first.isdigit() and (found := _NUMBERED.match(line)):
            add(Block("numbered", at, at + 1, found.group(3)))
            at += 1
            continue
        elif first == ">":
            end = at
            inner = []
            while end < total and (found := _QUOTE.match(lines[end])):
                inner.append(lines[end][found.end() :])
                end += 1
            add(Block("quote", at, end, "\n".join(inner)))
            at = end
            continue
        elif first == "<":
            if found := _TAGGED_CODE.match(bare):
                closing = "</" + found.group(1).lower()
                at = _until(lines, at, closing, "pre" if found.group(1).lower() == "pre" else "wikicode", add, fold=True)
                continue
            if found := _HTML_HEADING.match(bare):
                add(Block("htmlheading", at, at + 1, found.group(2)))
                at += 1
                continue
            if re.match(r"<(?:math\b|script\b[^>]*math/tex)", bare, re.IGNORECASE) or re.match(r"<(?:span|div)\b[^>]*math[^>]*>\s*(?:\\\[|\$\$|\\begin)", bare, re.IGNORECASE):
                add(Block("display", at, at + 1, bare))
                at += 1
                continue
            if _CONTAINER.match(line) and not _HTML_ITEM.search(line):
                add(Block("container", at, at + 1, bare))
                at += 1
                continue
        if "<li" in line or "<LI" in line:
            cuts = [m.start() for m in _HTML_ITEM.finditer(line)] + [len(line)]
            if head := line[: cuts[0]].strip():
                add(Block("container" if _CONTAINER.match(head) else "paragraph", at, at + 1, head))
            for one, two in zip(cuts, cuts[1:]):
                add(Block("htmlitem", at, at + 1, line[one:two]))
            at += 1
            continue
        if at + 1 < total and lines[at + 1][:1] in "=- " and (found := _SETEXT.match(lines[at + 1])) and first not in "|<":
            add(Block("setext", at, at + 2, bare.rstrip()))
            at += 2
            continue
        add(Block("paragraph", at, at + 1, line))
        at += 1
    return blocks


def _until(lines: list[str], at: int, closing: str, form: str, add, fold: bool = False) -> int:
    """Adds the block from line ``at`` to the line with ``closing``, or to the end; gives the line after it."""
    end, total = at, len(lines)
    while end < total and closing not in (lines[end].lower() if fold else lines[end]):
        end += 1
    add(Block(form, at, min(end + 1, total), "\n".join(lines[at : end + 1])))
    return min(end + 1, total)


_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]|\[https?://\S+\s+([^\]]*)\]")
_REFERENCE = re.compile(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>|\[\^[^\]\s]+\]|~?\\(?:cite|label|ref|footnote)\w*\{[^{}]*\}")
_TEX_WRAP = re.compile(r"\\(?:emph|textbf|textit|texttt|underline|textsc)\{([^{}]*)\}|\\href\{[^{}]*\}\{([^{}]*)\}|\\(?:url)\{([^{}]*)\}")
_EMPHASIS = re.compile(r"(?=['*_`])(?:'{2,5}|(?<![\w*])\*{1,3}(?=\S)|(?<=\S)\*{1,3}(?![\w*])|(?<![\w])_{1,3}(?=\S)|(?<=\S)_{1,3}(?![\w])|`+)")
_ACTIVE = re.compile(r"[\[\\<&*_`']")


def visible(text: str) -> str:
    """What a reader sees of a piece of marked text: links, emphasis, references and tags resolved."""
    if not _ACTIVE.search(text):
        return text.strip()
    if "<ref" in text or "[^" in text or "\\" in text:
        text = _REFERENCE.sub("", text)
    if "[" in text:
        text = _WIKI_LINK.sub(lambda m: m.group(1) or m.group(2) or "", _LINK.sub(r"\1", text))
    if "\\" in text:
        text = _TEX_WRAP.sub(lambda m: m.group(1) or m.group(2) or m.group(3) or "", text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "*" in text or "`" in text or "_" in text or "''" in text:
        text = _EMPHASIS.sub("", text)
    if "&" in text:
        text = unescape(text)
    return text.strip()
