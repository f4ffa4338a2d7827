"""Headings, list items, code blocks and formulas of text in Markdown, HTML, wiki text, LaTeX or a mixture.

A linear-chain CRF over the leaf blocks, with features of the mark, the value's language, the neighbours and the text,
is trained on labelled pages and decoded by Viterbi. It settles marks that mean different things in different
languages, such as ``#``. What stands between two signs of a formula within a line is a leaf of its own; a second chain
over the leaves of a line tells formulas from amounts of money and names of variables, and of two leaves that share a sign
at most one is a formula.

The labelled pages are written out by ``labelled_pages``: known structures set in each of the languages, with the
disturbances of real pages (missing end tags, other languages, rules, code that looks like structure).

Defined cases: null, empty and blank values have no elements; plain text has none; an unclosed code block counts, an
unclosed formula does not; repeated rows get their elements each; very long lines are one block.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .blocks import CODE_FORMS, INLINE_CODE, Block, scan, visible
from .crf import ChainCRF

LABELS = ("other", "heading", "item", "code", "formula")
FIELDS = ("content", "static_content")

_WIKI_SIGNS = re.compile(r"'''?|\[\[|<ref\b|^={1,6}[^=\n]+={1,6}\s*$|<syntaxhighlight|\{\{", re.MULTILINE)
_MARKDOWN_SIGNS = re.compile(r"\]\(|\*\*|`|^#{2,6} |^[-+] |\[\^|^\$\$", re.MULTILINE)
_LATEX_SIGNS = re.compile(r"\\(?:section|subsection|emph|textbf|href|cite|item|begin)\b")
_HTML_SIGNS = re.compile(r"<(?:p|h[1-6]|li|ul|ol|b|em|a|span|div|pre|code|blockquote)\b", re.IGNORECASE)


def language(text: str) -> str:
    """The markup language whose signs lead in a value; plain when there are none."""
    counts = (
        (len(_HTML_SIGNS.findall(text)) if "<" in text else 0, "html"),
        (len(_LATEX_SIGNS.findall(text)) if "\\" in text else 0, "latex"),
        (len(_WIKI_SIGNS.findall(text)) if "''" in text or "[[" in text or "==" in text or "<" in text else 0, "wiki"),
        (len(_MARKDOWN_SIGNS.findall(text)), "markdown"),
    )
    most, name = max(counts)
    return name if most else "plain"


def leaf_keys(blocks: list[Block], tongue: str) -> list[tuple]:
    """What the features of each block are made from, its innermost open element among them; blocks alike in it share their
    evidence."""
    keys, last = [], len(blocks) - 1
    inside: list[str] = []
    for k, (form, start, end, text) in enumerate(blocks):
        if form == "container":
            for closing, name in _CONTAINER_TAG.findall(text):
                name = name.lower()
                if not closing:
                    inside.append(name)
                elif name in inside:
                    del inside[len(inside) - 1 - inside[::-1].index(name) :]
        before, after = blocks[k - 1] if k else None, blocks[k + 1] if k < last else None
        joined = (before is not None and before.form == form and before.end == start) or (after is not None and after.form == form and after.start == end)
        tight = before is not None and before.end == start
        size = len(text)
        extra = ""
        if form == "setext":
            extra = "long" if size > 160 else "short"
        elif form == "numbered":
            extra = "run" if joined else "lone"
        keys.append((form, tongue, joined, tight, size > 90, text[-1:] in (".", ":", ";"), before.form if before else "first", extra, inside[-1] if inside else ""))
    return keys


def leaf_features(key: tuple) -> tuple[str, ...]:
    form, tongue, joined, tight, long, stop, before, extra, inside = key
    return (
        f"form={form}", f"form={form},language={tongue}", f"form={form},joined={joined}", f"form={form},language={tongue},joined={joined}",
        f"form={form},wiki={tongue == 'wiki'},joined={joined}",
        f"tight={tight}", f"form={form},long={long}", f"stop={stop}", f"form={form},before={before}", f"form={form},extra={extra}", f"form={form},inside={inside}",
    )


_CONTAINER_TAG = re.compile(r"<(/?)(\w+)[^>]*>")

_PHRASES = (
    "Opening hours of the reading room", "Wie man ein Archiv ordnet", "Notas sobre el puente viejo", "Une courte histoire du port", "Заметки о каталоге",
    "Three ways to bind a book", "Results", "Kosten und Zeit", "Preguntas abiertas", "What changed in 2019", "Blue tiles 44", "Kleine Karten 7.", "Cartas largas",
)
_SENTENCES = (
    "The keeper walked to the gate and counted the boats twice before noon.", "Niemand wusste, warum der Plan im Keller lag und nicht im Turm.",
    "El molino cerró en 1931, pero la rueda gira todavía.", "La table du fond reste libre jusqu'au soir.", "Никто не помнил, кто принёс эту карту.",
    "A ticket costs $4 in winter and $6 in summer.", "Between (a) and (b) there are 12. Steps follow.",
)
_FORMULAS = ("a^2 + b^2 = c^2", r"\sum_{i=0}^{n} i", r"\frac{p}{q}", "F = m a", r"\int_0^1 f \, dx")
_CODES = ("# not a heading\nmake all\n- not an item", "<h1>{{ name }}</h1>\n<li>x</li>", "def run(x):\n    return x * 2", "* a\n== b ==\n\\section{c}", '{\n  "k": 1\n}')


def labelled_pages(count: int = 500, seed: int = 11) -> list[list[tuple[tuple[str, ...], str]]]:
    """Labelled pages: structures set in each markup language; many pages mix in blocks of other ones."""
    rng = random.Random(seed)
    pages = []
    for n in range(count):
        main = ("markdown", "html", "wiki", "latex", "plain")[n % 5]
        parts: list[str] = []
        wanted: list[str] = []
        if main == "plain" and rng.random() < 0.4:
            made, labels = _set(rng, "markdown", "heading")
            parts.append(made)
            wanted += labels
        for _ in range(rng.randint(3, 12)):
            tongue = main if rng.random() < 0.85 or main == "plain" else rng.choice(("markdown", "html", "wiki", "latex"))
            kind = rng.choice(("text", "text", "heading", "items", "items", "code", "formula", "quote"))
            made, labels = _set(rng, tongue, kind)
            parts.append(made)
            wanted += labels
        text = "\n\n".join(parts)
        blocks = scan(text)
        if len(blocks) == len(wanted):
            pages.append([(leaf_features(key), label) for key, label in zip(leaf_keys(blocks, language(text)), wanted)])
    return pages


def _inline(rng: random.Random, tongue: str, sentence: str) -> str:
    words = sentence.split(" ")
    for k in range(len(words)):
        if rng.random() < 0.12:
            word = words[k]
            words[k] = {
                "markdown": rng.choice((f"**{word}**", f"`{word}`", f"[{word}](https://a.example/1)")), "html": rng.choice((f"<b>{word}</b>", f"<code>{word}</code>")),
                "wiki": rng.choice((f"'''{word}'''", f"[[A|{word}]]")), "latex": rng.choice((rf"\emph{{{word}}}", rf"\textbf{{{word}}}")), "plain": word,
            }[tongue]
    return " ".join(words)


def _set(rng: random.Random, tongue: str, kind: str) -> tuple[str, list[str]]:
    phrase, sentence = rng.choice(_PHRASES), _inline(rng, tongue, " ".join(rng.sample(_SENTENCES, rng.randint(1, 3))))
    if tongue == "plain" or kind == "text":
        line = phrase if tongue == "plain" and kind == "heading" else sentence
        return (f"<p>{line}</p>" if tongue == "html" and rng.random() < 0.8 else line), ["other"]
    if kind == "heading":
        level = rng.randint(1, 3)
        return {
            "markdown": rng.choice(("#" * level + " " + phrase, "#" * level + f" {phrase} " + "#" * level, f"{phrase}\n{'=' * len(phrase)}", f"{phrase}\n{'-' * len(phrase)}")),
            "html": rng.choice((f"<h{level}>{phrase}</h{level}>", f'<H{level} id="a">{phrase}</H{level}>', f'<h{level} class="t"><span>{phrase}</span></h{level}>')),
            "wiki": rng.choice((f"{'=' * (level + 1)} {phrase} {'=' * (level + 1)}", f"{'=' * (level + 1)}{phrase}{'=' * (level + 1)}")),
            "latex": rng.choice((rf"\section{{{phrase}}}", rf"\subsection*{{{phrase}}}")),
        }[tongue], ["heading"]
    if kind == "items":
        entries = rng.choices(_PHRASES, k=rng.randint(2, 5))
        mark = rng.choice("-*+")
        if tongue == "markdown":
            lines = [f"{'  ' * (rng.random() < 0.2)}{mark} {e}" for e in entries] if rng.random() < 0.6 else [f"{k}. {e}" for k, e in enumerate(entries, 1)]
            return "\n".join(lines), ["item"] * len(entries)
        if tongue == "html":
            closing = "</li>" if rng.random() < 0.7 else ""
            return "\n".join(["<ul>", *(f"<li>{e}{closing}" for e in entries), "</ul>"]), ["other", *["item"] * len(entries), "other"]
        if tongue == "wiki":
            mark = rng.choice("*#")
            return "\n".join(f"{mark * (1 + (rng.random() < 0.2))} {e}" for e in entries), ["item"] * len(entries)
        return "\n".join([r"\begin{itemize}", *(rf"  \item {e}" for e in entries), r"\end{itemize}"]), ["other", *["item"] * len(entries), "other"]
    if kind == "code":
        code = rng.choice(_CODES)
        return {
            "markdown": rng.choice((f"```\n{code}\n```", f"~~~py\n{code}\n~~~", f"````md\n{code}\n````")), "html": f"<pre><code>{code.replace('<', '&lt;')}</code></pre>",
            "wiki": f'<syntaxhighlight lang="x">\n{code}\n</syntaxhighlight>', "latex": f"\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}",
        }[tongue], ["code"]
    if kind == "formula":
        formula = rng.choice(_FORMULAS)
        return {
            "markdown": rng.choice((f"$${formula}$$", f"$$\n{formula}\n$$")), "html": rng.choice((f'<span class="math">\\[{formula}\\]</span>', f'<script type="math/tex">{formula}</script>')),
            "wiki": f'<math display="block">{formula}</math>', "latex": rng.choice((f"\\[ {formula} \\]", f"\\begin{{equation}}\n{formula}\n\\end{{equation}}")),
        }[tongue], ["formula"]
    return {"markdown": f"> {sentence}", "html": f"<blockquote>{sentence}</blockquote>", "wiki": f"<blockquote>{sentence}</blockquote>", "latex": f"\\begin{{quote}}{sentence}\\end{{quote}}"}[tongue], ["other"]


#: Signs between which a formula may stand, and what closes each.
_SIGN = re.compile(r"(?<!\\)\$\$?|\\[()\[\]]|<math\b[^>]*>|</math\s*>|<script\b[^>]*math/tex[^>]*>|</script\s*>", re.IGNORECASE)
_CLOSED_BY = {"$": "$", "$$": "$$", "\\(": "\\)", "\\[": "\\]", "<math": "</math", "<script": "</script"}
_OPERATOR = re.compile(r"[=^_\\{}+*<>≤≥]|(?<=\s)[-/](?=\s)|\w\(")
_LONG_WORD = re.compile(r"(?<![\\\w])[^\W\d_]{3,}")


def inline_leaves(text: str) -> list[tuple[int, int, tuple]]:
    """(start, end, key) of what stands between each sign and the next that may close it."""
    signs = [(m.start(), m.end(), re.match(r"\$+|\\.|</?\w+", m.group()).group().lower()) for m in _SIGN.finditer(text)]
    found = []
    for k, (start, inner, sign) in enumerate(signs):
        closer = _CLOSED_BY.get(sign)
        follow = next(((a, b) for a, b, other in signs[k + 1 :] if other == closer), None) if closer else None
        if follow is None:
            continue
        body = text[inner : follow[0]]
        words = len(_LONG_WORD.findall(body))
        what = "empty" if not body.strip() else "sign" if _OPERATOR.search(body) else "figures" if body.strip().replace(".", "").replace(",", "").isdigit() else "letter" if len(body.strip()) < 3 else "words" if words > 1 else "word"
        before, after = text[start - 1 : start], text[follow[1] : follow[1] + 1]
        found.append((start, follow[1], (sign, what, body[:1].isspace(), body[-1:].isspace(), before.isalnum() or before == "_", after.isdigit(), min(words, 4), "\n" in body, body[:1].isdigit() and bool(re.match(r"[\d.,]+(?:\s|$|/)", body)))))
    return found


def inline_features(key: tuple) -> tuple[str, ...]:
    sign, what, open_blank, close_blank, joined, figure, words, lines, amount = key
    dollar = sign == "$"
    return (
        f"sign={sign}", f"sign={sign},what={what}", f"dollar={dollar},open={open_blank}", f"dollar={dollar},close={close_blank}", f"dollar={dollar},joined={joined}", f"dollar={dollar},figure={figure}",
        f"dollar={dollar},words={words}", f"dollar={dollar},words={words},amount={amount}", f"dollar={dollar},lines={lines}", f"dollar={dollar},amount={amount},what={what}", f"dollar={dollar},clean={not (open_blank or close_blank or joined or figure or lines)}",
    )


_INLINE_FORMULAS = (*_FORMULAS, "x", "n", "k = 3", "x + 1", r"\beta \geq 2", r"k_{4} = v t + 4", r"q(n) \sim n", r"\pi", "7", r"\sqrt{2}", "f(t) = t^{3} - 1", "a < b", r"\sum_{j=1}^{5} j^2", r"\int_0^{7} x \, dx", r"\text{rate of change}")
_AMOUNTS = ("$4", "$12.50", "US$ 30", "$3 million", "$5/month", "($5", "$HOME", "$PATH,", "$1,200", "A$7", "$19)", "$9.", "from $6 to $8", "$2 and $3,", "costs $ 5 or $ 6")


def labelled_lines(count: int = 1500, seed: int = 5) -> list[list[tuple[tuple[str, ...], str]]]:
    """Chains of the leaves of labelled lines: sentences with formulas and with amounts."""
    rng = random.Random(seed)
    chains = []
    for _ in range(count):
        line, gold = "", set()
        for word in " ".join(rng.sample(_SENTENCES, rng.randint(1, 3))).split(" "):
            if rng.random() < 0.12:
                formula = rng.choice(_INLINE_FORMULAS)
                made = rng.choice((f"${formula}$",) * 4 + (f"$${formula}$$", f"\\({formula}\\)", f"\\[{formula}\\]", f"<math>{formula}</math>", f'<script type="math/tex">{formula}</script>'))
                gold.add((len(line), len(line) + len(made)))
                line += made + rng.choice((" ", " ", " ", ", ", ". ", "-"))
            if rng.random() < 0.1:
                line += rng.choice(_AMOUNTS) + " "
            line += word + " "
        leaves = inline_leaves(line)
        chains.append([(inline_features(key), "formula" if (start, end) in gold else "other") for start, end, key in leaves])
    return [c for c in chains if c]


@lru_cache(maxsize=1)
def trained() -> ChainCRF:
    return ChainCRF(LABELS).fit(labelled_pages())


@lru_cache(maxsize=1)
def trained_inline() -> ChainCRF:
    return ChainCRF(("other", "formula")).fit(labelled_lines())


class ElementReader:
    """Labels the blocks of values by one CRF, and the leaves of their lines by another; evidence of equal leaves is
    computed once."""

    def __init__(self, crf: ChainCRF, inline: ChainCRF):
        self.crf, self.inline = crf, inline
        self.known: dict[tuple, list[float]] = {}

    def labelled(self, text: str) -> list[tuple[Block, str]]:
        blocks = scan(text)
        evidence = []
        for key in leaf_keys(blocks, language(text)):
            scores = self.known.get(key)
            if scores is None:
                scores = self.known[key] = self.crf.evidence(leaf_features(key))
            evidence.append(scores)
        return [(block, LABELS[k]) for block, k in zip(blocks, self.crf.viterbi(evidence))]

    def formulas(self, text: str) -> list[tuple[int, int]]:
        """Where formulas stand within a block's text, by Viterbi over its leaves."""
        if not ("$" in text or "\\(" in text or "\\[" in text or "<math" in text or "<script" in text):
            return []
        leaves = inline_leaves(text)
        # of leaves that share a sign only one may be a formula: the transition between them forbids it
        best: list[list[tuple[float, tuple[int, ...]]]] = []
        start, move = self.inline.start.tolist(), self.inline.move.tolist()
        for k, (at, end, key) in enumerate(leaves):
            scores = self.known.get(key)
            if scores is None:
                scores = self.known[key] = self.inline.evidence(inline_features(key))
            reached = []
            for y in (0, 1):
                if not k:
                    reached.append((start[y] + scores[y], (y,)))
                    continue
                shared = leaves[k - 1][1] > at
                score, path = max((s + move[x][y] if not (shared and x == y == 1) else -1e9, p) for x, (s, p) in enumerate(best[-1]))
                reached.append((score + scores[y], (*path, y)))
            best.append(reached)
        return [(at, end) for (at, end, _), y in zip(leaves, max(best[-1])[1]) if y] if best else []

    def counts(self, text: str | None) -> dict[str, int]:
        """Elements of each kind."""
        found = {"heading": 0, "item": 0, "code": 0, "formula": 0}
        if not text:
            return found
        for block, label in self.labelled(text):
            if label == "formula":
                found["formula"] += max(1, len(self.formulas(block.text)))
                continue
            if label != "other":
                found[label] += 1
            if label == "code" or block.form in CODE_FORMS:
                continue
            if "$" in block.text or "\\" in block.text or "<" in block.text:
                found["formula"] += len(self.formulas(INLINE_CODE.sub(" ", block.text)))
        return found


ELEMENTS = "field_name string, elem string, n int"


def element_counts(pages: DataFrame, id_column: str = "fetch_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field_name, elem, n) of each value that has elements of the kind."""
    crf, inline = trained(), trained_inline()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ElementReader(crf, inline)
        for batch in batches:
            at, names, elems, counts = [], [], [], []
            for field in fields:
                for k, value in enumerate(batch.column(field)):
                    for elem, n in reader.counts(value.as_py()).items():
                        if n:
                            at.append(k)
                            names.append(field)
                            elems.append(elem)
                            counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(names, pa.string()), pa.array(elems, pa.string()), pa.array(counts, pa.int32())], names=[id_column, "field_name", "elem", "n"])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, *fields).mapInArrow(run, f"`{id_column}` {kind}, {ELEMENTS}")


def clean_marked(text: str | None, reader: ElementReader) -> str | None:
    """Clean text that still shows its structure: ``#`` before headings, ``-`` before list items, code between fences
    and formulas between dollar signs. A null stays null."""
    if text is None:
        return None
    out: list[str] = []
    last = ""
    for block, label in reader.labelled(text):
        if block.form in ("container", "rule"):
            continue
        if label == "code":
            made = f"```\n{_code_text(block)}\n```"
        elif label == "formula":
            made = "$$" + re.sub(r"^\s*(?:\$\$|\\\[|<[^>]*>|\\begin\{\w+\*?\})+|(?:\$\$|\\\]|<[^>]*>|\\end\{\w+\*?\})+\s*$", "", block.text).strip().removeprefix("\\[").removesuffix("\\]").strip() + "$$"
        else:
            body, keep = re.sub(r"\\(?:begin|end)\{quote\}", "", block.text), []
            for at, end in reversed(reader.formulas(INLINE_CODE.sub(lambda m: " " * len(m.group()), body))):
                keep.append(body[at:end])
                body = f"{body[:at]}\ue000{len(keep) - 1}\ue001{body[end:]}"
            body = visible(body)
            body = re.sub("\ue000(\\d+)\ue001", lambda m: _dollars(keep[int(m.group(1))]), body)
            if not body:
                continue
            made = {"heading": "# ", "item": "- "}.get(label, "") + body
        out.append(("\n" if label == last == "item" else "\n\n") + made if out else made)
        last = label
    return "".join(out)


def _dollars(formula: str) -> str:
    inner = re.sub(r"^(?:\$+|\\[(\[]|<[^>]*>)+|(?:\$+|\\[)\]]|</[^>]*>)+$", "", formula).strip()
    return f"${inner}$"


def _code_text(block: Block) -> str:
    if block.form == "fence":
        return block.text
    text = re.sub(r"^\s*(?:<[a-zA-Z][^>]*>)+\n?|\n?(?:</[a-zA-Z]+\s*>)+\s*$|^\s*\\begin\{\w+\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\n?|\n?\\end\{\w+\*?\}\s*$", "", block.text)
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")


def clean_values(pages: DataFrame, id_column: str = "fetch_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, fields...) with each value as clean text that shows its structure."""
    crf, inline = trained(), trained_inline()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ElementReader(crf, inline)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([clean_marked(v.as_py(), reader) for v in batch.column(f)], pa.string()) for f in fields)], names=[id_column, *fields])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, *fields).mapInArrow(run, f"`{id_column}` {kind}, " + ", ".join(f"`{f}` string" for f in fields))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    counts = element_counts(table(spark, folder, "fetch_cache"))
    return counts.selectExpr("fetch_id", "field_name", "elem", "explode(sequence(1, n)) as pos")


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean_values(table(spark, folder, "fetch_cache"))
