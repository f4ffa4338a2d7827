"""HTML pages as Markdown, in one pass over each page's tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

from .html_nodes import RAW, build

_SKIP = RAW | {"head", "svg", "iframe", "object", "button", "form", "input", "select", "textarea"}
_LANGUAGE = re.compile(r"(?:^|\s)(?:language|lang|highlight-source)-([\w+#-]+)")


#: Classes of boxed remarks, and the kinds they become.
CALLOUTS = {"note": "note", "info": "info", "tip": "tip", "success": "tip", "warning": "warning", "caution": "caution", "danger": "caution", "important": "important", "primary": "note", "secondary": "note"}
_BOX = re.compile(r"(?:^|[\s_-])(?:alert|admonition|callout|markdown-alert)(?:$|[\s_-])")
_NOTE_TARGET = re.compile(r"#(?:fn|footnote|note|cite_note)[:_-]?([\w.-]+)$")
_UNSAFE = re.compile(r"^[\s\x00-\x1f]*(?:javascript|vbscript|data(?!:image/))[\s\x00-\x1f]*:", re.IGNORECASE)


#: Elements that show something without a text of their own, and that may be empty for good.
_SHOWN = frozenset(("img", "video", "audio", "svg", "math", "iframe", "hr", "br", "input", "td", "th", "tr", "tbody", "thead", "table", "source", "track", "picture", "script"))


def _inside(nodes: list[list], k: int, *tags: str) -> bool:
    return any(nodes[j][1] in tags for j in range(k + 1, nodes[k][4] + 1))


def tidy(nodes: list[list]) -> list[list]:
    """Links, wrappers and empty elements in one form. A link around a heading becomes the heading's own; links within code,
    and those of a heading to itself, are their texts; elements around one other element alone, and spans that say
    nothing of themselves, are transparent; elements that show nothing and rules at either end go."""
    last = len(nodes) - 1
    texts = ["".join(t for _, t in n[3]).strip() != "" for n in nodes]
    children: list[list[int]] = [[] for _ in nodes]
    for k, node in enumerate(nodes):
        if node[0] >= 0:
            children[node[0]].append(k)
    for k, node in enumerate(nodes):
        tag, attrs = node[1], node[2]
        if tag == "a" and _inside(nodes, k, "h1", "h2", "h3", "h4", "h5", "h6"):
            head = next(j for j in range(k + 1, node[4] + 1) if nodes[j][1] in ("h1", "h2", "h3", "h4", "h5", "h6"))
            if attrs.get("href"):
                nodes[head][2]["data-link"] = attrs["href"]
            node[1] = "div"
        elif tag == "a" and attrs.get("href", "").startswith("#") and node[0] >= 0 and nodes[node[0]][1] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            node[1] = "span"
        elif tag in ("code", "pre"):
            for j in range(k + 1, node[4] + 1):
                if nodes[j][1] == "a":
                    nodes[j][1] = "span"
        elif tag in ("section", "article", "main", "header", "center") and not texts[k] and len(children[k]) == 1:
            node[1] = "div"
        elif tag == "span" and not attrs:
            node[1] = "font"
    shows = [False] * len(nodes)
    for k in range(last, -1, -1):
        shows[k] = shows[k] or texts[k] or nodes[k][1] in _SHOWN or nodes[k][1] in ("pre", "code")
        if shows[k] and nodes[k][0] >= 0:
            shows[nodes[k][0]] = True
    for k, node in enumerate(nodes):
        if not shows[k] and node[0] >= 0:
            node[1] = "template"
    for order in (range(len(nodes)), range(last, -1, -1)):
        for k in order:
            if nodes[k][1] == "hr":
                nodes[k][1] = "template"
            elif texts[k] and nodes[k][1] != "template" or nodes[k][1] in _SHOWN:
                break
    return nodes


def standardize(nodes: list[list], base: str | None = None, title: str | None = None) -> list[list]:
    """The elements of a page in one form: several first headings one level lower, later headings that repeat the title
    out, addresses absolute, unsafe ones out, permanent-link anchors of headings out, lazy pictures with their best
    source, layout tables unwrapped, players as links."""
    text = lambda k: " ".join("".join(t for j in range(k, nodes[k][4] + 1) if nodes[j][1] != "template" for _, t in nodes[j][3]).split())
    several = sum(n[1] == "h1" for n in nodes) > 1
    seen_title = False
    for k, node in enumerate(nodes):
        tag, attrs = node[1], node[2]
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            for j in range(k + 1, node[4] + 1):
                if nodes[j][1] == "a" and (text(j) in ("#", "¶", "§", "🔗", "") or re.search(r"(?:^|[\s_-])(?:anchor|permalink|headerlink)", nodes[j][2].get("class", ""))) and text(j) != text(k):
                    nodes[j][1] = "template"
            if title and " ".join(title.split()).lower() == text(k).lower():
                if seen_title:
                    node[1] = "template"
                    continue
                seen_title = True
            if tag == "h1" and several:
                node[1] = "h2"
        elif tag in ("a", "area"):
            href = unquote(attrs.get("href", ""))
            if _UNSAFE.match(href):
                attrs.pop("href", None)
            elif base and attrs.get("href") and not attrs["href"].startswith("#"):
                attrs["href"] = urljoin(base, attrs["href"])
        elif tag == "img":
            source = best_source_of(attrs.get("srcset") or attrs.get("data-srcset") or "") or attrs.get("data-src") or attrs.get("data-original") or attrs.get("src", "")
            if _UNSAFE.match(source):
                source = ""
            attrs["src"] = urljoin(base, source) if base and source else source
        elif tag == "iframe":
            page = player_page(attrs.get("src", ""))
            if page:
                node[1], attrs["href"] = "a", page
                node[3][:] = [(k + 1, page)]
        elif tag == "table":
            cells = [j for j in range(k + 1, node[4] + 1) if nodes[j][1] in ("td", "th")]
            if len(cells) <= 1 and not any(nodes[j][1] == "th" for j in cells) or any(nodes[j][1] == "table" for j in range(k + 1, node[4] + 1)):
                for j in range(k, node[4] + 1):
                    if nodes[j][1] in ("table", "tbody", "tr", "td") and (j == k or nodes[j][1] != "table"):
                        nodes[j][1] = "div"
    return nodes


def best_source_of(srcset: str) -> str:
    """The picture of the greatest width, or density, of a source set; the first of equals."""
    best, found = -1.0, ""
    for part in re.split(r",\s+|,(?=https?:)", srcset):
        words = part.split()
        if words:
            size = re.match(r"([\d.]+)([wx])$", words[1]) if len(words) > 1 else None
            value = float(size.group(1)) * (1 if size.group(2) == "w" else 0.001) if size else 0.001
            if value > best:
                best, found = value, words[0]
    return found


def player_page(src: str) -> str:
    """The page of an embedded player; empty for other frames."""
    for pattern, page in ((r"(?:youtube(?:-nocookie)?\.com/embed/|youtu\.be/)([\w-]{6,})", "https://www.youtube.com/watch?v="), (r"player\.vimeo\.com/video/(\d+)", "https://vimeo.com/"), (r"player\.bilibili\.com/player\.html\?.*?bvid=(\w+)", "https://www.bilibili.com/video/"), (r"platform\.twitter\.com/embed/.*?[?&]id=(\d+)", "https://x.com/i/status/")):
        if found := re.search(pattern, src):
            return page + found.group(1)
    return ""


def to_markdown(html: str | None, base: str | None = None, title: str | None = None) -> str | None:
    """Headings, paragraphs, lists, quotes, code, tables, links, images, emphasis, formulas, remarks and footnotes of a page
    as Markdown; null stays null. ``base`` makes addresses absolute; later headings that repeat ``title`` are left out."""
    if html is None:
        return None
    nodes = tidy(standardize(build("<body>" + html), base, title))
    children: list[list[tuple[int, object]]] = [[(at, t) for at, t in n[3]] for n in nodes]
    roots = []
    for k, node in enumerate(nodes):
        (children[node[0]].append((k, k)) if node[0] >= 0 else roots.append(k))
    for parts in children:
        parts.sort(key=lambda x: (x[0], not isinstance(x[1], str)))
    blocks: list[str] = []
    for root in roots:
        blocks += _blocks(root, nodes, children, 0)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(b for b in blocks if b.strip())).strip()


def _inline(k: int, nodes, children) -> str:
    _, tag, attrs, _, _ = nodes[k]
    if tag == "script" and "math/tex" in attrs.get("type", ""):
        return "$" + "".join(t for _, t in children[k] if isinstance(t, str)).strip() + "$"
    if tag in _SKIP:
        return ""
    if tag == "br":
        return "\n"
    if tag == "img":
        source = attrs.get("src") or attrs.get("data-src") or ""
        return f"![{attrs.get('alt', '').replace(']', '')}]({source})" if source and not source.startswith("data:") else ""
    if tag == "span" and re.search(r"(?:^|\s)(?:katex|math|mwe-math)", attrs.get("class", "")):
        formula = next(("".join(t for _, t in nodes[j][3]) for j in range(k, nodes[k][4] + 1) if nodes[j][1] == "annotation"), attrs.get("data-latex", ""))
        if formula.strip():
            return "$" + " ".join(formula.split()) + "$"
    if tag == "math":
        formula = attrs.get("data-latex") or next(("".join(t for _, t in nodes[j][3]) for j in range(k, nodes[k][4] + 1) if nodes[j][1] == "annotation"), "")
        if formula.strip():
            return "$" + " ".join(formula.split()) + "$"
        return "$" + " ".join("".join(_flat(k, nodes, children)).split()) + "$"
    inner = "".join(re.sub(r"\s+", " ", x) if isinstance(x, str) else _inline(x, nodes, children) for _, x in children[k])
    body = inner.strip()
    if not body:
        return " " if inner else ""
    lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    if tag in ("strong", "b"):
        return f"{lead}**{body}**{tail}"
    if tag in ("em", "i"):
        return f"{lead}*{body}*{tail}"
    if tag in ("del", "s"):
        return f"{lead}~~{body}~~{tail}"
    if tag == "mark":
        return f"{lead}=={body}=={tail}"
    if tag in ("code", "kbd", "samp", "tt"):
        fence = "``" if "`" in body else "`"
        return f"{lead}{fence}{body}{fence}{tail}"
    if tag == "a":
        href = attrs.get("href", "")
        note = _NOTE_TARGET.search(href)
        if note and re.fullmatch(r"\[?[\w*†‡]{1,4}\]?", body):
            return f"[^{note.group(1)}]"
        if re.search(r"#(?:fnref|cite_ref|footnote-ref|ref)", href):
            return ""
        return f"{lead}[{body}]({href}){tail}" if href and not href.lower().startswith("javascript:") else inner
    return inner


def _flat(k: int, nodes, children) -> list[str]:
    return [p for _, x in children[k] for p in ([x] if isinstance(x, str) else _flat(x, nodes, children))]


def _blocks(k: int, nodes, children, depth: int) -> list[str]:
    _, tag, attrs, _, _ = nodes[k]
    if tag in _SKIP and not (tag == "script" and "math/tex" in attrs.get("type", "")):
        return []
    if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
        text = " ".join(_inline(k, nodes, children).split())
        text = f"[{text}]({attrs['data-link']})" if text and "data-link" in attrs else text
        return [f"{'#' * int(tag[1])} {text}"] if text else []
    if tag == "pre":
        code = "".join(_flat(k, nodes, children)).strip("\n")
        inner = next((nodes[x][2] for _, x in children[k] if not isinstance(x, str) and nodes[x][1] == "code"), {})
        found = _LANGUAGE.search(attrs.get("class", "") + " " + inner.get("class", ""))
        fence = "`" * max(3, *(len(m) + 1 for m in re.findall(r"`{3,}", code)), 3)
        return [f"{fence}{found.group(1) if found else attrs.get('data-lang', '')}\n{code}\n{fence}"]
    if tag in ("div", "aside", "section") and _BOX.search(attrs.get("class", "")):
        kind = next((v for w in re.split(r"[\s_-]+", attrs.get("class", "")) if (v := CALLOUTS.get(w))), "note")
        inner = "\n\n".join(_children(k, nodes, children, depth))
        return [f"> [!{kind}]\n" + "\n".join(("> " + x).rstrip() for x in inner.split("\n"))] if inner.strip() else []
    if tag == "figure":
        parts = [p for _, x in children[k] if not isinstance(x, str) for p in (["*" + " ".join(_inline(x, nodes, children).split()) + "*"] if nodes[x][1] == "figcaption" else _blocks(x, nodes, children, depth) if nodes[x][1] in _BLOCKY else [_inline(x, nodes, children)])]
        return [p for p in parts if p.strip("* ")]
    if tag in ("ul", "ol") and any(not isinstance(x, str) and _NOTE_TARGET.search("#" + nodes[x][2].get("id", "")) for _, x in children[k]):
        return [f"[^{_NOTE_TARGET.search('#' + nodes[x][2].get('id', '')).group(1)}]: " + " ".join(" ".join(_children(x, nodes, children, depth)).replace("↩", "").split()) for _, x in children[k] if not isinstance(x, str) and _NOTE_TARGET.search("#" + nodes[x][2].get("id", ""))]
    if tag in ("ul", "ol"):
        out, number = [], int(attrs["start"]) if attrs.get("start", "").isdigit() else 1
        for _, x in children[k]:
            if isinstance(x, str) or nodes[x][1] != "li":
                continue
            parts = _children(x, nodes, children, depth + 1)
            mark = f"{number}. " if tag == "ol" else "- "
            number += 1
            body = "\n".join(parts).strip() or ""
            out.append(mark + body.replace("\n", "\n" + " " * len(mark)))
        return ["\n".join(out)] if out else []
    if tag == "blockquote":
        inner = "\n\n".join(_children(k, nodes, children, depth))
        return ["\n".join(("> " + x).rstrip() for x in inner.split("\n"))] if inner.strip() else []
    if tag == "hr":
        return ["---"]
    if tag == "table":
        return _table(k, nodes, children)
    if tag in ("script", "math") and not any(not isinstance(x, str) for _, x in children[k]):
        return ["$$" + "".join(_flat(k, nodes, children)).strip() + "$$"]
    return _children(k, nodes, children, depth)


_CONTAINERS = frozenset(("html", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "figure", "figcaption", "details", "summary", "dl", "dt", "dd", "address", "center", "fieldset"))
_BLOCKY = _CONTAINERS | frozenset(("p", "ul", "ol", "pre", "blockquote", "table", "hr", "h1", "h2", "h3", "h4", "h5", "h6"))


def _children(k: int, nodes, children, depth: int) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = re.sub(r"[ \t]+", " ", "".join(line)).strip()
        text = re.sub(r" ?\n ?", "\n", text)
        if text:
            out.append(text)
        line.clear()

    for _, x in children[k]:
        if isinstance(x, str):
            line.append(re.sub(r"\s+", " ", x))
        elif nodes[x][1] in _BLOCKY:
            flush()
            out += _blocks(x, nodes, children, depth)
        else:
            line.append(_inline(x, nodes, children))
    flush()
    return out


def _table(k: int, nodes, children) -> list[str]:
    rows: list[list[str]] = []

    def walk(at: int) -> None:
        for _, x in children[at]:
            if isinstance(x, str):
                continue
            if nodes[x][1] == "tr":
                rows.append([" ".join(_inline(c, nodes, children).split()).replace("|", "\\|") for _, c in children[x] if not isinstance(c, str) and nodes[c][1] in ("td", "th")])
            else:
                walk(x)

    walk(k)
    rows = [r for r in rows if r]
    if not rows:
        return []
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return ["\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * width, *("| " + " | ".join(r) + " |" for r in rows[1:])])]


def render_pages(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(id, markdown) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_markdown(v.as_py()) for v in batch.column(1)], pa.string())], names=[id_column, "markdown"])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, html_column).mapInArrow(run, f"`{id_column}` {kind}, markdown string")
