"""Readers of documents that are archives of XML parts: books, texts, slides and sheets, as Markdown."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from ..operators.render import to_markdown

#: Bytes that an archive's parts may have once unpacked.
MOST_BYTES = 512 * 1024 * 1024
_A, _P, _R = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W, _S = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _open(data: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(data))
    if sum(part.file_size for part in archive.infolist()) > MOST_BYTES:
        raise ValueError("archive too large")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))  # noqa: S314  the parser expands no external entities


def _targets(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Where the relations of a part lead, by their ids."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels".lstrip("/")
    if rels not in archive.namelist():
        return {}
    return {r.get("Id", ""): (r.get("Target", "").lstrip("/") if r.get("Target", "").startswith("/") else posixpath.normpath(posixpath.join(folder, r.get("Target", "")))) for r in _xml(archive, rels) if r.get("TargetMode") != "External"}


def _table(rows: list[list[str]]) -> str:
    from .files import table_markdown

    return table_markdown(rows)


def epub_markdown(data: bytes) -> str:
    """A book: its title, and its pages in reading order."""
    archive = _open(data)
    root = next(e.get("full-path", "") for e in _xml(archive, "META-INF/container.xml").iter() if e.tag.endswith("}rootfile"))
    package = _xml(archive, root)
    title = next((e.text or "" for e in package.iter() if e.tag.endswith("}title")), "")
    pages = {e.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(root), e.get("href", ""))) for e in package.iter() if e.tag.endswith("}item")}
    made = [to_markdown(archive.read(pages[e.get("idref")]).decode("utf-8", errors="replace")) for e in package.iter() if e.tag.endswith("}itemref") and pages.get(e.get("idref")) in archive.namelist()]
    return "\n\n".join(x for x in (f"# {title.strip()}" if title.strip() else "", *made) if x)


def _runs(paragraph: ElementTree.Element) -> str:
    out = []
    for run in paragraph.iter(f"{_W}r"):
        text = "".join(e.text or "" if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" else "\n" if e.tag == f"{_W}br" else "" for e in run)
        look = run.find(f"{_W}rPr")
        on = lambda tag: look is not None and (e := look.find(_W + tag)) is not None and e.get(f"{_W}val") not in ("0", "false")  # noqa: E731, B023
        mark = "**" if on("b") else "*" if on("i") else ""
        bare = text.strip()
        out.append(text.replace(bare, mark + bare + mark, 1) if bare and mark else text)
    return "".join(out).replace("****", "").strip()


def docx_markdown(data: bytes) -> str:
    """A text: headings by their styles, lists, tables, bold and italic runs."""
    body = _xml(_open(data), "word/document.xml").find(f"{_W}body")
    out: list[str] = []
    for block in body if body is not None else ():
        if block.tag == f"{_W}tbl":
            out.append(_table([[" ".join(filter(None, map(_runs, cell.iter(f"{_W}p")))) for cell in row.iter(f"{_W}tc")] for row in block.iter(f"{_W}tr")]))
        elif block.tag == f"{_W}p" and (text := _runs(block)):
            style = block.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            level = re.match(r"(?i)heading ?([1-6])$", name)
            if level or name.lower() == "title":
                out.append("#" * (int(level.group(1)) if level else 1) + " " + text.replace("**", ""))
            elif block.find(f"{_W}pPr/{_W}numPr") is not None:
                item = "- " + text
                if out and out[-1].startswith("- "):
                    out[-1] += "\n" + item
                else:
                    out.append(item)
            else:
                out.append(text)
    return "\n\n".join(x for x in out if x)


def pptx_markdown(data: bytes) -> str:
    """Slides in order behind their marks: the title as a heading, texts, tables, and notes."""
    archive = _open(data)
    show, targets = _xml(archive, "ppt/presentation.xml"), _targets(archive, "ppt/presentation.xml")
    out = []
    for number, part in enumerate([targets[e.get(f"{_R}id")] for e in show.iter(f"{_P}sldId") if e.get(f"{_R}id") in targets], 1):
        out.append(f"<!-- Slide number: {number} -->")
        slide = _xml(archive, part)
        for shape in slide.iter():
            if shape.tag == f"{_P}sp":
                lines = [t for p in shape.iter(f"{_A}p") if (t := "".join(r.text or "" for r in p.iter(f"{_A}t")).strip())]
                kind = next((e.get("type", "") for e in shape.iter(f"{_P}ph")), "")
                if lines:
                    out.append("# " + " ".join(lines) if kind in ("title", "ctrTitle") else "\n".join(lines))
            elif shape.tag == f"{_A}tbl":
                out.append(_table([["".join(t.text or "" for t in cell.iter(f"{_A}t")) for cell in row.iter(f"{_A}tc")] for row in shape.iter(f"{_A}tr")]))
        notes = next((t for t in _targets(archive, part).values() if "notesSlide" in t and t in archive.namelist()), None)
        if notes and (said := "\n".join(t for p in _xml(archive, notes).iter(f"{_A}p") if (t := "".join(r.text or "" for r in p.iter(f"{_A}t")).strip()) and not t.isdigit())):
            out.append("### Notes:\n" + said)
    return "\n\n".join(out)


def xlsx_markdown(data: bytes) -> str:
    """Sheets in order, each as a heading and a table of what its cells show."""
    archive = _open(data)
    shared = ["".join(t.text or "" for t in e.iter(f"{_S}t")) for e in _xml(archive, "xl/sharedStrings.xml").iter(f"{_S}si")] if "xl/sharedStrings.xml" in archive.namelist() else []
    book, targets = _xml(archive, "xl/workbook.xml"), _targets(archive, "xl/workbook.xml")
    out = []
    for sheet in book.iter(f"{_S}sheet"):
        rows: list[list[str]] = []
        for row in _xml(archive, targets[sheet.get(f"{_R}id", "")]).iter(f"{_S}row"):
            cells: list[str] = []
            for cell in row.iter(f"{_S}c"):
                letters = re.match(r"[A-Z]+", cell.get("r", ""))
                at = 0
                for c in letters.group() if letters else "":
                    at = at * 26 + ord(c) - 64
                cells += [""] * (at - 1 - len(cells))
                value = cell.findtext(f"{_S}v") or ""
                kind = cell.get("t")
                cells.append(shared[int(value)] if kind == "s" and value.isdigit() and int(value) < len(shared) else "".join(t.text or "" for t in cell.iter(f"{_S}t")) if kind == "inlineStr" else ("TRUE" if value == "1" else "FALSE") if kind == "b" else value)
            rows.append(cells)
        out.append(f"## {sheet.get('name', '')}\n\n{_table([r for r in rows if any(r)])}".strip())
    return "\n\n".join(out)


READERS = {"epub": epub_markdown, "docx": docx_markdown, "pptx": pptx_markdown, "xlsx": xlsx_markdown}
