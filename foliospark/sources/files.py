"""Files as rows: discovery by pattern, and readers of text, tables, notebooks and mails into Markdown."""

from __future__ import annotations

import email
import email.policy
import html as html_entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import detect_format
from ..operators.render import to_markdown
from . import office


def glob_pattern(glob: str) -> str:
    """A regular expression of a glob over ``/``-parted paths; ``**`` spans any number of segments."""
    out = ""
    parts = [p for p in glob.removeprefix("./").lstrip("/").split("/") if p]
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        out += "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in part) + ("" if last else "/")
    return "^" + out + "$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Whether a relative path matches one of the patterns, and none of those that begin with ``!``. Without a positive
    pattern every path is taken."""
    wanted = [g for g in globs if not g.startswith("!")]
    unwanted = [g[1:] for g in globs if g.startswith("!")]
    take = F.lit(not wanted)
    for g in wanted:
        take = take | path.rlike(glob_pattern(g))
    for g in unwanted:
        take = take & ~path.rlike(glob_pattern(g))
    return take


def discover(spark: SparkSession, folder: str, globs: list[str] | None = None, depth: int = 16) -> DataFrame:
    """(path, relative, format, length, modificationTime) of the files of known format below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).drop("content")
    base = folder.rstrip("/")
    plain = F.regexp_replace("path", r"^file:/*", "/")
    relative = F.regexp_replace(plain, "^" + re.escape(re.sub(r"^file:/*", "/", base)) + "/", "")
    made = files.select("path", relative.alias("relative"), detect_format(F.col("path")).alias("format"), "length", "modificationTime")
    return made.where((F.col("format") != "unknown") & (F.size(F.split("relative", "/")) <= depth) & matches_globs(F.col("relative"), globs or []))


def table_markdown(rows: list[list[str]]) -> str:
    """Rows as a Markdown table; the first one is the header."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    return "\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * width, *("| " + " | ".join(r) + " |" for r in rows[1:])])


def csv_markdown(text: str, mark: str = ",") -> str:
    import csv
    import io

    return table_markdown(list(csv.reader(io.StringIO(text), delimiter=mark)))


def notebook_markdown(text: str) -> str:
    """Cells of a notebook: Markdown as it is, code between fences, textual outputs below."""
    book = json.loads(text)
    language = book.get("metadata", {}).get("kernelspec", {}).get("language", "python")
    out = []
    for cell in book.get("cells", []):
        source = "".join(cell.get("source", []))
        if cell.get("cell_type") == "markdown":
            out.append(source.strip())
        elif cell.get("cell_type") == "code" and source.strip():
            out.append(f"```{language}\n{source.strip()}\n```")
            for result in cell.get("outputs", []):
                shown = "".join(result.get("text", []) or result.get("data", {}).get("text/plain", []))
                if shown.strip():
                    out.append(f"```\n{shown.strip()}\n```")
    return "\n\n".join(x for x in out if x)


def mail_markdown(data: bytes) -> str:
    """A mail: subject as title, header block, body (HTML if there is one) and a list of attachments."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    head = "\n".join(f"**{name}:** {message[name]}" for name in ("From", "To", "Cc", "Date") if message[name])
    body = message.get_body(preferencelist=("html", "plain"))
    text = ""
    if body is not None:
        content = body.get_content()
        text = (to_markdown(content) or "") if body.get_content_type() == "text/html" else content.strip()
    files = [f"- {a.get_filename() or 'unnamed'} ({len(a.get_payload(decode=True) or b'')} bytes)" for a in message.iter_attachments() if a.get_content_maintype() != "multipart"]
    return "\n\n".join(x for x in (f"# {message['Subject']}" if message["Subject"] else "", head, text, "## Attachments\n\n" + "\n".join(files) if files else "") if x)


def xml_markdown(text: str) -> str:
    return "```xml\n" + text.strip() + "\n```"


def convert(data: bytes, kind: str) -> tuple[str | None, str | None]:
    """(markdown, error) of a file's bytes by format. Formats that need an outside program give an error."""
    try:
        if kind == "eml":
            return mail_markdown(data), None
        if kind in office.READERS:
            return office.READERS[kind](data), None
        text = data.decode("utf-8-sig", errors="replace")
        if kind in ("csv", "tsv"):
            return csv_markdown(text, "\t" if kind == "tsv" else ","), None
        if kind == "ipynb":
            return notebook_markdown(text), None
        if kind in ("html", "htm", "xhtml"):
            return to_markdown(text), None
        if kind == "xml":
            return xml_markdown(text), None
        if kind in ("txt", "md", "rst", "org", "tex"):
            return text, None
        return None, f"no reader for {kind}"
    except Exception as error:  # noqa: BLE001  one bad file must not fail its task
        return None, html_entities.unescape(f"{type(error).__name__}: {error}")[:200]


def convert_files(spark: SparkSession, folder: str, globs: list[str] | None = None) -> DataFrame:
    """(path, format, markdown, error) of the files below a folder; a file that cannot be read has an error instead."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    plain = files.select("path", detect_format(F.col("path")).alias("format"), "content").where("format <> 'unknown'")
    if globs:
        base = re.sub(r"^file:/*", "/", folder.rstrip("/"))
        plain = plain.where(matches_globs(F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base) + "/", ""), globs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [convert(d.as_py(), k.as_py()) for d, k in zip(batch.column("content"), batch.column("format"))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("format"), pa.array([m for m, _ in made], pa.string()), pa.array([e for _, e in made], pa.string())], names=["path", "format", "markdown", "error"])

    return plain.mapInArrow(run, "path string, format string, markdown string, error string")
