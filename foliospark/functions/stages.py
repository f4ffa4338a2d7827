"""Column functions around the stages that rewrite a document: what they are given, and what of their answers is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, let, strip_frontmatter

#: What a rewriting stage's instructions hold and a document does not.
PROMPT_MARKS = ("## Task 1:", "## Task 2:", "## 任务 1:", "## 任务 2:", "【核心原则】", "【清理规范】", "请处理以下", "你是一个专业的")
#: Characters of the context that is given along with a document's parts.
CONTEXT = 200
#: Remote strategies, and the refusals that each reports in its message.
REFUSALS = {"defuddle": r"HTTP 4\d\d", "cloudflare": r"\b(401|402|403|429|451)\b|CF BR API error"}
LOCAL_FAULT = "Cloudflare API token and account ID required"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def context_of(text: Column, most: int = CONTEXT) -> Column:
    """The first characters of a document's body, without front matter, image lines and blank ones, on one line."""
    lines = F.filter(F.split(strip_frontmatter(text), r"\r\n|\r|\n", -1), lambda x: (_bare(x) != "") & ~F.startswith(_bare(x), F.lit("![")))
    return _bare(F.substring(collapse(F.array_join(lines, " ")), 1, most))


def image_reference(alt: Column, path: Column) -> Column:
    """An image whose alternative text and path may hold brackets, blanks and letters of any script."""
    escaped = alt
    for sign in ("\\", "[", "]"):
        escaped = F.replace(escaped, F.lit(sign), F.lit("\\" + sign))
    encoded = F.url_encode(path)
    for made, wanted in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(made), F.lit(wanted))
    return F.concat(F.lit("!["), escaped, F.lit("]("), encoded, F.lit(")"))


def holds_prompt(text: Column) -> Column:
    """Whether a stage's answer repeats its instructions."""
    found = F.lit(False)
    for mark in PROMPT_MARKS:
        found = found | F.contains(text, F.lit(mark))
    return found


def without_prompt(text: Column) -> Column:
    """A stage's answer; when it repeats the instructions, what stands behind the second rule; null when that is lacking."""
    parts = F.split(text, "---", 3)
    return F.when(~holds_prompt(text), text).when(F.size(parts) > 2, _bare(F.get(parts, 2)))


def finished(body: Column, frontmatter: Column) -> Column:
    """A document with its front matter, whose own marks are taken off first, between rules."""
    fields = _bare(F.regexp_replace(F.regexp_replace(_bare(frontmatter), r"^```(?:ya?ml)?\s*\n|\n```$", ""), r"(?m)^---[ \t]*$", ""))
    return F.concat(F.lit("---\n"), fields, F.lit("\n---\n\n"), body)


def primary_content(static: Column, browser: Column, fallback: Column) -> Column:
    """The one source that a fetch settled on, trimmed; nothing of the others is added."""
    return F.coalesce(_bare(fallback), F.lit(""))


def reference_images(content: Column, images: Column) -> Column:
    """``content`` with the page images that do not stand in it as comments under one header, by page and name. ``images`` is
    an array of (page, name, path); those without a path are left out."""
    kept = F.array_sort(F.transform(F.filter(images, lambda x: F.coalesce(x["path"], F.lit("")) != ""), lambda x: F.struct(F.coalesce(x["page"], F.lit(0)).alias("page"), F.coalesce(x["name"], F.lit("")).alias("name"), x["path"].alias("path"))))
    lines = F.transform(kept, lambda x: F.concat(F.lit("<!-- "), image_reference(F.when(x["page"] > 0, F.concat(F.lit("Page "), x["page"].cast("string"))).otherwise(x["name"]), x["path"]), F.lit(" -->")))
    return let(lines, lambda ls: F.when(F.coalesce(F.size(ls), F.lit(0)) < 1, content).otherwise(F.concat(F.regexp_replace(content, r"\s+$", ""), F.lit("\n\n<!-- Page images for reference -->\n"), F.array_join(ls, "\n"))))


def service_refusal(strategy: Column, error: Column, status: Column | None = None) -> Column:
    """Why a remote service refused a request: a limit, or a client's error; null for failures of the network or the server
    and for settings that lack here."""
    code = F.lit(None).cast("int") if status is None else status
    own = F.lit(None).cast("string")
    for name, pattern in REFUSALS.items():
        own = F.when((strategy == name) & F.lower(error).contains("rate limit"), "rate limited").when((strategy == name) & error.rlike(pattern), error).otherwise(own)
    reader = F.when(F.lower(error).contains("rate limit"), "rate limited (free tier: 20 RPM)").when(code.between(400, 499), F.concat(F.lit("HTTP "), code.cast("string"), F.lit(": "), F.regexp_replace(error, r"^Jina Reader API error \(\d+\): ", "")))
    return F.when(error.contains(LOCAL_FAULT), None).when(strategy == "jina", reader).otherwise(own)


def within_size(length: Column, most: int) -> Column:
    """Whether a file may be read; one of unknown length may."""
    return F.coalesce(length <= most, F.lit(True))


def wrapped_payload(payload: Column, field: str) -> Column:
    """An answer as an object with one list ``field``: a bare list, or a bare object without the field, is put into it; null
    for anything else."""
    bare = _bare(payload)
    return (
        F.when(F.try_parse_json(bare).isNull(), None).when(F.startswith(bare, F.lit("[")), F.concat(F.lit('{"' + field + '":'), bare, F.lit("}")))
        .when(F.startswith(bare, F.lit("{")) & F.get_json_object(bare, f"$.{field}").isNull(), F.concat(F.lit('{"' + field + '":['), bare, F.lit("]}")))
        .when(F.startswith(bare, F.lit("{")), bare)
    )
