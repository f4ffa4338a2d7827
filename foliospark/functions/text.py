"""Column functions on text and Markdown. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
#: Suffixes whose contents are no good source of a title.
UNTITLED_SUFFIXES = ("csv", "tsv", "xml")
#: Letters from which a text is judged to be garbled, and one vowel in this many letters.
GARBLED_LETTERS = 40
GARBLED_VOWELS = 5

#: File suffixes and their formats where these differ; other suffixes name their format.
FORMAT_SUFFIXES = ("docx", "doc", "pptx", "ppt", "xlsx", "xls", "pdf", "txt", "md", "jpeg", "jpg", "png", "webp", "svg", "csv", "xml", "ods", "odt", "numbers", "gif", "bmp", "tiff", "heic", "heif", "avif", "tsv", "epub", "rtf", "rst", "org", "tex", "html", "htm", "xhtml", "eml", "msg", "ipynb")
FORMAT_ALIASES = {"markdown": "md", "tif": "tiff"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def detect_format(path: Column) -> Column:
    """The format by a path's suffix, without case; unknown when it has none or another."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    named = suffix
    for alias, name in FORMAT_ALIASES.items():
        named = F.when(suffix == alias, name).otherwise(named)
    return F.when(named.isin(*FORMAT_SUFFIXES), named).otherwise("unknown")


def clean_controls(text: Column, keep_lines: bool = True) -> Column:
    """Without control characters; tabs and line ends may stay."""
    return F.regexp_replace(text, "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]" if keep_lines else "[\u0000-\u001f\u007f]", "")


def strip_marks(text: Column) -> Column:
    """Without Markdown punctuation, blanks collapsed."""
    return collapse(F.regexp_replace(text, r"[#*_\[\]()>`\-|!]", ""))


def plain_words(text: Column) -> Column:
    """Words between blanks."""
    bare = collapse(text)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def count_words(text: Column) -> Column:
    """Each CJK character is a word; the rest counts by blanks, without punctuation."""
    cjk = count_matches(text, f"[{CJK}]")
    rest = collapse(F.regexp_replace(F.regexp_replace(text, f"[{CJK}]", " "), r"[^\p{L}\p{N}_\s]", " "))
    return cjk + F.when(rest == "", 0).otherwise(F.size(F.split(rest, " ")))


def estimate_tokens(text: Column) -> Column:
    """One and a half tokens for a CJK character, one for four others."""
    cjk = count_matches(text, "[一-鿿]")
    return (F.floor(cjk * 1.5) + F.floor((F.char_length(text) - cjk) / 4)).cast("long")


def normalize_text(text: Column) -> Column:
    """Quotes, dashes and dots in one form, blanks collapsed, lower case."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[‘’]", "'"), "[“”]", '"'), "[–—]", "-"), "…", "...")
    return F.lower(collapse(plain))


def is_garbled(text: Column) -> Column:
    """Latin letters with next to no vowels; few letters, or more CJK characters than letters, are never garbled."""
    letters, vowels, cjk = count_matches(text, "[A-Za-z]"), count_matches(text, "[AEIOUaeiou]"), count_matches(text, "[一-鿿぀-ヿ가-힯]")
    return (letters >= GARBLED_LETTERS) & (cjk < letters) & (vowels * GARBLED_VOWELS < letters)


def language_of(text: Column) -> Column:
    """zh when CJK characters are four or more and no fewer than Latin letters; else en."""
    cjk, latin = count_matches(text, "[一-鿿]"), count_matches(text, "[A-Za-z]")
    return F.when((cjk >= 4) & (cjk >= latin), "zh").otherwise("en")


def boundary_key(line: Column) -> Column:
    """A line for comparison across pages: lower case, blanks collapsed, figures as #."""
    return F.regexp_replace(F.lower(collapse(line)), "[0-9]+", "#")


def strip_images(text: Column) -> Column:
    return F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")


def strip_data_uris(text: Column) -> Column:
    """Without images that carry their bytes."""
    return F.regexp_replace(text, r"!\[[^\]]*\]\(data:image/[^)]*\)", "")


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*---[ \t]*\n(?:(?!---[ \t]*\n)[^\n]*\n)*---[ \t]*(?:\n|$)", "")


def frontmatter_title(text: Column) -> Column:
    """The title line of a leading block between ``---`` lines; null when there is none."""
    block = F.regexp_extract(text, r"^\s*---[ \t]*\n((?:(?!---[ \t]*\n)[^\n]*\n)*)---[ \t]*(?:\n|$)", 1)
    title = F.trim(F.regexp_replace(F.regexp_extract(block, r"(?m)^title:[ \t]*(.+)$", 1), "^[\"']|[\"']$", ""))
    return F.when(title != "", title)


def without_fences(text: Column) -> Column:
    """Without fenced code blocks; one that is never closed goes to the end."""
    return F.regexp_replace(text, r"(?ms)^(`{3,}|~{3,})[^\n]*\n.*?(?:^\1[`~]*[ \t]*$|\z)", "")


def first_heading(text: Column, level: int) -> Column:
    """The text of the first heading of exactly this level outside code; null when there is none."""
    found = F.trim(F.regexp_extract(without_fences(strip_frontmatter(text)), r"(?m)^#{%d}(?!#)[ \t]+(\S[^\n]*)$" % level, 1))
    return F.when(found != "", found)


def first_line(text: Column) -> Column:
    """The first line that may be a title: no comment, image or rule."""
    lines = F.transform(F.split(strip_frontmatter(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\r\t]", " ")))
    good = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(?:<!--|-->|!\[|\[!\[)") & ~x.isin("---", "***", "___"))
    return F.get(good, 0)


def normal_title(title: Column) -> Column:
    """A title without heading marks, links, tags and emphasis around it."""
    plain = F.regexp_replace(collapse(title), r"^#{1,6}\s+", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]*)\]\([^)]*\)", "$1"), r"</?[A-Za-z][^>]*>", "")
    for _ in range(2):
        plain = F.regexp_replace(plain, r"^(\*\*|__|~~|`|\*|_)(.+)\1$", "$2")
    return collapse(plain)


def content_title(text: Column) -> Column:
    """The first heading of level one, else of level two, else the first line; 100 characters at most."""
    found = F.coalesce(first_heading(text, 1), first_heading(text, 2), first_line(text))
    return F.substring(normal_title(found), 1, 100)


def source_title(source: Column) -> Column:
    """A title from a path or url: the name without its suffix; the host where there is no name."""
    path = F.when(source.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)).otherwise(source)
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    host = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    stem = F.when(F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*UNTITLED_SUFFIXES), name).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""))
    return F.when(name == "", F.when(host == "", source).otherwise(host)).otherwise(stem)


def resolve_title(explicit: Column, content: Column, source: Column) -> Column:
    """An explicit title, else the content's where it can be trusted, else the source's."""
    trusted = ~F.lower(F.regexp_extract(source, r"\.([^./]+)$", 1)).isin(*UNTITLED_SUFFIXES)
    given = F.when(F.coalesce(explicit, F.lit("")) != "", normal_title(explicit))
    own = F.when(trusted, content_title(content))
    return F.coalesce(given, F.when(F.coalesce(own, F.lit("")) != "", own), source_title(source))


def tidy_lines(text: Column) -> Column:
    """Line ends without trailing blanks; four and more line ends become three."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=\n|\z)", ""), "\n{4,}", "\n\n\n")


#: What stands for a protected mark until it is put back: a kind and a number.
HELD = r"__KEEP_[A-Z]+_\d+__"


def drop_placeholders(text: Column) -> Column:
    """Without placeholders that a later stage should have put back: alone on a line the line goes, as the target of an
    image the image."""
    return F.regexp_replace(text, rf"(?m)^[ \t]*{HELD}[ \t]*\n?|!\[[^\]]*\]\({HELD}\)|{HELD}", "")


def asset_names(text: Column) -> Column:
    """The distinct names of images in the assets folder, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\([^)\s]*assets/([^)\s]+)\)"), 1), lambda x: F.regexp_extract(x, r"([^/]+)$", 1)))


def data_uris(text: Column) -> Column:
    """array of (mime, bytes) of the images that carry their bytes; broken ones are left out."""
    found = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\((data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=]+)\)"), 1)
    made = F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^data:([^;]+)", 1).alias("mime"), F.try_to_binary(F.regexp_extract(x, "base64,(.*)$", 1), F.lit("base64")).alias("data")))
    return F.filter(made, lambda x: x["data"].isNotNull())


def timeout_seconds(base: Column, chars: Column, rate: float, tokens: Column, images: Column, factor: float, each: float, most: float) -> Column:
    """A time limit that grows with the text and its images, between ``base`` and ``most``."""
    raw = base + chars / F.lit(rate) + tokens / 4
    scaled = F.when(images > 0, raw * factor + F.greatest(images - 1, F.lit(0)) * each).otherwise(raw)
    return F.greatest(base, F.least(scaled, F.lit(most))).cast("int")


def smart_cut(text: Column, limit: int, window: int = 700, over: int = 100) -> Column:
    """The text up to ``limit``, ended at a paragraph, else at a sentence, within the last ``window`` characters, or at
    most ``over`` characters later."""
    head = F.substring(text, 1, limit + over)
    paragraph = F.regexp_extract(head, r"(?s)^(.*)\n\n", 1)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?。！？])(?:\s|\z)", 1)
    return (
        F.when(F.char_length(text) <= limit, text).when(F.char_length(paragraph) >= limit - window, paragraph)
        .when(F.char_length(sentence) >= limit - window, sentence).otherwise(F.substring(text, 1, limit))
    )


def is_ascii_hex(text: Column) -> Column:
    return text.rlike("^[0-9A-Fa-f]+$")
