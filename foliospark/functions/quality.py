"""Quality verdicts of extracted Markdown by the kind of page, as structs of accepted, score and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, collapse, let, plain_words, strip_marks

#: Lines of a social post that are not its body.
_POST_TITLE = r"^(?i)post by\s+(.+)$"
_HANDLE = r"^@[\w.]+$"
_STAMP = r"^(?:\d{4}-\d{2}-\d{2}[tT ][0-9:.\-+Z]+|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b.+|\d{1,2}:\d{2}\s*(?:AM|PM|am|pm).*)$"


def _verdict(text: Column, faults: list[tuple[Column, str, float]]) -> Column:
    """Each fault that holds lowers the score and gives its reason once."""
    empty = text.isNull() | (collapse(text) == "")

    def judged(held: Column) -> Column:
        reasons = F.array_distinct(F.filter(F.array(*[F.when(F.get(held, k), reason) for k, (_, reason, _) in enumerate(faults)]), lambda r: r.isNotNull()))
        score = F.lit(1.0)
        for k, (_, _, weight) in enumerate(faults):
            score = score - F.when(F.get(held, k), weight).otherwise(0.0)
        return F.struct((~F.exists(held, lambda h: h)).alias("accepted"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 6))).alias("score"), reasons.alias("reasons"))

    made = let(F.array(*[F.coalesce(c, F.lit(False)) for c, _, _ in faults]), judged)
    return F.when(empty, F.struct(F.lit(False).alias("accepted"), F.lit(0.0).alias("score"), F.array(F.lit("empty_content")).alias("reasons"))).otherwise(made)


def assess_article(text: Column) -> Column:
    def judged(plain: Column) -> Column:
        dense = plain.rlike(f"[{CJK}]") & (F.char_length(F.replace(plain, F.lit(" "), F.lit(""))) >= 10)
        return _verdict(text, [(F.char_length(plain) < 10, "too_short", 0.6), ((F.size(F.filter(F.split(plain, " "), lambda w: w != "")) < 3) & ~dense, "too_short", 0.4)])

    return let(strip_marks(text), judged)


def post_body(text: Column) -> Column:
    """A post without the lines of its title, author, handle and time."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: collapse(F.regexp_replace(x, r"[#*_\[\]()>`!]", ""))), lambda x: x != "")
    author = F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, _POST_TITLE, 1)), lambda a: a != ""), 0)
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(_POST_TITLE) & ~x.rlike(_HANDLE) & ~x.rlike(_STAMP) & F.coalesce(x != author, F.lit(True))), " ")


def assess_post(text: Column) -> Column:
    none = strip_marks(text) == ""
    return _verdict(text, [(text.rlike(r"(?m)^Quote\s*$"), "quote_card_leakage", 0.4), (F.contains(text, F.lit("Discover more")), "recommendation_noise", 0.4), (F.contains(text, F.lit("Trends for you")), "sidebar_leakage", 0.4), (none, "too_short", 0.5), (~none & (post_body(text) == ""), "missing_body", 0.6)])


def assess_thread(text: Column) -> Column:
    return _verdict(text, [(F.contains(text, F.lit("Discover more")), "recommendation_noise", 0.4), (F.contains(text, F.lit("Trends for you")), "sidebar_leakage", 0.4), (plain_words(strip_marks(text)) < 10, "too_short", 0.5)])


def assess_issue(text: Column) -> Column:
    return _verdict(text, [(text.rlike(r"(?m)^(?:Assignees|Labels)\s*$"), "sidebar_leakage", 0.5), (plain_words(strip_marks(text)) < 10, "too_short", 0.5)])


def assess(text: Column, profile: Column) -> Column:
    """By profile; an unknown one counts as an article."""
    return F.when(profile == "social_post", assess_post(text)).when(profile == "conversation_thread", assess_thread(text)).when(profile == "discussion_issue", assess_issue(text)).otherwise(assess_article(text))
