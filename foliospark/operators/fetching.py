"""Which way a page is to be fetched, and whether what came back is a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_of, ipv4_number, is_private_host

#: The strategies in their usual order, those that stay on this machine, and the order for pages that
#: need a browser.
STRATEGIES = ("static", "playwright", "defuddle", "jina", "cloudflare")
LOCAL = ("static", "playwright")
LOCAL_BROWSER = ("playwright", "static")
BROWSER_FIRST = ("playwright", "defuddle", "jina", "cloudflare", "static")
#: Phrases of pages that want scripts.
SCRIPT_PHRASES = ("javascript is disabled", "javascript is required", "please enable javascript", "this page requires javascript", "you need to enable javascript", "enable javascript", "requires javascript")
SCRIPT_PATTERNS = (
    "this (?:page|site|website) requires javascript", "you need (?:to enable )?javascript", "enable javascript to (?:view|continue|access)", r"(?m)^(?:\s*#?\s*)?(?:just a moment|one moment)\.{0,3}\s*$",
    "checking (?:if the site connection is secure|your browser)", "verifying (?:you are human|your browser)", "ray id:",
)
#: Signs of contents that are no page, in order, and the reason each gives.
REFUSALS = (
    ("javascript is (not available|disabled)", "javascript_disabled"), ("please enable javascript", "javascript_required"), ("switch to a supported browser", "unsupported_browser"), ("something went wrong.*let's give it another shot", "error_page"),
    ("log in.*sign up.*to continue", "login_required"), ("you must be logged in", "login_required"), ("智能验证检测中", "captcha_geetest"), ("由极验提供技术支持", "captcha_geetest"), ("checking your browser before accessing", "captcha_cloudflare"),
    ("cf-browser-verification|cf_chl_", "captcha_cloudflare"), (r"g-recaptcha|google\.com/recaptcha", "captcha_recaptcha"), (r"hcaptcha\.com|h-captcha", "captcha_hcaptcha"),
)


def no_proxy_patterns(value: str | None) -> list[str]:
    return [p.strip() for p in (value or "").split(",") if p.strip()]


def local_patterns(configured: list[str], no_proxy: str | None) -> list[str]:
    """Configured patterns first, then those of the environment, each once."""
    return list(dict.fromkeys([*configured, *no_proxy_patterns(no_proxy)]))


def matches_pattern(netloc: Column, pattern: Column) -> Column:
    """Host patterns: ``*``, ``.suffix`` and ``*.suffix`` for subdomains, IPv4 blocks, or the host itself."""
    host = F.regexp_replace(F.trim(host_of(netloc)), r"\.+$", "")
    p = F.regexp_replace(F.lower(F.trim(pattern)), r"^\*\.", ".")
    bits = F.regexp_extract(p, r"/(\d{1,2})$", 1).try_cast("int")
    size = F.pow(F.lit(2), 32 - bits).cast("long")
    inside = F.floor(ipv4_number(host) / size) == F.floor(ipv4_number(F.split_part(p, F.lit("/"), F.lit(1))) / size)
    return (host != "") & (p != "") & F.when(p == "*", True).when(p.startswith("."), F.endswith(host, p)).when(F.contains(p, F.lit("/")), F.coalesce(inside & host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.lit(False))).otherwise(host == p)


def in_domains(domain: Column, patterns: Column) -> Column:
    """Whether a domain is one of an array of domains, or below one."""
    return F.exists(patterns, lambda p: (domain == p) | F.endswith(domain, F.concat(F.lit("."), p)))


def decide(
    domain: Column, known_spa: Column, fallback: Column, explicit: Column, local_only: Column, domain_order: Column, domain_prefers: Column, global_order: Column, enabled: Column
) -> Column:
    """struct(order, reason): the strategies to try, by the first rule that holds. ``explicit``, ``domain_order``,
    ``domain_prefers`` and ``global_order`` are null where nothing is set; ``local_only`` says whether a local pattern
    matches."""
    some = lambda names: F.array(*[F.lit(n) for n in names])
    browser = F.coalesce(known_spa, F.lit(False)) | F.coalesce(fallback, F.lit(False))
    near = F.when(browser, some(LOCAL_BROWSER)).otherwise(some(LOCAL))
    promoted = F.concat(F.array(domain_prefers), F.array_remove(some(STRATEGIES), domain_prefers))
    made = lambda order, reason: F.struct(order.alias("order"), reason.alias("reason"))
    return (
        F.when(explicit.isNotNull() & ~explicit.isin("", "auto"), made(F.array(explicit), F.concat(F.lit("explicit_"), explicit)))
        .when(local_only, made(near, F.lit("local_only_pattern")))
        .when(is_private_host(domain), made(near, F.lit("private_or_local")))
        .when(F.size(F.coalesce(domain_order, F.array().cast("array<string>"))) > 0, made(domain_order, F.lit("domain_priority")))
        .when(domain_prefers.isNotNull(), made(promoted, F.concat(F.lit("domain_prefer_"), domain_prefers)))
        .when(F.size(F.coalesce(global_order, F.array().cast("array<string>"))) > 0, made(global_order, F.lit("global_priority")))
        .when(~enabled, made(some(STRATEGIES), F.lit("disabled")))
        .when(browser, made(some(BROWSER_FIRST), F.lit("spa_or_pattern")))
        .otherwise(made(some(STRATEGIES), F.lit("default")))
    )


def decide_pages(pages: DataFrame, spa_domains: DataFrame) -> DataFrame:
    """(fetch_id, domain, strategy_order, reason) of each page under the usual rules; the known script domains are joined
    by domain, not collected."""
    domain = host_of(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    known = spa_domains.select(F.lower("domain").alias("domain")).distinct().withColumn("known", F.lit(True))
    null = F.lit(None).cast("string")
    none = F.lit(None).cast("array<string>")
    found = decide(F.col("domain"), F.col("known"), F.lit(False), null, F.lit(False), none, null, none, F.lit(True))
    return pages.select("fetch_id", domain.alias("domain")).join(known, "domain", "left").select("fetch_id", "domain", found.alias("d")).select("fetch_id", "domain", F.array_join("d.order", ",").alias("strategy_order"), F.col("d.reason").alias("reason"))


def bare_text(text: Column) -> Column:
    return F.regexp_replace(text, r"[#*_\[\]()>`\-|]", "")


def needs_scripts(content: Column) -> Column:
    """Empty contents, script notices, bot walls, and contents with next to no text."""
    low = F.lower(content)
    said = F.lit(False)
    for phrase in SCRIPT_PHRASES:
        said = said | F.contains(low, F.lit(phrase))
    for pattern in SCRIPT_PATTERNS:
        said = said | low.rlike(pattern)
    words = F.filter(F.split(F.trim(F.regexp_replace(bare_text(content), r"\s+", " ")), " "), lambda w: w != "")
    size = F.char_length(F.trim(F.regexp_replace(bare_text(content), r"\s+", " ")))
    return content.isNull() | (content == "") | said | (size < 100) | ((size < 500) & (F.size(F.array_distinct(F.transform(words, F.lower))) < 20))


def refusal(content: Column) -> Column:
    """Why a content is no page: the first reason, or null."""
    reason = F.when(content.isNull() | (F.trim(F.regexp_replace(content, r"\s+", " ")) == ""), "empty")
    for pattern, name in REFUSALS:
        reason = reason.when(content.rlike("(?is)" + pattern), name)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(content, r"!\[[^\]]*\]\([^)]+\)", ""), r"\[[^\]]*\]\([^)]+\)", ""), r"[#\-*_>\[\]`|]", "")
    return reason.when(F.char_length(F.trim(F.regexp_replace(clean, r"\s+", " "))) < 30, "too_short")
