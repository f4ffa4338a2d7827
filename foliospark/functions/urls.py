"""Column functions on urls: parts, file names, redaction, private hosts, credentials. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of a query that carry a secret by themselves, and words that make a key secret.
SECRET_KEYS = ("apikey", "auth", "code", "key", "pwd", "sid", "sig", "ticket")
SECRET_WORDS = ("assertion", "authorization", "auth", "bearer", "credential", "credentials", "jwt", "otp", "passcode", "passwd", "password", "pwd", "saml", "session", "secret", "signature", "ticket", "token")
#: Route names after which a token is a secret.
SECRET_ROUTES = ("activate", "activation", "invite", "invitation", "magic", "magic_link", "password_reset", "reset", "secret", "session", "token", "verify", "verification")
#: Suffixes of hosts that are not public.
LOCAL_SUFFIXES = (".local", ".internal", ".lan", ".home", ".corp")
REDACTED = "[redacted]"

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def is_url(url: Column) -> Column:
    return F.lower(url).rlike("^https?://")


def url_part(url: Column, group: int) -> Column:
    """1 scheme, 2 netloc, 3 path, 4 query, 5 fragment; an empty string for what is missing."""
    return F.regexp_extract(url, _URL, group)


def host_of(netloc: Column) -> Column:
    """The host of a netloc without userinfo and port, in lower case; bracketed and bare IPv6 are kept whole."""
    bare = F.regexp_replace(netloc, r"^.*@", "")
    v6 = F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    colons = F.length(bare) - F.length(F.replace(bare, F.lit(":"), F.lit("")))
    return F.lower(F.when(bare.startswith("["), v6).when(colons > 1, bare).otherwise(F.split_part(bare, F.lit(":"), F.lit(1))))


def safe_filename(name: Column) -> Column:
    """Characters that no file system likes become ``_``; outer dots and blanks go; 200 characters at most."""
    trimmed = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"^[. ]+|[. ]+$", "")
    cut = F.substring(trimmed, 1, 200)
    return F.when(cut == "", "unnamed").otherwise(cut)


def _netloc_name(url: Column) -> Column:
    port = F.regexp_extract(url_part(url, 2), r":(\d+)$", 1)
    return F.regexp_replace(F.concat(host_of(url_part(url, 2)), F.when(port != "", F.concat(F.lit(":"), port)).otherwise("")), "[.:]", "_")


def url_filename(url: Column) -> Column:
    """A Markdown file name: the last path segment, with the host before it when there is a query; else the host."""
    path = F.regexp_replace(url_part(url, 3), "/+$", "")
    last = F.regexp_extract(path, "([^/]+)$", 1)
    host = safe_filename(_netloc_name(url))
    return F.concat(F.when(last == "", host).when(url_part(url, 4) != "", F.concat(host, F.lit("_"), safe_filename(last))).otherwise(safe_filename(last)), F.lit(".md"))


def query_key(key: Column) -> Column:
    """A key in snake case."""
    snake = F.regexp_replace(F.regexp_replace(key, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(snake), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def is_secret_key(key: Column) -> Column:
    name = query_key(key)
    words = F.split(name, "_")
    has = lambda *x: F.arrays_overlap(words, F.array(*[F.lit(w) for w in x]))
    return name.isin(*SECRET_KEYS) | (has("api") & has("key")) | (has("key") & has("auth", "access")) | has(*SECRET_WORDS)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    size = F.size(chars)
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - (lambda p: p * F.log2(p))(F.size(F.filter(chars, lambda d: d == c)) / size))
    return F.when(size > 0, bits).otherwise(0.0)


_UUID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def is_random_token(segment: Column) -> Column:
    """A signed token, or a long segment of mixed letters and figures with high entropy; plain hex is none."""
    signed = segment.rlike(r"^[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$")
    shape = (F.length(segment) >= 24) & segment.rlike("^[A-Za-z0-9_~.-]+$") & ~F.replace(segment, F.lit("-"), F.lit("")).rlike("^[0-9A-Fa-f]+$")
    mixed = segment.rlike("[a-z]") & segment.rlike("[A-Z]") & segment.rlike("[0-9]")
    distinct = F.size(F.array_distinct(F.filter(F.split(segment, ""), lambda c: c != "")))
    return signed | (shape & mixed & (distinct >= 10) & (entropy(segment) >= 3.5))


def is_route_token(segment: Column) -> Column:
    """Whether a segment after a route that hands out secrets looks like one."""
    words = segment.rlike("^[a-z]+(?:-[a-z]+)*$")
    loose = (F.length(segment) >= 12) & segment.rlike("^[A-Za-z0-9_~.-]+$") & (segment.rlike("[A-Z]") | segment.rlike("[0-9]")) & (entropy(segment) >= 3.2)
    return (F.length(segment) >= 8) & (segment.rlike(_UUID) | is_random_token(segment) | segment.rlike("^(?i)[0-9a-f]{16,}$") | (~words & loose))


def secret_segments(path: Column) -> Column:
    """The positions, from 0, of the path segments that look secret; the segment before gives the context."""
    parts = F.transform(F.split(path, "/", -1), lambda s: F.coalesce(F.try_url_decode(s), s))
    pairs = F.transform(parts, lambda s, i: F.struct(i.alias("at"), s.alias("segment"), F.when(i > 0, F.get(parts, i - 1)).otherwise("").alias("before")))

    def secret(x: Column) -> Column:
        segment, before = x["segment"], x["before"]
        keyed = F.exists(F.array(F.lit("="), F.lit(":")), lambda sep: (F.instr(segment, "=") + F.instr(segment, ":") > 0) & F.contains(segment, sep) & (F.substring_index(segment, "=", -1) != "") & is_secret_key(F.regexp_extract(segment, "^([^=:]*)[=:].", 1)))
        context = query_key(before).isin(*SECRET_ROUTES) | is_secret_key(before)
        return (segment != "") & (is_random_token(segment) | keyed | ((x["at"] > 0) & context & is_route_token(segment)))

    return F.transform(F.filter(pairs, secret), lambda x: x["at"])


def has_credentials(url: Column) -> Column:
    """Userinfo, a secret path segment, or a secret key of the query or of a fragment with ``=``."""
    keys = lambda part: F.filter(F.transform(F.split(part, "&"), lambda p: F.when(F.contains(p, F.lit("=")) & (F.length(p) > F.instr(p, "=")), F.substring_index(p, "=", 1))), lambda k: k.isNotNull() & (k != ""))
    fragment = F.when(F.contains(url_part(url, 5), F.lit("=")), url_part(url, 5)).otherwise("")
    return F.contains(url_part(url, 2), F.lit("@")) | F.exists(keys(url_part(url, 4)), is_secret_key) | F.exists(keys(fragment), is_secret_key) | (F.size(secret_segments(url_part(url, 3))) > 0)


def redact_url(url: Column) -> Column:
    """The url without userinfo, query and fragment, and with secret path segments masked."""
    found = secret_segments(url_part(url, 3))
    path = F.array_join(F.transform(F.split(url_part(url, 3), "/", -1), lambda s, i: F.when(F.array_contains(found, i), REDACTED).otherwise(s)), "/")
    port = F.regexp_extract(url_part(url, 2), r":(\d+)$", 1)
    host = host_of(url_part(url, 2))
    shown = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    safe = F.concat(F.lower(url_part(url, 1)), F.lit("://"), shown, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), path)
    return F.when((url_part(url, 1) == "") | (host == ""), "[URL redacted]").otherwise(safe)


def ipv4_number(host: Column) -> Column:
    """The address of an IPv4 host as a number, in any of the forms that inet_aton takes (1 to 4 parts, decimal,
    octal or hexadecimal); null for other hosts."""
    parts = F.split(host, r"\.")
    good = host.rlike(r"^(?i)(?:0x[0-9a-f]+|\d+)(?:\.(?:0x[0-9a-f]+|\d+)){0,3}$")
    value = lambda p: F.when(F.lower(p).startswith("0x"), F.conv(F.substring(F.lower(p), 3, 20), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).when(p.rlike(r"^(0|[1-9]\d*)$"), p).try_cast("decimal(20,0)")
    numbers = F.transform(parts, value)
    n = F.size(parts)
    last = F.element_at(numbers, -1)
    width = F.get(F.array(F.lit(32), F.lit(24), F.lit(16), F.lit(8)), n - 1)
    head = F.slice(numbers, 1, F.greatest(n - 1, F.lit(0)))
    fits = ~F.exists(head, lambda v: v.isNull() | (v > 255)) & last.isNotNull() & (last < F.pow(F.lit(2), width))
    packed = F.aggregate(head, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(24).alias("shift")), lambda a, v: F.struct((a["sum"] + v.cast("long") * F.pow(F.lit(2), a["shift"]).cast("long")).alias("sum"), (a["shift"] - 8).alias("shift")))["sum"]
    return F.when(good & (n <= 4), F.when(fits, packed + last.cast("long")))


#: Blocks of IPv4 addresses that are not global, and multicast, by first address and prefix length.
CLOSED_BLOCKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))


def _block(first: str, bits: int) -> tuple[int, int]:
    start = 0
    for part in first.split("."):
        start = start * 256 + int(part)
    return start, start + 2 ** (32 - bits) - 1


def is_private_host(netloc: Column) -> Column:
    """Userinfo, local names, names without a dot, and addresses that are not global."""
    host = F.regexp_replace(F.trim(host_of(netloc)), r"\.+$", "")
    blocks = F.array(*[F.struct(F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high")) for low, high in (_block(*b) for b in CLOSED_BLOCKS)])
    # only hosts of figures are read as addresses
    closed = F.when(host.rlike("^[0-9a-fx.]+$"), F.exists(F.array(ipv4_number(host)), lambda number: F.exists(blocks, lambda b: number.between(b["low"], b["high"]))))
    local = (host == "localhost") | host.endswith(".localhost") | F.exists(F.array(*[F.lit(s) for s in LOCAL_SUFFIXES]), lambda s: F.endswith(host, s))
    v6 = F.contains(host, F.lit(":")) & (host.rlike("^(?i)(::1?$|fe[89ab]|f[cd]|ff|::ffff:(0:)?(10|127)\\.)"))
    return F.contains(netloc, F.lit("@")) | F.when(host == "", False).otherwise(local | (~F.contains(host, F.lit(".")) & ~F.contains(host, F.lit(":"))) | F.coalesce(closed, F.lit(False)) | v6)


def assess_remote(url: Column) -> Column:
    """Why a url may not be given to a remote service: the first reason, or null when it may. Names are not resolved."""
    return (
        F.when(url.isNull() | ~F.lower(url_part(url, 1)).isin("http", "https") | (host_of(url_part(url, 2)) == ""), "invalid_url")
        .when(has_credentials(url), "credential_material")
        .when(is_private_host(url_part(url, 2)), "private_or_local_host")
    )
