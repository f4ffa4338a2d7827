import ipaddress

import pytest
from pyspark.sql import functions as F

from foliospark.functions import urls
from foliospark.operators import fetching

HOSTS = {
    "localhost": True, "a.localhost": True, "printer.local": True, "db.internal": True, "intranet": True, "127.0.0.1": True, "127.1": True, "0x7f.1": True, "017700000001": True, "2130706433": True, "10.0.0.5": True, "172.16.3.4": True, "172.32.3.4": False, "192.168.1.1:8080": True,
    "100.64.0.1": True, "169.254.1.1": True, "8.8.8.8": False, "example.org": False, "user@example.org": True, "[::1]:80": True, "[2606:4700::1]": False, "fd12::1": True, "": False, "224.0.0.1": True, "1.2.3.999": False, "a.home.": True,
}


def evaluate(spark, column, values):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in frame.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_private_hosts(spark):
    assert dict(zip(HOSTS, evaluate(spark, urls.is_private_host, HOSTS))) == HOSTS


def test_closed_blocks_agree_with_the_library():
    for first, bits in urls.CLOSED_BLOCKS:
        low, high = urls._block(first, bits)
        for number in (low, high):
            address = ipaddress.IPv4Address(number)
            assert not address.is_global or address.is_multicast


def test_names_and_redaction(spark):
    given = ["https://example.org/a/b.html", "https://example.org/", "https://youtube.com/watch?v=abc", "http://u:p@h.org:8080/x?q=1#f", "https://h.org/reset/Ab3dEf6hIj9k", "not a url", "https://h.org/v/eyJhbGciOi.eyJzdWIiOi.SflKxwRJSM"]
    assert evaluate(spark, urls.url_filename, given[:3]) == ["b.html.md", "example_org.md", "youtube_com_watch.md"]
    assert evaluate(spark, urls.redact_url, given[3:]) == ["http://h.org:8080/x", f"https://h.org/reset/{urls.REDACTED}", "[URL redacted]", f"https://h.org/v/{urls.REDACTED}"]
    assert evaluate(spark, urls.safe_filename, ['a<b>:"/\\|?*c', " . ", "x" * 300]) == ["a_b_________c"[:0] + "a_b________c"[:0] + "a_b_" + "_" * 7 + "c", "unnamed", "x" * 200]


@pytest.mark.parametrize("url, reason", [
    ("https://example.org/a", None), ("ftp://example.org/a", "invalid_url"), ("https://example.org/?api_key=1", "credential_material"), ("https://example.org/?accessToken=x", "credential_material"), ("https://example.org/?page=2", None),
    ("https://example.org/#session=5", "credential_material"), ("https://10.1.2.3/", "private_or_local_host"), (None, "invalid_url"), ("https://u@example.org/", "credential_material"), ("https://example.org/token/123e4567-e89b-12d3-a456-426614174000", "credential_material"), ("https://example.org/docs/123e4567-e89b-12d3-a456-426614174000", None),
])
def test_remote_reasons(spark, url, reason):
    assert evaluate(spark, urls.assess_remote, [url]) == [reason]


def test_entropy(spark):
    assert [round(x, 6) for x in evaluate(spark, urls.entropy, ["", "aaaa", "ab", "abcd"])] == [0.0, 0.0, 1.0, 2.0]


def test_host_patterns(spark):
    cases = [("a.b.org", "*", True), ("a.b.org", ".b.org", True), ("b.org", ".b.org", False), ("a.b.org", "*.b.org", True), ("10.0.1.5", "10.0.0.0/8", True), ("11.0.1.5", "10.0.0.0/8", False), ("b.org:80", "B.org", True), ("b.org", "", False), ("b.org", "10.0.0.0/8", False)]
    frame = spark.createDataFrame(cases, "host string, pattern string, wanted boolean")
    assert all(r["x"] == r["wanted"] for r in frame.select("wanted", fetching.matches_pattern(F.col("host"), F.col("pattern")).alias("x")).collect())
    assert fetching.local_patterns(["a", "b"], "b, c,,") == ["a", "b", "c"]


def test_decisions(spark):
    schema = "domain string, spa boolean, explicit string, local boolean, domain_order array<string>, prefers string, global_order array<string>, enabled boolean"
    rows = [
        ("a.org", False, "jina", True, None, None, None, True), ("a.org", True, "auto", True, ["jina"], None, None, True), ("localhost", False, None, False, None, None, None, True), ("a.org", False, None, False, ["jina", "static"], "jina", None, True),
        ("a.org", False, None, False, None, "jina", ["static"], True), ("a.org", False, None, False, None, None, ["static"], True), ("a.org", True, None, False, None, None, None, False), ("a.org", True, None, False, None, None, None, True), ("a.org", False, None, False, None, None, None, True),
    ]
    c = F.col
    found = spark.createDataFrame(rows, schema).select(fetching.decide(c("domain"), c("spa"), F.lit(False), c("explicit"), c("local"), c("domain_order"), c("prefers"), c("global_order"), c("enabled")).alias("d")).collect()
    assert [r["d"]["reason"] for r in found] == ["explicit_jina", "local_only_pattern", "private_or_local", "domain_priority", "domain_prefer_jina", "global_priority", "disabled", "spa_or_pattern", "default"]
    assert found[1]["d"]["order"] == ["playwright", "static"] and found[4]["d"]["order"] == ["jina", "static", "playwright", "defuddle", "cloudflare"]


def test_malformed_addresses_do_not_fail(spark):
    odd = ["https://h.org/%zz/%", "https://h.org:99999999999/x", "https://[::1", "http://1.2.3.4.5/", "https://h.org/?%=%&&=", "https://0x/", "https://999999999999999999999999/", "://", "https://h.org/a#=b", ""]
    for use in (urls.redact_url, urls.url_filename, urls.assess_remote, urls.has_credentials):
        evaluate(spark, use, odd)
    evaluate(spark, lambda h: fetching.matches_pattern(h, F.lit("10.0.0.0/99")), odd)
