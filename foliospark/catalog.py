"""The queries of the core over the project's tables, and their SQL where DuckDB can express them. Every query runs over
its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, quality, stages, text, urls
from .functions.web import source_key
from .operators import batch_state, cache_tables, documents, extraction, fetching, html_nodes, images, markdown_blocks, noise, render, reports, retries, sections, text_map, threads
from .operators import site_pages as site_pages_ops
from .operators.instants import p4_found
from .plans.rank import ranked_within
from .sources.files import matches_globs
from .sources.sinks import frontmatter
from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {"p4_found": p4_found}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(made: Query) -> Query:
        QUERIES[name] = made
        if sql is not None:
            SQL[name] = sql
        return made

    return register


# urls

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"


@query("url_parts", rf"""
select fetch_id, {_HOST} as host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) as path,
  regexp_extract(url, '\?([^#]*)', 1) as query_text, regexp_extract(url, '#(.*)$', 1) as fragment, regexp_matches(url, '^https?://') as is_url
from fetch_cache""")  # fmt: skip
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return table(spark, folder, "fetch_cache").select("fetch_id", urls.host_of(urls.url_part(url, 2)).alias("host"), urls.url_part(url, 3).alias("path"), urls.url_part(url, 4).alias("query_text"), urls.url_part(url, 5).alias("fragment"), urls.is_url(url).alias("is_url"))


@query("url_filenames", rf"""
with p as (select fetch_id, {_HOST} as host, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as path, regexp_extract(url, '\?([^#]*)', 1) as q from fetch_cache),
n as (select fetch_id, q, replace(replace(host, '.', '_'), ':', '_') as h, regexp_extract(path, '([^/]+)$', 1) as last from p)
select fetch_id, case when last = '' then h when q <> '' then h || '_' || left(trim(regexp_replace(last, '[<>:"/\\|?*]', '_', 'g'), '. '), 200) else left(trim(regexp_replace(last, '[<>:"/\\|?*]', '_', 'g'), '. '), 200) end || '.md' as file_name
from n""")  # fmt: skip
def url_filenames(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").select("fetch_id", urls.url_filename(F.col("url")).alias("file_name"))


#: A token as services hand them out, and the forms in which each address is looked at besides its own: with userinfo, a
#: secret in the path, query or fragment, and hosts that are not public. {h} is its host, {p} its path.
_TOKEN = "Qx7Lm2Zp9Rt4Vb8Nc3Ws6Ky"
_FORMS = (
    "https://{h}{p}", "https://ann:pw@{h}{p}", "https://{h}/invite/" + _TOKEN + "{p}", "https://{h}{p}?page=2&access_token=abc", "https://{h}{p}#session=1", "https://{h}{p}#part", "ftp://{h}{p}", "HTTPS://{h}:8443{p}?q=1",
    "http://127.0.0.1{p}", "http://0x7f000001{p}", "http://2130706433{p}", "http://10.1.2.3:80{p}", "http://172.32.0.1{p}", "http://192.168.0.9{p}", "http://[::1]{p}", "http://localhost:3000{p}", "http://printer{p}", "http://{h}.internal{p}", "mailto:ann@{h}", "{p}",
)
_FORMS_SQL = "with u as (select distinct regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as p from fetch_cache where url is not null),\nf as (select cast(k as int) as form, replace(replace(t, '{h}', h), '{p}', p) as url from u, (values " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(_FORMS)) + ") v(k, t))"


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    """(form, url): every address in every form."""
    parts = table(spark, folder, "fetch_cache").where("url is not null").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("h"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("p")).distinct()
    return parts.select("h", "p", F.posexplode(F.array(*map(F.lit, _FORMS))).alias("form", "t")).select("form", F.replace(F.replace("t", F.lit("{h}"), F.col("h")), F.lit("{p}"), F.col("p")).alias("url"))


@query("url_redacted", _FORMS_SQL + r"""
select form, url, case when not regexp_matches(url, '^[A-Za-z]+://') then '[URL redacted]' else regexp_replace(regexp_replace(replace(regexp_replace(url, '[?#].*$', ''), '/""" + _TOKEN + r"""', '/[redacted]'), '//[^/@]*@', '//'), '^HTTPS', 'https') end as safe_url from f""")
def url_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(spark, folder).select("form", "url", urls.redact_url(F.col("url")).alias("safe_url"))


@query("url_remote_reasons", r"""select case when url is null then 'invalid_url' else 'allowed' end as reason, count(*) as pages from fetch_cache group by 1""")
def url_remote_reasons(spark: SparkSession, folder: str) -> DataFrame:
    reason = F.coalesce(urls.assess_remote(F.col("url")), F.lit("allowed"))
    return table(spark, folder, "fetch_cache").groupBy(reason.alias("reason")).agg(F.count("*").alias("pages"))


@query("url_entropy", r"""
with c as (select fetch_id, unnest(string_split(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]+)$', 1), '')) as ch from fetch_cache),
n as (select fetch_id, ch, count(*) as n from c group by all),
s as (select fetch_id, n / sum(n) over (partition by fetch_id) as p from n)
select fetch_id, round(-sum(p * log2(p)), 6) as entropy from s group by fetch_id""")
def url_entropy(spark: SparkSession, folder: str) -> DataFrame:
    last = F.regexp_extract(urls.url_part(F.col("url"), 3), "([^/]+)$", 1)
    return table(spark, folder, "fetch_cache").select("fetch_id", F.round(urls.entropy(last), 6).alias("entropy"))


@query("query_keys", r"""
with k as (select unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) as pair from fetch_cache where contains(url, '?'))
select trim(regexp_replace(lower(regexp_replace(regexp_replace(split_part(pair, '=', 1), '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_') as query_key, count(*) as n
from k group by 1""")
def query_keys(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "fetch_cache").select(F.explode(F.split(urls.url_part(F.col("url"), 4), "&")).alias("pair")).where("pair <> ''")
    return pairs.groupBy(urls.query_key(F.split_part("pair", F.lit("="), F.lit(1))).alias("query_key")).agg(F.count("*").alias("n"))


@query("secret_queries", _FORMS_SQL + r"""
select form, url from f where regexp_matches(url, '^[A-Za-z]+://[^/]*@|/""" + _TOKEN + r"""|[?&]access_token=|#session=')""")
def secret_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The forms of addresses that hold a secret."""
    return _forms(spark, folder).where(urls.has_credentials(F.col("url"))).select("form", "url")


# fetching

_BARE = r"trim(regexp_replace(regexp_replace(content, '[#*_\[\]()>`\-|]', '', 'g'), '\s+', ' ', 'g'))"


@query("fetch_decisions", rf"""
select fetch_id, {_HOST} as domain,
  case when exists (select 1 from spa_domains s where lower(s.domain) = {_HOST}) then 'playwright,defuddle,jina,cloudflare,static' else 'static,playwright,defuddle,jina,cloudflare' end as strategy_order,
  case when exists (select 1 from spa_domains s where lower(s.domain) = {_HOST}) then 'spa_or_pattern' else 'default' end as reason
from fetch_cache""")  # fmt: skip
def fetch_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return fetching.decide_pages(table(spark, folder, "fetch_cache"), table(spark, folder, "spa_domains"))


@query("browser_domains", rf"""
select fetch_id from fetch_cache where exists (select 1 from spa_domains s where {_HOST} = s.domain or ends_with({_HOST}, '.' || s.domain))""")
def browser_domains(spark: SparkSession, folder: str) -> DataFrame:
    host = urls.host_of(urls.url_part(F.col("url"), 2))
    parents = F.transform(F.sequence(F.lit(0), F.size(F.split(host, r"\.")) - 1), lambda i: F.array_join(F.slice(F.split(host, r"\."), i + 1, 100), "."))
    pages = table(spark, folder, "fetch_cache").select("fetch_id", F.explode(parents).alias("domain"))
    return pages.join(table(spark, folder, "spa_domains").select("domain").distinct(), "domain", "left_semi").select("fetch_id").distinct()


@query("needs_scripts", rf"""
select fetch_id, content is null or content = '' or
  regexp_matches(lower(content), 'javascript is disabled|javascript is required|please enable javascript|this page requires javascript|you need to enable javascript|enable javascript|requires javascript|this (page|site|website) requires javascript|you need (to enable )?javascript|checking (if the site connection is secure|your browser)|verifying (you are human|your browser)|ray id:')
  or regexp_matches(lower(content), '(?m)^(\s*#?\s*)?(just a moment|one moment)\.{{0,3}}\s*$')
  or length({_BARE}) < 100 or (length({_BARE}) < 500 and length(list_distinct(string_split(lower({_BARE}), ' '))) < 20) as scripts
from fetch_cache""")  # fmt: skip
def needs_scripts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").select("fetch_id", fetching.needs_scripts(F.col("content")).alias("scripts"))


@query("refusals", r"""
with c as (select fetch_id, content, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '!\[[^\]]*\]\([^)]+\)', '', 'g'), '\[[^\]]*\]\([^)]+\)', '', 'g'), '[#\-*_>\[\]`|]', '', 'g'), '\s+', ' ', 'g'))) as n from fetch_cache)
select fetch_id, case when content is null or trim(content) = '' then 'empty'
  when regexp_matches(content, '(?is)javascript is (not available|disabled)') then 'javascript_disabled' when regexp_matches(content, '(?i)please enable javascript') then 'javascript_required'
  when regexp_matches(content, '(?i)switch to a supported browser') then 'unsupported_browser' when regexp_matches(content, '(?is)something went wrong.*let''s give it another shot') then 'error_page'
  when regexp_matches(content, '(?is)log in.*sign up.*to continue') then 'login_required' when regexp_matches(content, '(?i)you must be logged in') then 'login_required'
  when regexp_matches(content, '(?i)checking your browser before accessing') then 'captcha_cloudflare' when n < 30 then 'too_short' end as reason
from c""")
def refusals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").select("fetch_id", fetching.refusal(F.col("content")).alias("reason"))


# caches

@query("fetch_keys", r"""select fetch_id, left(sha256('v1' || chr(0) || url || chr(0) || strategy_used), 32) as key from fetch_cache""")
def fetch_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").select("fetch_id", cache_tables.fetch_key(F.col("url"), F.col("strategy_used")).alias("key"))


@query("cache_latest", r"""
select cache_key, arg_max(fetch_id, struct_pack(a := created_at, b := fetch_id)) as fetch_id, max(created_at) as created_at from fetch_cache group by cache_key""")
def cache_latest(spark: SparkSession, folder: str) -> DataFrame:
    return cache_tables.latest_rows(table(spark, folder, "fetch_cache").select("cache_key", "fetch_id", "created_at"), "cache_key", "created_at", "fetch_id")


@query("cache_evicted", r"""
with w as (select fetch_id, accessed_at, size_bytes, sum(size_bytes) over (order by accessed_at desc, fetch_id desc rows unbounded preceding) as used from fetch_cache)
select fetch_id, accessed_at, size_bytes from w where used <= (select sum(size_bytes) // 3 from fetch_cache)""")
def cache_evicted(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of the cache when it may hold a third of its bytes."""
    pages = table(spark, folder, "fetch_cache").select("fetch_id", "accessed_at", "size_bytes")
    budget = (pages.agg(F.sum("size_bytes")).first()[0] or 0) // 3
    return cache_tables.evict(pages, budget, "size_bytes", "accessed_at", "fetch_id")


@query("cache_totals", r"""select count(*) as entries, coalesce(sum(size_bytes), 0) as size_bytes, round(coalesce(sum(size_bytes), 0) / (1024 * 1024), 2) as size_mb from fetch_cache""")
def cache_totals(spark: SparkSession, folder: str) -> DataFrame:
    return cache_tables.cache_totals(table(spark, folder, "fetch_cache"), "size_bytes")


@query("cache_by_strategy", r"""select case when coalesce(strategy_used, '') = '' then 'unknown' else strategy_used end as name, count(*) as entries, coalesce(sum(size_bytes), 0) as size_bytes from fetch_cache group by 1""")
def cache_by_strategy(spark: SparkSession, folder: str) -> DataFrame:
    return cache_tables.totals_by(table(spark, folder, "fetch_cache"), "strategy_used", "size_bytes")


@query("cache_recent", r"""select fetch_id, accessed_at, left(content, 200) as preview from fetch_cache order by accessed_at desc, fetch_id desc limit 20""")
def cache_recent(spark: SparkSession, folder: str) -> DataFrame:
    return cache_tables.recent_entries(table(spark, folder, "fetch_cache"), 20, "accessed_at", "fetch_id", "content")


@query("cache_validators", r"""
select cache_key, count(*) as deliveries, max(etag) as etag, count(distinct etag) as etags, bool_or(last_modified is not null) as dated from fetch_cache group by cache_key""")
def cache_validators(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").groupBy("cache_key").agg(F.count("*").alias("deliveries"), F.max("etag").alias("etag"), F.countDistinct("etag").alias("etags"), F.bool_or(F.col("last_modified").isNotNull()).alias("dated"))


@query("cache_not_modified", r"""
with w as (select fetch_id, cache_key, etag, lag(etag) over (partition by cache_key order by created_at, fetch_id) as before from fetch_cache)
select fetch_id, cache_key, coalesce(etag = before, false) as unchanged from w""")
def cache_not_modified(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each delivery has the tag of the one before it. Ranks within a key join each row to the one before."""
    ranked = ranked_within(table(spark, folder, "fetch_cache").select("fetch_id", "cache_key", "etag", "created_at"), ["cache_key"], ["created_at", "fetch_id"])
    before = ranked.select(F.col("cache_key").alias("k"), (F.col("rank") + 1).alias("r"), F.col("etag").alias("before"))
    return ranked.join(before, F.col("cache_key").eqNullSafe(F.col("k")) & (F.col("rank") == F.col("r")), "left").select("fetch_id", "cache_key", F.coalesce(F.col("etag") == F.col("before"), F.lit(False)).alias("unchanged"))


@query("spa_expired", r"""
with t as (select domain, hits, coalesce(nullif(last_hit, ''), learned_at) as seen from spa_domains),
p as (select domain, hits, try_cast(case when regexp_matches(seen, '([+-]\d\d:?\d\d|Z)$') then seen else seen || 'Z' end as timestamptz) as seen_at from t)
select domain, hits, coalesce(seen_at < timestamptz '2025-12-01 00:00:00+00' - interval 30 days, true) as expired from p""")
def spa_expired(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "spa_domains").select("domain", "hits", cache_tables.is_expired(F.col("learned_at"), F.col("last_hit"), F.expr("timestamp'2025-12-01 00:00:00Z'")).alias("expired"))


@query("spa_recorded", rf"""
with f as (select {_HOST} as domain, count(*) as more from fetch_cache where strategy_used = 'playwright' group by 1)
select coalesce(s.domain, f.domain) as domain, coalesce(s.learned_at, '2025-12-01T00:00:00Z') as learned_at, coalesce(s.hits, 0) + coalesce(f.more, 0) as hits, case when f.more is not null then '2025-12-01T00:00:00Z' else s.last_hit end as last_hit
from spa_domains s full outer join f on s.domain = f.domain""")
def spa_recorded(spark: SparkSession, folder: str) -> DataFrame:
    return cache_tables.record_domains(table(spark, folder, "spa_domains"), table(spark, folder, "fetch_cache").where("strategy_used = 'playwright'"), "2025-12-01T00:00:00Z")


@query("spa_by_hits", r"""select domain, hits from spa_domains order by hits desc, domain""")
def spa_by_hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "spa_domains").select("domain", "hits").orderBy(F.col("hits").desc(), "domain")


# batch state and usage

_STATE = r"""
r as (select *, row_number() over (partition by item_key order by seq desc, logged_at desc, log_id desc) as rn from state_log),
state as (select item_key, seq, case when status = 'in_progress' then 'failed' else status end as status, output_path, error_text from r where rn = 1)"""


@query("state_replayed", f"with {_STATE} select * from state")
def state_replayed(spark: SparkSession, folder: str) -> DataFrame:
    return batch_state.replay(table(spark, folder, "state_log"))


@query("state_counts", f"""with {_STATE}
select count(*) as total, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, count(*) filter (status in ('failed', 'pending')) as pending, count(*) filter (status = 'completed' and output_path is null) as skipped from state""")
def state_counts(spark: SparkSession, folder: str) -> DataFrame:
    return batch_state.status_counts(state_replayed(spark, folder))


@query("state_exit_code", f"""with {_STATE} select case when count(*) filter (status = 'failed') = 0 then 0 when count(*) filter (status = 'completed') > 0 then 10 else 1 end as exit_code from state""")
def state_exit_code(spark: SparkSession, folder: str) -> DataFrame:
    return state_counts(spark, folder).select(batch_state.exit_code(F.col("completed"), F.col("failed")).alias("exit_code"))


@query("state_resumed", f"""with {_STATE}, f as (select distinct regexp_extract(url, '^([^?#]*)', 1) as item_key from fetch_cache)
select coalesce(s.item_key, f.item_key) as item_key, case when s.status is null then 'new' when s.status = 'completed' then 'keep' else 'retry' end as action from state s full outer join f on s.item_key = f.item_key""")
def state_resumed(spark: SparkSession, folder: str) -> DataFrame:
    return batch_state.resume(state_replayed(spark, folder), table(spark, folder, "fetch_cache").select(F.regexp_extract("url", "^([^?#]*)", 1).alias("item_key")))


@query("state_attempts", r"""
with o as (select item_key, seq, max(status) as status from state_log group by all)
select item_key, count(*) as writes, count(*) filter (status = 'failed') as failures, coalesce(max(case when status = 'completed' then seq end) > min(case when status = 'failed' then seq end), false) as recovered from o group by item_key""")
def state_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return batch_state.attempts(table(spark, folder, "state_log"))


@query("state_by_host", f"""with {_STATE}
select lower(regexp_extract(item_key, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) as host, count(*) as total, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, round(count(*) filter (status = 'completed') / count(*), 6) as completed_share from state group by 1""")
def state_by_host(spark: SparkSession, folder: str) -> DataFrame:
    return batch_state.url_report(state_replayed(spark, folder))


@query("state_durations", r"""
with d as (select item_key, round((epoch_us(max(logged_at)) - epoch_us(min(logged_at))) / 1e6, 3) as seconds from state_log group by item_key)
select item_key, seconds, case when seconds < 60 then printf('%.1f', floor(seconds * 10 + 0.499999999) / 10) || 's' when seconds < 3600 then lpad(cast(cast(floor(seconds) as bigint) // 60 as varchar), 2, '0') || ':' || lpad(cast(cast(floor(seconds) as bigint) % 60 as varchar), 2, '0')
  else case when seconds < 36000 then '0' else '' end || cast(cast(floor(seconds) as bigint) // 3600 as varchar) || ':' || lpad(cast(cast(floor(seconds) as bigint) // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(cast(floor(seconds) as bigint) % 60 as varchar), 2, '0') end as shown from d""")
def state_durations(spark: SparkSession, folder: str) -> DataFrame:
    return batch_state.item_durations(table(spark, folder, "state_log"))


@query("usage_by_model", r"""select case when coalesce(model_name, '') = '' then 'unknown' else model_name end as model_name, coalesce(sum(requests), 0) as requests, coalesce(sum(input_tokens), 0) as input_tokens, coalesce(sum(output_tokens), 0) as output_tokens, round(coalesce(sum(cost_usd), 0), 6) as cost_usd from item_usage group by 1""")
def usage_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return batch_state.usage_by_model(table(spark, folder, "item_usage"))


@query("usage_totals", r"""select coalesce(sum(requests), 0) as requests, coalesce(sum(input_tokens), 0) as input_tokens, coalesce(sum(output_tokens), 0) as output_tokens, round(coalesce(sum(cost_usd), 0), 6) as cost_usd from item_usage""")
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    return batch_state.usage_totals(table(spark, folder, "item_usage"))


@query("usage_of_items", r"""select item_key, list_aggregate(list_sort(list(distinct coalesce(model_name, ''))), 'string_agg', ',') as models, sum(requests) as requests, sum(input_tokens + output_tokens) as tokens, round(coalesce(sum(cost_usd), 0), 6) as cost_usd from item_usage group by item_key""")
def usage_of_items(spark: SparkSession, folder: str) -> DataFrame:
    return batch_state.usage_of_items(table(spark, folder, "item_usage"))


@query("output_names", r"""
with k as (select distinct regexp_extract(url, '^([^?#]*)', 1) as item_key from fetch_cache),
n as (select item_key, regexp_extract(item_key, '([a-z]+)-[^/]*$', 1) || '.md' as name from k),
r as (select *, row_number() over (partition by lower(name) order by item_key) as rn from n)
select item_key, case when rn = 1 then name else regexp_replace(name, '\.md$', '') || ' (' || rn || ').md' end as output_name from r""")
def output_names(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "fetch_cache").select(F.regexp_extract("url", "^([^?#]*)", 1).alias("item_key")).distinct()
    return batch_state.free_name(items.select("item_key", F.concat(F.regexp_extract("item_key", "([a-z]+)-[^/]*$", 1), F.lit(".md")).alias("name")))


# text

@query("word_counts", r"""
select doc_id, length(regexp_replace(text, '[^\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}]', '', 'g')) +
  length(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}]', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) as words
from documents where text is not null""")
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.count_words(F.col("text")).alias("words"))


@query("token_estimates", r"""
with c as (select doc_id, length(text) as n, length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) as cjk from documents where text is not null)
select doc_id, cast(floor(cjk * 1.5) + floor((n - cjk) / 4) as bigint) as tokens from c""")
def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("garbled_pages", r"""
with c as (select ocr_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as n, length(regexp_replace(text, '[^AEIOUaeiou]', '', 'g')) as v from ocr_results where text is not null)
select ocr_id, n >= 40 and v * 5 < n as garbled from c""")
def garbled_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_results").where("text is not null").select("ocr_id", text.is_garbled(F.col("text")).alias("garbled"))


@query("text_languages", r"""
with c as (select doc_id, length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) as cjk, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as latin from documents where text is not null)
select doc_id, case when cjk >= 4 and cjk >= latin then 'zh' else 'en' end as language from c""")
def text_languages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.language_of(F.col("text")).alias("language"))


@query("document_titles", r"""
with b as (select doc_id, regexp_replace(text, '^\s*---[ \t]*\n(?:[^-\n][^\n]*\n|-[^-\n][^\n]*\n|\n)*---[ \t]*(?:\n|$)', '') as t from documents where text is not null),
l as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as line_no from b),
g as (select *, regexp_extract(line, '^(`{3,}|~{3,})', 1) as mark, coalesce(sum(case when regexp_matches(line, '^(`{3,}|~{3,})') then 1 else 0 end) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as before from l)
select b.doc_id, nullif(trim(rtrim(regexp_extract(arg_min(g.line, g.line_no), '^#[ \t]+(\S[^\n]*)$', 1), chr(13))), '') as h1
from b left join g on g.doc_id = b.doc_id and g.mark = '' and g.before % 2 = 0 and regexp_matches(g.line, '^#[ \t]+\S') group by b.doc_id""")
def document_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The first level-one heading outside code and front matter of every document with text."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.first_heading(F.col("text"), 1).alias("h1"))


@query("resolved_titles")
def resolved_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The title of every document: its own, else its text's, else its source's."""
    return table(spark, folder, "documents").select("doc_id", text.resolve_title(F.col("title"), F.col("text"), F.concat("source", F.lit("."), "fmt")).alias("title"))


@query("frontmatter_titles", r"""select doc_id, regexp_extract(text, '^---\ntitle: ([^\n]*)\n', 1) as title from documents where regexp_matches(text, '^---\ntitle: [^\n]*\n')""")
def frontmatter_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.frontmatter_title(F.col("text")).alias("title")).where("title is not null")


@query("frontmatter_blocks", r"""
select doc_id, '---' || chr(10) || array_to_string(list_filter([case when trim(coalesce(title, '')) <> '' then 'title: "' || regexp_replace(replace(replace(title, '\', '\\'), '"', '\"'), '\s+', ' ', 'g') || '"' end, case when trim(coalesce(source, '')) <> '' then 'source: "' || source || '"' end, case when trim(coalesce(lang, '')) <> '' then 'lang: "' || lang || '"' end], lambda x: x is not null), chr(10)) || chr(10) || '---' || chr(10) as block from documents""")
def frontmatter_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", frontmatter({"title": F.col("title"), "source": F.col("source"), "lang": F.col("lang")}).alias("block"))


@query("source_titles", r"""
select fetch_id, case when last = '' then host else regexp_replace(last, '(.)\.[^.]+$', '\1') end as title from (select fetch_id, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '://[^/]*/(?:[^/]*/)*([^/]+)/*$', 1) as last, regexp_extract(url, '://([^/?#]*)', 1) as host from fetch_cache)""")
def source_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").select("fetch_id", text.source_title(F.col("url")).alias("title"))


@query("file_formats", r"""select fmt, count(*) as n from documents group by fmt""")
def file_formats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy(text.detect_format(F.concat(F.lit("a/b.c/x."), F.upper("fmt"))).alias("fmt")).agg(F.count("*").alias("n"))


@query("article_quality", r"""
with p as (select fetch_id, content, trim(regexp_replace(regexp_replace(content, '[#*_\[\]()>`\-|!]', '', 'g'), '\s+', ' ', 'g')) as plain from fetch_cache),
q as (select fetch_id, trim(content) = '' as e, length(plain) < 10 as a, (case when plain = '' then 0 else length(string_split(plain, ' ')) end) < 3 and not (regexp_matches(plain, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}]') and length(replace(plain, ' ', '')) >= 10) as b from p)
select fetch_id, not e and not a and not b as accepted, case when e then 0.0 else greatest(0.0, round(1.0 - case when a then 0.6 else 0.0 end - case when b then 0.4 else 0.0 end, 6)) end::double as score, case when e then 'empty_content' when a or b then 'too_short' else '' end as reasons from q""")
def article_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.assess(F.col("content"), F.lit("generic_article"))
    return table(spark, folder, "fetch_cache").select("fetch_id", found.alias("q")).select("fetch_id", F.col("q.accepted").alias("accepted"), F.col("q.score").cast("double").alias("score"), F.array_join("q.reasons", ",").alias("reasons"))


@query("thread_quality", r"""
with p as (select doc_id, trim(regexp_replace(regexp_replace(text, '[#*_\[\]()>`\-|!]', '', 'g'), '\s+', ' ', 'g')) as plain from documents where fmt = 'html' and trim(text) <> '')
select doc_id, (case when plain = '' then 0 else length(string_split(plain, ' ')) end) >= 10 as accepted from p""")
def thread_quality(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("fmt = 'html' and trim(text) <> ''").select("doc_id", quality.assess(F.col("text"), F.lit("conversation_thread"))["accepted"].alias("accepted"))


@query("normal_texts", r"""
select meta_id, lower(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(description, '[‘’]', '''', 'g'), '[“”]', '"', 'g'), '[–—]', '-', 'g'), '…', '...'), '\s+', ' ', 'g'))) as normal from web_metadata where description is not null""")
def normal_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "web_metadata").where("description is not null").select("meta_id", text.normalize_text(F.col("description")).alias("normal"))


# documents as relations

@query("unique_paragraphs", r"""
with p as (select doc_id, unnest(regexp_split_to_array(text, '\n\n+')) as p, generate_subscripts(regexp_split_to_array(text, '\n\n+'), 1) as i from documents where text is not null),
k as (select *, trim(regexp_replace(p, '\s+', ' ', 'g')) as key from p),
r as (select *, row_number() over (partition by doc_id, key order by i) as rn from k where key <> '')
select doc_id, string_agg(p, chr(10) || chr(10) order by i) as text from r where length(key) < 100 or rn = 1 group by doc_id""")
def unique_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return documents.unique_paragraphs(table(spark, folder, "documents"), "doc_id", "text").where("text <> ''")


@query("marked_pages", r"""
with d as (select doc_id, regexp_split_to_array(text, '<!-- (?:Page|Slide) (?:number: ?)?\d+ -->') as parts, regexp_extract_all(text, '<!-- (?:Page|Slide) (?:number: ?)?(\d+) -->', 1) as nums from documents where regexp_matches(text, '<!-- (Page|Slide) (number: ?)?\d+ -->'))
select doc_id, cast(unnest(nums) as int) as page_no, unnest(parts[2:]) as text from d""")
def marked_pages(spark: SparkSession, folder: str) -> DataFrame:
    return documents.marked_pages(table(spark, folder, "documents"), "doc_id", "text")


@query("running_keys", r"""
with l as (select scan_id, page_no, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from ocr_results where text is not null),
f as (select *, row_number() over (partition by scan_id, page_no order by pos) as a, row_number() over (partition by scan_id, page_no order by pos desc) as z from l where trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''),
e as (select distinct scan_id, page_no, regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g') as key from f where (a <= 2 or z <= 2) and not regexp_matches(line, '^\s*[#|]')),
n as (select scan_id, count(*) as pages from ocr_results where text is not null group by scan_id)
select scan_id, key, count(*) as on_pages from e join n using (scan_id) where pages >= 4 group by scan_id, key, pages having count(*) >= greatest(3, ceil(pages * 0.6))""")
def running_keys(spark: SparkSession, folder: str) -> DataFrame:
    return documents.running_keys(table(spark, folder, "ocr_results").where("text is not null"), "scan_id", "page_no", "text")


@query("stripped_pages")
def stripped_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every scanned page without the lines that stand at the edge of most pages of its scan."""
    return documents.strip_running(table(spark, folder, "ocr_results").where("text is not null"), "scan_id", "page_no", "text")


@query("scanned_documents", r"""
with r as (select scan_id, length(coalesce(text, '')) as n, row_number() over (partition by scan_id order by page_no) as rn from ocr_results)
select scan_id, round(avg(n), 6) as mean_length, avg(n) < 100 as scanned from r where rn <= 3 group by scan_id""")
def scanned_documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents.scanned_documents(table(spark, folder, "ocr_results"), "scan_id", "page_no", "text")


@query("page_advice", r"""
with t as (select ocr_id, cast(v as int) as form, case v when 0 then text when 1 then left(text, 40) else regexp_replace(text, '[aeiouAEIOU]', 'x', 'g') end as text from ocr_results, (values (0), (1), (2)) f(v)),
c as (select ocr_id, form, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as a, length(regexp_replace(text, '[^AEIOUaeiou]', '', 'g')) as v, length(regexp_replace(text, '[^一-鿿぀-ヿ가-힯]', '', 'g')) as j from t)
select ocr_id, form, case when n < 50 then 'scanned' else 'garbled' end as advice from c where n < 50 or (a >= 40 and v * 5 < a and j < a)""")
def page_advice(spark: SparkSession, folder: str) -> DataFrame:
    """Advice on every page as it is, with its beginning alone, and with its vowels lost."""
    forms = F.array(F.col("text"), F.substring("text", 1, 40), F.regexp_replace("text", "[aeiouAEIOU]", "x"))
    pages = table(spark, folder, "ocr_results").select("ocr_id", F.posexplode(forms).alias("form", "text")).withColumn("page", F.struct("ocr_id", "form"))
    return documents.page_advice(pages, "page", "text").select("page.ocr_id", "page.form", "advice")


@query("inline_links", r"""
with l as (select doc_id, regexp_extract_all(replace(text, '![', '<'), '\[([^\[\]]*)\]\(([^()\s]+)\)') as found from documents where text is not null)
select doc_id, count(*) as n_links from (select doc_id, unnest(found) as x from l) group by doc_id""")
def inline_links(spark: SparkSession, folder: str) -> DataFrame:
    return documents.links(table(spark, folder, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_links"))


@query("hash_headings", r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where text is not null),
m as (select *, regexp_extract(line, '^(`{3,}|~{3,})', 1) as mark from l),
g as (select *, coalesce(sum(case when mark <> '' then 1 else 0 end) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as before from m)
select doc_id, cast(line_no as int) as line_no, cast(length(regexp_extract(line, '^(#+)', 1)) as int) as level, trim(regexp_replace(regexp_extract(line, '^#{1,6}\s+([^\r]*)', 1), '\s+#+\s*$', '')) as heading
from g where mark = '' and before % 2 = 0 and regexp_matches(line, '^#{1,6}\s+\S')""")
def hash_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Every hash heading of the documents outside code."""
    return documents.headings(table(spark, folder, "documents"), "doc_id", "text")


@query("repeated_tails")
def repeated_tails(spark: SparkSession, folder: str) -> DataFrame:
    """How often the last line of every document stands at its end, from six times on."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", documents.repeated_tail(F.col("text")).alias("repeated"))


@query("embedded_images")
def embedded_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images that documents carry in their text, the first of each content."""
    return images.first_of_each(images.embedded(table(spark, folder, "documents"), "doc_id", "text"), "doc_id", "pos", "md5")


# threads

_COMMENTS = r"^((?:> ?)*)\*\*([^*]+)\*\* · (\d+) min$"


def _comments(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "documents").where("fmt = 'html' and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(_COMMENTS))
    return lines.select(F.col("doc_id").alias("thread_id"), "pos", F.regexp_count("line", F.lit("> ?")).alias("depth"), F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("id"), F.regexp_extract("line", _COMMENTS, 2).alias("author"))


_COMMENTS_SQL = r"""
with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where fmt = 'html' and text is not null),
c as (select doc_id as thread_id, cast(pos as int) as pos, cast(length(regexp_replace(regexp_extract(line, '^((?:> ?)*)', 1), '[^>]', '', 'g')) as int) as depth, doc_id || '-' || pos as id from l where regexp_matches(line, '^(?:> ?)*\*\*[^*]+\*\* · \d+ min\r?$')),
b as (select a.thread_id, a.id, a.pos, a.depth, max(o.pos) as at from c a left join c o on o.thread_id = a.thread_id and o.pos < a.pos and o.depth < a.depth group by all),
p as (select b.thread_id, b.id, b.pos, b.depth, c.id as parent_id from b left join c on c.thread_id = b.thread_id and c.pos = b.at and c.depth = b.depth - 1)"""


@query("comment_depths", r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where fmt = 'html' and text is not null)
select doc_id as thread_id, cast(pos as int) as pos, cast(length(regexp_replace(regexp_extract(line, '^((?:> ?)*)', 1), '[^>]', '', 'g')) as int) as depth from l where regexp_matches(line, '^(?:> ?)*\*\*[^*]+\*\* · \d+ min\r?$')""")
def comment_depths(spark: SparkSession, folder: str) -> DataFrame:
    return _comments(spark, folder).select("thread_id", "pos", "depth")


@query("comment_parents", _COMMENTS_SQL + """
select thread_id, id, pos, depth, parent_id from p""")
def comment_parents(spark: SparkSession, folder: str) -> DataFrame:
    """The parent of every comment, by depth."""
    return threads.parents_by_depth(_comments(spark, folder))


@query("comment_paths", _COMMENTS_SQL + """,
r as (select thread_id, id, 0 as depth, lpad(cast(pos as varchar), 20, '0') as path from p where parent_id is null
  union all select p.thread_id, p.id, least(r.depth + 1, 12), r.path || '/' || lpad(cast(p.pos as varchar), 20, '0') from p join r on p.thread_id = r.thread_id and p.parent_id = r.id)
select thread_id, id, cast(depth as int) as depth, path from r""")
def comment_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every comment in its reply tree."""
    return threads.reply_paths(comment_parents(spark, folder))


# HTML

_HTML = "static_content rlike '<(p|h[1-6]|ul|ol|article|div)[ >]'"


@query("html_tags", r"""
with h as (select static_content as s from fetch_cache where regexp_matches(static_content, '<(p|h[1-6]|ul|ol|article|div)[ >]'))
select tag, sum(length(regexp_extract_all(s, '(?i)<' || tag || '[ >]'))) as n from h, (values ('h1'), ('h2'), ('h3'), ('li'), ('ul'), ('ol'), ('blockquote'), ('nav'), ('aside'), ('footer')) as t(tag) group by tag having sum(length(regexp_extract_all(s, '(?i)<' || tag || '[ >]'))) > 0""")
def html_tags(spark: SparkSession, folder: str) -> DataFrame:
    return _tags(table(spark, folder, "fetch_cache").where(_HTML))


def _tags(pages: DataFrame) -> DataFrame:
    return html_nodes.tag_counts(html_nodes.parse_nodes(pages, "fetch_id", "static_content")).where(F.col("tag").isin("h1", "h2", "h3", "li", "ul", "ol", "blockquote", "nav", "aside", "footer"))


@query("html_main")
def html_main(spark: SparkSession, folder: str) -> DataFrame:
    """The element taken for the content of each HTML page."""
    pages = table(spark, folder, "fetch_cache").where("static_content is not null").select("fetch_id", F.concat(F.lit("<body>"), "static_content", F.lit("</body>")).alias("html"))
    return html_nodes.main_nodes(html_nodes.parse_nodes(pages, "fetch_id", "html"))


@query("html_texts")
def html_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each HTML page's content without hidden, active and noise elements."""
    pages = table(spark, folder, "fetch_cache").where(_HTML).select("fetch_id", F.concat(F.lit("<body>"), "static_content", F.lit("</body>")).alias("html"))
    from .plans.shared import materialise

    return html_nodes.main_texts(materialise(html_nodes.parse_nodes(pages, "fetch_id", "html"), "nodes"))


@query("html_markdown")
def html_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Each HTML page as Markdown."""
    return render.render_pages(table(spark, folder, "fetch_cache").where(_HTML), "fetch_id", "static_content")


@query("html_links")
def html_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the HTML pages."""
    return html_nodes.link_relation(html_nodes.parse_nodes(table(spark, folder, "fetch_cache").where(_HTML), "fetch_id", "static_content"))


# tables of the star schema, for the plain relational operators that the pages' reports are made of

@query("site_pages", r"""
with m as (select distinct cache_key, regexp_replace(regexp_replace(lower(trim(domain)), ':\d*$', ''), '^www\.', '') as source from web_metadata where domain is not null and cache_key is not null)
select s.site, s.lang, count(distinct f.cache_key) as pages, sum(f.size_bytes) as size_bytes from fetch_cache f join m using (cache_key) join sites s on regexp_replace(regexp_replace(lower(trim(s.domain)), ':\d*$', ''), '^www\.', '') = m.source group by s.site, s.lang""")
def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and bytes by site. Bytes are summed by key before the joins, so a hot key moves one row."""
    pages = table(spark, folder, "fetch_cache").groupBy("cache_key").agg(F.sum("size_bytes").alias("size_bytes"))
    metas = table(spark, folder, "web_metadata").where("cache_key is not null and domain is not null").select("cache_key", source_key(F.col("domain")).alias("source")).distinct()
    sites = table(spark, folder, "sites").select(source_key(F.col("domain")).alias("source"), "site", "lang")
    return pages.join(metas, "cache_key").join(sites, "source").groupBy("site", "lang").agg(F.count_distinct("cache_key").alias("pages"), F.sum("size_bytes").alias("size_bytes"))


@query("event_windows", r"""
select time_bucket(interval 10 minutes, ts) as window_start, event_type as kind, count(*) as events from events group by 1, 2""")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    from .streaming.jobs import progress_windows

    events = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    return progress_windows(events).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "kind", "events")


@query("pricing_summary", r"""
select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


# Markdown texts whose repair depends on order, and sections

@query("markdown_normalized")
def markdown_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with links, slide footers, images and spacing mended."""
    return text_map.normalized_markdown(table(spark, folder, "documents"), "doc_id", "text")


@query("markdown_round_trips", r"""select doc_id, md5(regexp_replace(text, '\s+', '', 'g')) as digest from documents where text is not null""")
def markdown_round_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Every document after its marks are taken out and put back, blanks aside: nothing but blanks may change."""
    made = text_map.protected_round_trip(table(spark, folder, "documents").where("text is not null"), "doc_id", "text")
    return made.select("doc_id", F.md5(F.regexp_replace("text", r"\s+", "")).alias("digest"))


@query("repeated_blocks_dropped")
def repeated_blocks_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """Contents of pages without long lines that stand in one before."""
    return markdown_blocks.unrepeated_blocks(table(spark, folder, "fetch_cache"), "fetch_id", "content")


@query("degenerate_tails")
def degenerate_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with one of the units that their end repeats."""
    from .functions.markdown_text import cut_repeated_tail

    return text_map.map_text(table(spark, folder, "documents"), "doc_id", "text", cut_repeated_tail)


@query("rendering_scores")
def rendering_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How well the browser's text of a page renders its content."""
    pages = table(spark, folder, "fetch_cache").where("browser_content is not null")
    return markdown_blocks.rendering_scores(pages, "fetch_id", "content", "browser_content")


@query("document_sections", r"""
with d as (select doc_id, regexp_extract_all(text, '<!-- (?:Page|Slide) (?:number: ?)?\d+ -->') as marks, regexp_split_to_array(text, '<!-- (?:Page|Slide) (?:number: ?)?\d+ -->') as parts from documents where regexp_matches(text, '<!-- (Page|Slide) (number: ?)?\d+ -->')),
e as (select doc_id, unnest(marks) as mark, generate_subscripts(marks, 1) - 1 as pos, unnest(parts[2:]) as part from d)
select doc_id, cast(pos as int) as pos, lower(regexp_extract(mark, '(Page|Slide)', 1)) || ':' || regexp_extract(mark, '(\d+)', 1) as section_id, length(trim(part)) as size from e""")
def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    return sections.sections(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "pos", "section_id", F.char_length("body").alias("size"))


@query("document_fingerprints", r"""select doc_id, sha256(left(text, 50000) || '|' || source) as digest from documents where text is not null""")
def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", sections.fingerprint(F.col("text"), F.array("source")).alias("digest"))


@query("document_batches", r"""
select doc_id, source, cast((row_number() over (partition by source order by doc_id) - 1) // 10 as int) as batch_no from documents where source is not null""")
def document_batches(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "documents").where("source is not null").select("doc_id", "source")
    return sections.batches(items, "source", "doc_id", 10).select("doc_id", "source", "batch_no")


@query("smart_cuts", r"""
with h as (select doc_id, text, left(text, 1100) as head from documents where text is not null),
p as (select *, regexp_extract(head, '(?s)^(.*)\n\n', 1) as para, regexp_extract(head, '(?s)^(.*[.!?。！？])(?:\s|\z)', 1) as sent from h)
select doc_id, length(case when length(text) <= 1000 then text when length(para) >= 300 then para when length(sent) >= 300 then sent else left(text, 1000) end) as size from p""")
def smart_cuts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.char_length(text.smart_cut(F.col("text"), 1000)).alias("size"))


@query("job_timeouts", r"""
with c as (select ocr_id, length(coalesce(text, '')) as n from ocr_results)
select ocr_id, cast(floor(greatest(30, least((30 + n / 50.0 + (n // 4) / 4.0) * 1.5, 600))) as int) as seconds from c""")
def job_timeouts(spark: SparkSession, folder: str) -> DataFrame:
    """A time limit for each scanned page by its length."""
    chars = F.char_length(F.coalesce("text", F.lit("")))
    return table(spark, folder, "ocr_results").select("ocr_id", text.timeout_seconds(F.lit(30), chars, 50.0, F.floor(chars / 4), F.lit(1), 1.5, 10.0, 600.0).alias("seconds"))


_READ_FORMS = ("https://{h}{p}", "https://github.com{p}", "https://github.com/ann/boats", "https://www.github.com/ann/boats/issues/12", "https://news.ycombinator.com/item?id=5", "https://news.ycombinator.com{p}", "https://old.reddit.com/r/boats/comments/5/x", "https://x.com/ann/status/77", "https://twitter.com/ann", "https://www.youtube.com/watch?v=abc")


@query("page_readers", "with u as (select distinct regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as p from fetch_cache where url is not null),\nf as (select cast(k as int) as form, replace(replace(t, '{h}', h), '{p}', p) as url from u, (values " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(_READ_FORMS)) + r""") v(k, t))
select form, url, case when regexp_matches(url, '//(www\.)?github\.com/[^/]+/[^/]+/(issues|pull)/\d+') then 'issue' when regexp_matches(url, '//(www\.)?github\.com/[^/?#]+/[^/?#]+/?([?#]|$)') then 'repository' when regexp_matches(url, '//news\.ycombinator\.com/item') then 'news_thread'
  when regexp_matches(url, '//(www\.|old\.)?reddit\.com/.*comments/') then 'forum_thread' when regexp_matches(url, '//(www\.|mobile\.)?(x|twitter)\.com/.*/status/\d+') then 'post' when regexp_matches(url, '//(www\.)?youtube\.com/watch') then 'video' end as reader from f""")
def page_readers(spark: SparkSession, folder: str) -> DataFrame:
    """The reader of every address, and of addresses of known sites."""
    parts = table(spark, folder, "fetch_cache").where("url is not null").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("h"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("p")).distinct()
    forms = parts.select("h", "p", F.posexplode(F.array(*map(F.lit, _READ_FORMS))).alias("form", "t")).select("form", F.replace(F.replace("t", F.lit("{h}"), F.col("h")), F.lit("{p}"), F.col("p")).alias("url"))
    return forms.select("form", "url", site_pages_ops.reader_of(F.col("url")).alias("reader"))


@query("noise_report")
def noise_report(spark: SparkSession, folder: str) -> DataFrame:
    """Subtrees that each rule takes out of the HTML pages."""
    from .plans.shared import materialise

    pages = table(spark, folder, "fetch_cache").where(_HTML)
    return noise.report(materialise(html_nodes.parse_nodes(pages, "fetch_id", "static_content"), "nodes"))


@query("html_outline", r"""
with h as (select fetch_id, static_content as s from fetch_cache where regexp_matches(static_content, '<(p|h[1-6]|ul|ol|article|div)[ >]'))
select level, count(*) as headings from (select unnest(regexp_extract_all(s, '(?i)<h([1-6])[ >]', 1)) as level from h) group by level""")
def html_outline(spark: SparkSession, folder: str) -> DataFrame:
    return _outline(table(spark, folder, "fetch_cache").where(_HTML))


def _outline(pages: DataFrame) -> DataFrame:
    nodes = html_nodes.parse_nodes(pages, "fetch_id", "static_content")
    return html_nodes.heading_outline(nodes).groupBy(F.col("level").cast("string").alias("level")).agg(F.count("*").alias("headings"))


# paths, extraction and reports

@query("media_types", r"""
select fmt, count(*) as n, max(case fmt when 'html' then 'text/html' when 'md' then 'text/markdown' when 'txt' then 'text/plain' when 'pdf' then 'application/pdf' when 'eml' then 'message/rfc822' when 'ipynb' then 'application/x-ipynb+json'
  when 'pptx' then 'application/vnd.openxmlformats-officedocument.presentationml.presentation' when 'xlsx' then 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' end) as media_type from documents group by fmt""")
def media_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("fmt").agg(F.count("*").alias("n"), F.max(paths.media_type(F.concat(F.lit("x."), "fmt"))).alias("media_type"))


@query("versioned_outputs", r"""
with r as (select fetch_id, regexp_extract(url, '^([^?#]*)', 1) as item_key, row_number() over (partition by regexp_extract(url, '^([^?#]*)', 1) order by fetch_id) as v from fetch_cache)
select fetch_id, case when v < 2 then 'page.llm.md' else 'page.v' || v || '.llm.md' end as output_name from r""")
def versioned_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """The name of every delivery of a page when none may replace another."""
    items = table(spark, folder, "fetch_cache").select("fetch_id", F.regexp_extract("url", "^([^?#]*)", 1).alias("item_key"))
    return ranked_within(items, ["item_key"], ["fetch_id"]).select("fetch_id", paths.versioned(F.lit("page.llm.md"), F.col("rank") + 1).alias("output_name"))


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    from .plans.shared import materialise

    pages = table(spark, folder, "fetch_cache").where(_HTML).select("fetch_id", F.concat(F.lit("<body>"), "static_content", F.lit("</body>")).alias("html"))
    return materialise(html_nodes.parse_nodes(pages, "fetch_id", "html"), "nodes")


@query("extraction_levels")
def extraction_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The level at which the content of each HTML page is extracted."""
    return extraction.extraction_levels(_nodes(spark, folder))


@query("content_starts")
def content_starts(spark: SparkSession, folder: str) -> DataFrame:
    """The first prose block of each HTML page."""
    return extraction.content_start(_nodes(spark, folder))


@query("item_reports")
def item_reports(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON report for each item of the log."""
    return reports.item_reports(state_replayed(spark, folder), table(spark, folder, "item_usage"))


@query("run_report", f"""with {_STATE}, t as (select epoch_us(max(logged_at)) - epoch_us(min(logged_at)) as us from state_log), s as (select cast(floor(us / 1e6) as bigint) as s from t)
select '{{"summary":{{"total":' || count(*) || ',"completed":' || count(*) filter (status = 'completed') || ',"failed":' || count(*) filter (status = 'failed') || '}},"duration":"' ||
  (select case when s < 3600 then lpad(cast(s // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') else case when s < 36000 then '0' else '' end || cast(s // 3600 as varchar) || ':' || lpad(cast(s // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') end from s) || '"}}' as report from state""")
def run_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.run_report(state_replayed(spark, folder), table(spark, folder, "state_log"))


@query("source_reports", f"""with {_STATE}, k as (select *, lower(regexp_extract(item_key, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) as host from state)
select host, '{{"total":' || count(*) || ',"completed":' || count(*) filter (status = 'completed') || ',"failed":' || count(*) filter (status = 'failed') || '}}' as report from k group by host""")
def source_reports(spark: SparkSession, folder: str) -> DataFrame:
    items = state_replayed(spark, folder).withColumn("host", urls.host_of(urls.url_part(F.col("item_key"), 2)))
    return reports.by_source(items, "host")


_WRITES = r"""
d as (select *, row_number() over (partition by item_key, seq order by status desc, output_path desc nulls last) as rn from state_log where status in ('completed', 'failed') and item_key is not null and seq is not null),
w as (select item_key, seq, status, output_path from d where rn = 1),
l as (select *, row_number() over (partition by item_key order by seq desc) as rn from w where status = 'completed'),
k as (select item_key, max(case when status = 'failed' then seq end) as failed_at, count(distinct case when status = 'completed' then output_path end) as outputs from w group by 1),
kept as (select k.item_key, l.output_path, coalesce(failed_at > l.seq, false) as rolled_back, outputs - case when l.output_path is null then 0 else 1 end as superseded from k left join l on l.item_key = k.item_key and l.rn = 1)"""


@query("retry_kept_results", f"with {_WRITES} select * from kept")
def retry_kept_results(spark: SparkSession, folder: str) -> DataFrame:
    return retries.kept_results(table(spark, folder, "state_log"))


@query("retry_superseded_outputs", f"""with {_WRITES}
select distinct w.item_key, w.output_path from w left join kept on kept.item_key = w.item_key and kept.output_path = w.output_path
where w.status = 'completed' and w.output_path is not null and kept.item_key is null""")
def retry_superseded_outputs(spark: SparkSession, folder: str) -> DataFrame:
    return retries.superseded_outputs(table(spark, folder, "state_log"))


@query("job_durations", r"""
with i as (select item_key, epoch_us(min(logged_at)) // 1000 as a, epoch_us(max(case when status <> 'in_progress' then logged_at end)) // 1000 as b,
  coalesce(max(case when status = 'completed' then seq end) > min(case when status = 'failed' then seq end), false) as again from state_log where item_key is not null group by 1)
select lower(regexp_extract(item_key, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) as job, cast(coalesce(max(case when again then b - a end), case when max(b) - min(a) is not null then greatest(0, max(b) - min(a)) end, max(b - a)) as bigint) as duration_ms from i group by 1""")
def job_durations(spark: SparkSession, folder: str) -> DataFrame:
    return retries.job_durations(retries.attempt_spans(table(spark, folder, "state_log")))


@query("model_choices", r"""
with u as (select usage_id, (usage_id * 37 % 1000) / 1000.0 as draw, input_tokens > 3000 as sees, usage_id % 100 as moment from item_usage)
select usage_id, case
  when coalesce(sees, false) then 'slate-vision'
  when coalesce(moment, 0) < 20 then 'umber-small'
  when moment < 50 then case when draw * 8 < 5 then 'umber-small' else 'slate-vision' end
  when draw * 10 < 5 then 'umber-small' when draw * 10 < 8 then 'slate-vision' else 'umber-large' end as model_name from u""")
def model_choices(spark: SparkSession, folder: str) -> DataFrame:
    models = [("umber-small", 5.0, False), ("slate-vision", 3.0, True), ("umber-large", 2.0, False)]
    draw = F.pmod(F.col("usage_id") * 37, F.lit(1000)) / 1000
    choice = retries.choose_model(draw, F.col("input_tokens") > 3000, F.col("usage_id") % 100, models, {"slate-vision": 20.0, "umber-large": 50.0})
    return table(spark, folder, "item_usage").select("usage_id", choice.alias("model_name"))


# around rewriting stages


@query("document_contexts", r"""
with b as (select doc_id, regexp_replace(text, '^\s*---[ \t]*\n(?:(?s:.*?)\n)??---[ \t]*(?:\n|$)', '') as body from documents where text is not null),
l as (select doc_id, list_filter(string_split_regex(body, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '' and not starts_with(regexp_replace(x, '^\s+|\s+$', '', 'g'), '![')) as lines from b)
select doc_id, regexp_replace(left(trim(regexp_replace(array_to_string(lines, ' '), '\s+', ' ', 'g')), 200), '^\s+|\s+$', '', 'g') as context from l""")
def document_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", stages.context_of(F.col("text")).alias("context"))


@query("image_references", r"""
select fetch_id, '![' || replace(replace(replace(title, '\', '\\'), '[', '\['), ']', '\]') || '](' || replace(url_encode(screenshot_path), '%2F', '/') || ')' as reference
from fetch_cache where title is not null and screenshot_path is not null""")
def image_references(spark: SparkSession, folder: str) -> DataFrame:
    """The screenshot of each page as an image with its title."""
    return table(spark, folder, "fetch_cache").where("title is not null and screenshot_path is not null").select("fetch_id", stages.image_reference(F.col("title"), F.col("screenshot_path")).alias("reference"))


@query("prompt_free", r"""
with a as (select doc_id, n, case n when 0 then coalesce(text, '') when 1 then '## Task 1: x' || chr(10) || '---' || chr(10) || 'a' || chr(10) || '---' || chr(10) || coalesce(text, '') else '请处理以下' || coalesce(replace(text, '-', ''), '') end as answer
  from documents, (values (0), (1), (2)) v(n)),
m as (select *, regexp_matches(answer, '## Task [12]:|## 任务 [12]:|【核心原则】|【清理规范】|请处理以下|你是一个专业的') as held,
  length(answer) - length(replace(answer, '---', '')) >= 6 as cut from a),
p as (select *, strpos(answer, '---') as one, strpos(substr(answer, strpos(answer, '---') + 3), '---') as two from m)
select doc_id, cast(n as int) as n, md5(case when not held then answer when cut then regexp_replace(substr(answer, one + two + 5), '^\s+|\s+$', '', 'g') end) as kept from p""")
def prompt_free(spark: SparkSession, folder: str) -> DataFrame:
    """What is kept of three answers for each document: the text, instructions with two rules before it, and instructions alone."""
    whole = F.coalesce("text", F.lit(""))
    answers = F.array(*[F.struct(F.lit(n).alias("n"), a.alias("answer")) for n, a in enumerate((whole, F.concat(F.lit("## Task 1: x\n---\na\n---\n"), whole), F.concat(F.lit("请处理以下"), F.replace(whole, F.lit("-"), F.lit("")))))])
    return table(spark, folder, "documents").select("doc_id", F.inline(answers)).select("doc_id", "n", F.md5(stages.without_prompt(F.col("answer"))).alias("kept"))


@query("finished_documents", r"""
select doc_id, md5('---' || chr(10) || 'title: ' || title || chr(10) || '---' || chr(10) || chr(10) || text) as digest from documents where text is not null and title is not null and title <> ''""")
def finished_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Titled documents behind front matter that came with its own rules and fence."""
    fields = F.concat(F.lit("```yaml\n---\ntitle: "), "title", F.lit("\n---\n```"))
    return table(spark, folder, "documents").where("text is not null and title is not null and title <> ''").select("doc_id", F.md5(stages.finished(F.col("text"), fields)).alias("digest"))


@query("primary_contents", r"""select fetch_id, md5(coalesce(regexp_replace(content, '^\s+|\s+$', '', 'g'), '')) as digest from fetch_cache""")
def primary_contents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").select("fetch_id", F.md5(stages.primary_content(F.col("static_content"), F.col("browser_content"), F.col("content"))).alias("digest"))


@query("service_refusals", r"""
with v as (select log_id, error_text, unnest(['jina', 'defuddle', 'cloudflare', 'static']) as strategy, cast(nullif(regexp_extract(error_text, '\b([45]\d\d)\b', 1), '') as int) as code from state_log where error_text is not null)
select log_id, strategy, case strategy
  when 'jina' then case when lower(error_text) like '%rate limit%' then 'rate limited (free tier: 20 RPM)' when code between 400 and 499 then 'HTTP ' || code || ': ' || error_text end
  when 'defuddle' then case when lower(error_text) like '%rate limit%' then 'rate limited' when regexp_matches(error_text, 'HTTP 4\d\d') then error_text end
  when 'cloudflare' then case when lower(error_text) like '%rate limit%' then 'rate limited' when regexp_matches(error_text, '\b(401|402|403|429|451)\b|CF BR API error') then error_text end end as reason from v""")
def service_refusals(spark: SparkSession, folder: str) -> DataFrame:
    """For each failure that was written down, why a service refused if that strategy had met it."""
    rows = table(spark, folder, "state_log").where("error_text is not null").select("log_id", "error_text", F.explode(F.array(*map(F.lit, ("jina", "defuddle", "cloudflare", "static")))).alias("strategy"))
    code = F.regexp_extract("error_text", r"\b([45]\d\d)\b", 1).try_cast("int")
    return rows.select("log_id", "strategy", stages.service_refusal(F.col("strategy"), F.col("error_text"), code).alias("reason"))


@query("cache_skips", r"""
with p as (select fetch_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') as context from fetch_cache where url is not null)
select fetch_id, context from p where regexp_matches(context, '^(?:.*/)?[^/]*guide[^/]*$') or regexp_matches(context, '^maple[^/]*/[^/]*/[^/]*$')""")
def cache_skips(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose path matches a pattern of pages that are never cached."""
    pages = table(spark, folder, "fetch_cache").where("url is not null").select("fetch_id", F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://", "").alias("context"))
    return pages.where(matches_globs(F.col("context"), ["**/*guide*", "maple*/*/*"]))


@query("sized_pages", r"""select fetch_id, coalesce(size_bytes <= 4096, true) as allowed from fetch_cache""")
def sized_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").select("fetch_id", stages.within_size(F.col("size_bytes"), 4096).alias("allowed"))
