"""Small tables in the project's schemas, with awkward rows."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq

SCHEMAS = {
    "fetch_cache": pa.schema([("fetch_id", pa.int64()), *[(c, pa.string()) for c in ("cache_key", "url", "content", "strategy_used", "title", "final_url", "metadata")], ("created_at", pa.int64()), ("accessed_at", pa.int64()), ("size_bytes", pa.int64()), *[(c, pa.string()) for c in ("etag", "last_modified", "screenshot_path", "static_content", "browser_content")]]),
    "web_metadata": pa.schema([("meta_id", pa.int64()), *[(c, pa.string()) for c in ("cache_key", "title", "author", "site", "published", "description", "canonical_url", "domain")]]),
    "ocr_results": pa.schema([("ocr_id", pa.int64()), ("scan_id", pa.int64()), ("page_no", pa.int32()), ("text", pa.string()), ("confidence", pa.float64()), ("boxes", pa.list_(pa.list_(pa.float64()))), ("lang", pa.string()), ("engine", pa.string()), ("image_path", pa.string()), ("scanned_at", pa.timestamp("us"))]),
    "state_log": pa.schema([("log_id", pa.int64()), ("item_key", pa.string()), ("seq", pa.int64()), ("status", pa.string()), ("output_path", pa.string()), ("error_text", pa.string()), ("logged_at", pa.timestamp("us"))]),
    "item_usage": pa.schema([("usage_id", pa.int64()), ("item_key", pa.string()), ("model_name", pa.string()), ("requests", pa.int64()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("cost_usd", pa.float64())]),
    "spa_domains": pa.schema([("domain", pa.string()), ("learned_at", pa.string()), ("hits", pa.int64()), ("last_hit", pa.string())]),
    "sites": pa.schema([(c, pa.string()) for c in ("domain", "site", "lang", "home_zone", "date_order")]),
    "pack_targets": pa.schema([("target_name", pa.string()), ("capacity_tokens", pa.int32())]),
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("fmt", pa.string()), ("title", pa.string()), ("converted_at", pa.timestamp("us"))]),
}
IDS = {"fetch_cache": "fetch_id", "web_metadata": "meta_id", "ocr_results": "ocr_id", "state_log": "log_id", "item_usage": "usage_id", "documents": "doc_id"}
#: Names that operators use for columns of their own.
CLASHES = ("key", "n", "rank", "source", "line", "running", "chars", "item_id", "utc_us", "kind", "form_key", "n_tokens", "word", "part")
LONG = "The keeper counted boats. " * 4000
TEXTS = ("", " ", "\n\n", "a", "x" * 70_000, LONG, "# Heading\n\n- item\n\n```\ncode", "<p>one <b>two", "\\section{a}\n\\begin{itemize}\n\\item b", "== wiki ==\n# one\n# two", "tab\tand\r\nline ends\r\n", "👩‍💻 ok ️", "نص عربي", "中文文本。", "a‍b", "caf\u0065\u0301 Ａ", "x-\ny", "{{ a_b }}", "$", "`", "[", "<", "\x00null")


def write_tables(folder, rows: dict[str, list[dict]], clashes: bool = False) -> str:
    for name, schema in SCHEMAS.items():
        columns = {f.name: pa.array([r.get(f.name) for r in rows.get(name, [])], f.type) for f in schema}
        if clashes:
            columns |= {c: pa.array(["clash"] * len(rows.get(name, [])), pa.string()) for c in CLASHES if c not in columns}
        pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
    return str(folder)


def awkward_rows() -> dict[str, list[dict]]:
    """Rows of nulls, of odd texts, and repeated ones, in every table."""
    rows: dict[str, list[dict]] = {name: [] for name in SCHEMAS}
    for name, schema in SCHEMAS.items():
        if name in IDS:
            rows[name] += [{IDS[name]: 0}, {IDS[name]: 0}]
        else:
            rows[name].append({})
        for k, text in enumerate(TEXTS, 1):
            row = {}
            for field in schema:
                if field.name == IDS.get(name):
                    row[field.name] = k
                elif pa.types.is_string(field.type):
                    row[field.name] = text
                elif pa.types.is_timestamp(field.type):
                    row[field.name] = datetime(2024, 1, 1)
                elif pa.types.is_floating(field.type):
                    row[field.name] = float("nan") if k % 3 == 0 else 0.5
                elif pa.types.is_integer(field.type):
                    row[field.name] = k % 4
            rows[name] += [row, dict(row)] if k % 5 == 0 else [row]
    rows["fetch_cache"] += [{"fetch_id": 100 + k, "cache_key": "same", "url": f"https://a.example/p{k % 6}", "content": "Shared line of this very site\n\nOwn words number " + "abcdefgh"[k % 8], "strategy_used": "static", "created_at": 5, "accessed_at": 5, "size_bytes": 1} for k in range(12)]
    rows["web_metadata"] += [{"meta_id": 100, "cache_key": "same", "domain": "WWW.A.example:443", "published": "2024-01-01T00:00:00Z"}, {"meta_id": 101, "cache_key": "same", "domain": "a.example", "published": "01/02/2024 10:00"}]
    rows["sites"] += [{"domain": "a.example", "site": "A", "lang": "en", "home_zone": "Europe/Paris", "date_order": "DMY"}, {"domain": "b.example", "home_zone": "No/Where"}]
    rows["pack_targets"] = [{"target_name": "small", "capacity_tokens": 16}, {"target_name": "large", "capacity_tokens": 4096}, {"target_name": None, "capacity_tokens": 5}, {"target_name": "none", "capacity_tokens": None}]
    return rows
