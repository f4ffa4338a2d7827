"""The queries of this package, and their SQL where DuckDB can express them."""

from __future__ import annotations

from . import lookalikes, main_content, markup, packing, residue, scans, site_lines, tokens, truncation

QUERIES = {
    "p1_found": truncation.p1_found,
    "p1_shares": truncation.p1_shares,
    "p2_found": scans.p2_found,
    "p2_paragraphs": scans.p2_paragraphs,
    "p3_found": main_content.p3_found,
    "p3_main": main_content.p3_main,
    "p5_found": markup.p5_found,
    "p5_clean": markup.p5_clean,
    "p6_found": residue.p6_found,
    "p6_kept": residue.p6_kept,
    "p7_found": site_lines.p7_found,
    "p7_clean": site_lines.p7_clean,
    "p8_ids": tokens.p8_ids,
    "p9_assignments": packing.p9_assignments,
    "p9_fill": packing.p9_fill,
    "p10_found": lookalikes.p10_found,
    "p10_forms": lookalikes.p10_forms,
}
SQL = {"p7_found": site_lines.P7_SQL}
