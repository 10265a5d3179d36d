"""Schemas of the data model."""

from __future__ import annotations

FACT = "struct<start: string, `end`: string, val: double, fy: int, fp: string, form: string, filed: string>"
#: One nested document per company; concept and unit names are data, so they are map keys.
COMPANY_FACTS = f"cik bigint, entityName string, facts struct<`us-gaap`: map<string, struct<units: map<string, array<{FACT}>>>>>"
COMPANIES = "ticker string, name string, cik string, sic string, sector string, fiscal_year_end string"
BREAKDOWN = "company_ticker string, period_end string, period_type string, name string, revenue bigint"
LINE = "file string, page int, line_no int, line string, is_toc boolean, x0 double, x1 double, y0 double, y1 double, page_width double, max_size double, is_bold boolean, is_italic boolean, font_names array<string>"
CHUNK = "source_file string, chunk_id string, chunk_type string, section_ref_id string, header_path array<string>, text string, token_count bigint, prev_id string, next_id string"
VECTOR_ROW = "chunk_id string, content string, embedding array<float>, ticker string, fiscal_year string, item string, section string, source_file string, page_start int, page_end int, parent_chunk_id string, load_seq bigint"
TABLE = "source_file string, table_id string, asset_type string, page_start int, page_end int, bbox array<double>, raw_rows array<array<string>>, source_table_ids array<string>, section_ref_id string, subsection_ref_id string, header_only boolean, load_pos bigint"
MESSAGE = "session_id bigint, turn bigint, role string, text string"
