"""All registered queries and their SQL twins."""
from __future__ import annotations

from importlib import import_module

FAMILIES = ["text", "sources", "catalogue", "sheets", "extract", "assemble", "telemetry"]

# Integer literals and sums are narrower or wider in the SQL dialect: columns to read as BIGINT there.
LONG_COLUMNS = {
    "doc_7_chunk_packing": "chunk_no",
    "doc_8_heading_path": "chunk_no",
    "doc_9_tail_merge": "chunk_no",
    "doc_11_flat_chunk_index": "index",
    "doc_13_region_scan": "start_pos end_pos",
    "doc_19_table_documents": "table_no",
    "src_4_paragraph_items": "para_no item_no files",
    "src_4_paragraphs": "para_no items",
    "src_4_item_files": "file_no",
    "src_5_job_tasks": "item_no chunk_max_chars chunk_min_chars path_no",
    "alc_1_request_items": "item_no",
    "tab_1_sheet_cells": "col",
    "tab_2_used_range": "min_col max_col",
    "tab_2_a1_range": "min_row min_col max_row max_col",
    "tab_5_cell_format": "col",
    "tab_8_edge_trim": "min_col max_col",
    "ext_6_relevant_chunks": "rel_ord",
    "ext_7_chunk_resolution": "rel_ord",
    "ext_8_selected_text": "part",
    "ext_12_directories": "part",
    "ext_20_strategy": "max_retries",
    "gen_3_direct_text": "part",
    "gen_4_placeholder_append": "part",
    "gen_10_selection_queue": "candidate_no",
    "gen_12_result_payloads": "traced",
    "gen_13_insertion_rows": "pos",
    "str_4_stage_labels": "percent",
    "str_6_log_counters": "debug critical",
    "str_6_log_counters_stream": "debug critical",
}


def _collect(part: str) -> dict:
    out = {}
    for name in FAMILIES:
        out.update(getattr(import_module(f"leafmill.plans.{name}"), part))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    out = _collect("SQL")
    for name, columns in LONG_COLUMNS.items():
        casts = ", ".join(f'"{c}"::bigint as "{c}"' for c in columns.split())
        out[name] = f"select * replace ({casts}) from ({out[name]})"
    return out
