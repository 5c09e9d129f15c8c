"""Times the headline queries and prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leafmill.plans import registry  # noqa: E402
from leafmill.session import build_session  # noqa: E402

HEADLINE = [
    "doc_1_h1_sections",
    "doc_3_section_metadata",
    "doc_5_blocks",
    "doc_9_tail_merge",
    "doc_12_auto_tagging",
    "doc_14_region_extraction",
    "doc_16_asset_store",
    "doc_18_grid_simplification",
    "doc_19_table_documents",
    "src_3_type_routing",
    "src_4_paragraph_items",
    "src_6_chunk_corpora",
    "src_8_task_log",
    "tab_2_used_range",
    "tab_3_merge_fill_dots",
    "tab_7_sheet_markdown",
    "cat_2_upsert",
    "cat_3_lookup_any_project",
    "cat_7_enrichment",
    "cat_8_document_groups",
    "ext_1_prompts",
    "ext_3_model_column",
    "ext_4_strong_cascade",
    "ext_7_chunk_resolution",
    "ext_10_file_results",
    "ext_17_paragraph_rollup",
    "alc_2_matched_files",
    "gen_3_direct_text",
    "gen_6_resource_map",
    "str_1_task_state",
    "str_2_tag_state",
    "str_5_timing_summary",
    "str_8_request_rate",
    "str_9_event_feed",
]


def run(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    shared = tempfile.TemporaryDirectory(prefix="leafmill-bench-")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus), shared=shared.name)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    run(spark, queries["str_6_log_counters"], sf_dir)  # start-up is not a query
    times = {name: round(run(spark, queries[name], sf_dir), 3) for name in wanted}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()
    shared.cleanup()


if __name__ == "__main__":
    main()
