"""Headline queries, timed; prints one JSON line.

    BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)

Queries share the written node table (made by the first one) and the extracted
items (made by ``d1_extract_list``), as jobs over one snapshot would.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pageloom.plans import QUERIES
from pageloom.session import build_session

# Shredding, rules over all pages, the audit, reading analytics, text and media.
HEADLINE = [
    "c1_shred_pages", "c4_select_within", "rules_over_all_pages", "d1_extract_list", "d8_content_links", "d9_link_fallback",
    "d11_diagnose_list", "f1_extract_content", "f2_readable_text", "f13_split_sentences", "f17_lyric_at", "g5_stage_list",
    "g11_pass_rate_report", "e2_html_to_text", "e4_json_path", "b1_normalize_sources", "b5_explode_categories", "b15_rule_construct_census",
    "h1_reading_stats", "h4_daily_reading", "h6_continue_reading", "h7_record_history", "h9_upsert_progress", "h12_shelf_progress",
    "h13_highlight_id", "h18_locate_highlights",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    only = sys.argv[1:]
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    rates = {}
    if "c1_shred_pages" in seconds:
        rates["pages_per_s_shredded"] = round(n_pages / seconds["c1_shred_pages"], 1)
    if "rules_over_all_pages" in seconds:
        rates["rule_evaluations_per_s"] = round(4 * n_pages / seconds["rules_over_all_pages"], 1)
    if {"d1_extract_list", "g5_stage_list"} <= seconds.keys():
        # A source is audited once its list is extracted and its stage is judged.
        rates["sources_per_s_audited"] = round(n_pages / (seconds["d1_extract_list"] + seconds["g5_stage_list"]), 1)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
