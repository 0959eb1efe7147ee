"""Time the queries on one machine and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated) narrow a run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from noticegrid.plans.registry import load_all  # noqa: E402
from noticegrid.session import local_session  # noqa: E402

HEADLINE = (
    "notice_filter_reasons notice_score notice_keyword_score notice_rank_sections "
    "notice_report_layout new_only seen_upsert dedupe_republication dedupe_clusters "
    "text_clean_digits html_to_text relevance_match sector_label dates_parse values_parse "
    "payload_normalise page_links page_listing source_health field_anatomy unit_search "
    "unit_scarcity project_cards unit_compare snapshot_diff quality_rules "
    "quality_dependencies"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    known = load_all()
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, partitions=cpus, memory="16g")
    spark.range(1).count()
    timings = {}
    for name in chosen:
        if name not in known:
            continue
        start = time.perf_counter()
        known[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
