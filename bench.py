"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from figtrail.plans import catalog
from figtrail.session import local_session

# one or more per family; each is run to the end into a sink that keeps nothing
HEADLINE = [
    "n1_normalise_numbers", "n3_normalise_dates", "n4_period_keys", "w2_visual_lines", "w20_points_in_regions",
    "m1_proper_nouns", "c1_check_traceability", "c4_check_totals", "c5_check_balance", "c6_check_stated_changes", "c7_check_cross_tables", "c10_check_completeness", "c11_check_text_on_site",
    "a1_fold_duplicates", "a4_run_summary_of_totals", "a7_figure_states", "a8_facet_counts", "e5_assign_chapters", "v2_latest_versions", "v6_step_states", "v14_next_versions",
    "u1_price_usage", "u3_usage_by_feature", "u6_usage_by_report", "u10_second_opinion_queue", "t1_traffic_by_report", "t2_traffic_daily", "r3_rate_limited", "s7_dedupe_sources", "q1_match_truth",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    queries["v2_latest_versions"](spark, folder).write.format("noop").mode("overwrite").save()  # the first query pays for starting up
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
