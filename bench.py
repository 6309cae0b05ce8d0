"""Times the headline queries, warm, and prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
One query warms the session up; then each runs once, planning included, into the no-op sink, so every row is computed.
"""
from __future__ import annotations

import json
import os
import sys
import time

from rolecall.plans import QUERIES
from rolecall.session import local_session

HEADLINE = [
    "site_link_counts", "page_job_links", "job_link_counts", "visible_text_length", "careers_candidates", "url_key", "text_fold", "whole_word",
    "facet_counts", "facet_counts_filtered", "region_union", "company_counts", "sorted_page", "text_search", "text_search_index",
    "places_read", "conformed_postings", "ld_postings", "listing_arrays", "board_detections", "feed_greenhouse",
    "posting_lifecycle", "posting_upsert", "scope_current", "migrated_postings", "migrated_links", "pruned_links"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores), app="rolecall-bench")
    times: dict[str, float] = {}
    QUERIES["facet_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": int(cores), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
