"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "quality_by_lang", "norm_fingerprints", "url_canonical", "keyword_hits", "section_lines", "contact_findings", "exact_dups", "near_dups",
    "contamination", "score_final", "score_job_texts", "review_labels", "header_lines", "ranked_view", "tracker_filter_sort", "tracker_upsert", "event_latest_state", "seen_upsert", "region_facets",
    "cramers_v", "fleiss_kappa", "ranking_by_group", "pair_features", "evidence_topk", "tfidf_cosine",
)


def main() -> None:
    from millrace.registry import queries
    from millrace.session import local_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    found, times = queries(), {}
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
