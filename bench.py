"""Headline queries, timed: one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose the
data and the cores. Every query is run to the end: all rows go to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vacantlens.plans import QUERIES  # noqa: E402
from vacantlens.session import build_session  # noqa: E402

HEADLINE = [
    "pay_dispersion", "institution_pay", "tier_pay", "tier_zscore_flags", "tier_topn", "count_histogram",
    "numeric_histograms", "describe_numeric", "tail_quantiles", "null_profile", "value_counts_multi", "coverage",
    "cardinalities", "monthly_volume", "repeat_postings", "stability_profile", "normalize_text_variants",
    "regime_matrix", "complete_postings", "quarantine", "outcome_stats", "parse_experience", "parse_academic",
    "duplicate_run_frontier", "forward_fill_hierarchy", "hierarchy_rollup", "pending_keys", "keep_first",
    "best_candidate_enrich", "refresh_candidates", "token_set_topk", "cosine_topk", "level_restricted_match",
    "page_fields", "posting_page_fields", "csv_roundtrip", "enriched_postings", "stream_ingest", "document_terms",
    "topic_features", "text_vectors", "pca_features",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Untimed warm-up of the JVM on the smallest tables beside the timed ones.
    small = Path(root).resolve().parent / "sf0.001"
    for name in ("pay_dispersion", "complete_postings", "token_set_topk") if small.is_dir() else ():
        QUERIES[name](spark, str(small)).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
