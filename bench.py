"""Times the headline queries and prints one JSON line.

Every query runs over the whole tables in BENCH_SF_DIR, which are first written once more in
FILES files each: a given table is one row group, which only one core would read. Results
go to the noop sink, so all rows and columns are computed. Lower is better.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import time

from ledgerproof.plans.registry import QUERIES
from ledgerproof.session import local_session, scratch_path

FILES = 8

HEADLINE = (
    "a03_monthly_net", "a05_country_month_net", "a07_product_month_net", "a12_subset_totals", "w01_exact_duplicate_flag",
    "g05_top3_products_month", "g06_product_revenue_share", "g09_question_table", "g11_prompt_table", "v07_reconciliation",
    "w07_ordinal_ids_and_split", "w10_token_offsets", "j03_interval_overlap", "a17_span_features", "n01_step_distribution",
    "t01_normalize_text", "t02_extract_numbers", "t19_forbidden_lines", "e05_average_precision", "e08_split_safe_evaluation",
    "w14_top_n_per_bucket", "k01_fact_level_review", "k02_ranked_list_evaluation", "j05_evidence_match", "k03_cell_level_signals", "a26_flag_rate_groups", "w18_greedy_tiling", "r02_annotation_queue",
    "r09_policy_flags", "a20_question_coverage",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("OFF")
    parts = scratch_path(spark, "bench")
    for path in sorted(glob.glob(f"{root}/*.parquet")):
        spark.read.parquet(path).repartition(FILES).write.parquet(f"{parts}/{os.path.basename(path)}")
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, parts).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
             "queries": seconds, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
