"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose tables and cores. After a warm-up each query is run
BENCH_RUNS times and its fastest run counts; results are computed in full and thrown
away.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from govgraph.plans import suite

HEADLINE = (
    "cq_sanctioned_accounts cq_sanctioned_payments cq_duplicate_parties cq_mapping_evidence cq_change_impact "
    "rows_to_triples merge_graphs labels pattern_join path_closure concept_context explain resolve_terms "
    "resolve_lexical materialize validate column_stats uniqueness_counterexamples distinct_counts object_profile "
    "catalog_references proposal_errors verification_runs approval_decision bind_review record_decisions "
    "ledger_build_violations golden_compare last_valid build_rollback profile_heads daily_drift lease_state "
    "register_questions source_inventory"
).split()


WARM_UP = ("cq_sanctioned_payments", "column_stats")


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("govgraph-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = session(cpus)
    for name in WARM_UP:
        suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(
        json.dumps({
            "metric": "headline queries, total of best runs",
            "value": round(sum(times.values()), 3),
            "unit": "sec",
            "queries": times,
            "sf": sf_dir.rsplit("sf", 1)[-1],
            "cpus": int(cpus),
        })
    )
    spark.stop()


if __name__ == "__main__":
    main()
