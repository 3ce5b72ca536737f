"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores.  Each query runs twice into a sink that keeps nothing; `queries`
holds the better run, `cold` the first, `value` sums `queries`.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f7_scored_pairs", "f17_visible_pairs", "g14_gate", "g12_triage",
    "e1_upsert_lineitem", "e8_reconcile_lineitem", "e5_scan", "g10_session_summary", "j3_debounce", "j1_capture_stream",
    "b1_extract_python", "b2_b12_extract_typescript", "b8_extract_rust", "b5_extract_texts",
    "b10_strip_line_comment", "c2_secret_bank", "c4_entropy_secret", "c5_line_previews",
]


def main():
    from pyspark.sql import SparkSession

    from bindery.catalog import CATALOG

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bindery-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    cold, best = {}, {}
    only = sys.argv[1:]
    for name in HEADLINE:
        if only and name not in only:
            continue
        runs = []
        for _ in range(2):
            start = time.time()
            CATALOG[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.time() - start, 3))
        cold[name], best[name] = runs[0], min(runs)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(best.values()), 3), "unit": "sec",
                      "queries": best, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
