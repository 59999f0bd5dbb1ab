"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "verdicts_combined",
    "states_in_one_pass",
    "silent_tally_by_set",
    "reference_declared",
    "set_tag_median",
    "cell_fractions",
    "per_cell_summary",
    "tag_stat",
    "corrected_to_panel",
    "undeclared_tally",
    "read_qc",
    "mixture_fits",
    "cell_score",
    "self_disagreement",
    "count_bins",
    "competitor_notes",
]


def main() -> None:
    from tagspark.catalog import QUERIES
    from tagspark.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()  # the session starts before the clock does
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
