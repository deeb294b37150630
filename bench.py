"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully (Spark's no-op sink, no collect) after one warm-up query.
Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "rank_table", "pair_ztest", "tie_increase", "pair_winrates", "winrate_cov",
    "score_rows", "accuracy", "noise_pivot", "var_median", "cov_mean", "question_no",
    "error_mean", "joint_vocab", "vocab_common", "coupled_draw", "independent_draw", "reply_text",
    "few_shot", "run_plan", "kde_1d", "kde_2d", "csv_tree", "tree_accuracy", "json_columns", "vocab_io", "joint_lookup",
    "sub_error", "samples_needed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    os.environ["BENCH_CPUS"] = str(cpus)
    keys = os.environ.get("BENCH_QUERIES")
    from tandem.plans import QUERIES
    from tandem.session import get_session
    spark = get_session(master=f"local[{cpus}]")
    names = keys.split(",") if keys else HEADLINE
    # warm-up (JVM, codegen caches)
    QUERIES["pair_winrates"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for k in names:
        t0 = time.time()
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
        print(f"{k}: {times[k]}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum of headline query wall times", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
