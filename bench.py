"""Time the headline queries: one warm-up, then the median of the runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tiltmeter.plans.registry import load_all  # noqa: E402
from tiltmeter.session import build_session  # noqa: E402

HEADLINE = (
    "rate_at_volume",
    "opinion_rate_by_run",
    "accuracy_controlled_rate",
    "answer_letter_extraction",
    "mcq_opinion",
    "mcq_prefix",
    "decision_score_wrong",
    "kl_opinion_plain",
    "kl_quant_fp",
    "trajectory_stats",
    "emergence",
    "significance",
    "rtn_per_group",
    "mse_range",
    "best_pitch",
    "magnitude_prune",
    "activation_prune",
    "bipartite_merge",
    "calib_windows",
    "eval_blocks",
    "align_by_key",
    "pending_jobs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = load_all()
    seconds: dict[str, float] = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        times = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
