"""Benchmark: the study pipeline at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Stages are timed incrementally, as a user runs them: baseline cohort
(materialised), six outcome tables, clones + censoring, weighted survival with
formula weights, and the flagship (fitted weights -> effect measures).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trialspark.plans import registry as R  # noqa: E402
from trialspark.plans.session import local_session  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, driver_memory="16g")
    times = {}

    def run(name, fn):
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)

    def written(df):
        """Every column of every row is made; nothing is kept."""
        df.write.format("noop").mode("overwrite").save()

    run("baseline_cohort", lambda: written(R._pre(spark, sf_dir)[1]))
    run("all_outcomes", lambda: written(R._table(spark, sf_dir)))
    run("clones_censored", lambda: written(R.clones_censored(spark, sf_dir)))
    run("weighted_km", lambda: written(R.weighted_km(spark, sf_dir)))
    run("effects_modelled", lambda: written(R.effects_modelled(spark, sf_dir)))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "study_pipeline_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
