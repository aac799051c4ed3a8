"""Headline-query benchmark.

Runs the catalogue's headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints one JSON line.  Each query is forced to completion
with the ``noop`` sink (no collect); the session start and one warm-up run of every
query on the smallest tables (JIT, codegen cache, Python workers) are not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kestrel.plans.catalog import QUERIES  # noqa: E402
from kestrel.session import get_spark  # noqa: E402

HEADLINE = [
    "rbnc_counts",          # C-1 flagship: CPT counting of a random-network ensemble
    "a1de_counts",          # C-5
    "nb_score",             # G-2 fit + score
    "a1de_score",           # A-5
    "a2de_score",           # A-6
    "rbnc_score",           # B-4..B-6
    "folds_interleaved",    # E-1 (10 repeats)
    "cv_a1de_accuracy",     # E-4 10x10 CV in one pass
    "ovo_vote",             # V-7/V-8 batch scoring
    "score_batch_arrow",    # V-9
    "scale_apply",          # T-4/T-5
    "label_noise",          # T-8
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark()
    names = sys.argv[1:] or HEADLINE
    # JVM / Python-worker warm-up on the smallest tables (not timed)
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in names:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
