"""Benchmark: headline jobs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total sec), "unit", "queries": {name: sec}, "sf", ...}.
Every job is fully executed with the ``noop`` sink (no collect of large results).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from fluxsieve.operators import score as S  # noqa: E402
from fluxsieve.plans import registered  # noqa: E402
from fluxsieve.session import local_session  # noqa: E402
from fluxsieve.sources.bridge import bridge_view  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
THIN_SF_DIR = os.environ.get("BENCH_THIN_SF_DIR", os.path.join(os.path.dirname(SF_DIR), "sf0.01"))

# headline registered queries (full filter chain, slice breakdown, splits, scoring, reports)
HEADLINE = ["curated_rows", "curated_breakdown", "yield_report", "breakdown_mask", "test_split",
            "train_val_test", "outlier_trim_rank", "score_committee", "residual_rms", "grid_stability_flags",
            "grid_ambipolarity", "instance_weights", "wide_slices", "signed_log_histogram"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn):
    t = time.perf_counter()
    fn()
    return round(time.perf_counter() - t, 3)


def main():
    spark = local_session(CPUS, app="fluxsieve-bench")
    qs = registered()
    out, extra = {}, {}
    # warm-up: JVM, Python workers, file listing
    run(bridge_view(spark, SF_DIR).limit(1000))
    for name in HEADLINE:
        out[name] = timed(lambda n=name: run(qs[n][0](spark, SF_DIR)))
    # MLP scoring: 3 x 128 tanh, 1 target, Arrow batches
    net = S.make_network(["Ati", "Ate", "An", "q", "x"], ["efiITG_GB"], hidden=(128, 128, 128), seed=11)
    b = bridge_view(spark, SF_DIR)
    n_rows = b.count()
    sec = timed(lambda: run(S.score(b, {"mlp": net})))
    out["mlp_3x128_scoring"] = sec
    extra["mlp_rows_per_sec"] = round(n_rows / sec, 1) if sec else None
    # two-step thinning (3 dims) on the smaller set by default
    if os.path.isdir(THIN_SF_DIR):
        out["two_step_thinning@" + os.path.basename(THIN_SF_DIR)] = timed(
            lambda: run(qs["two_step_thinning"][0](spark, THIN_SF_DIR)))
    # and on the whole set, beside the total (which stays comparable with earlier rounds)
    if THIN_SF_DIR != SF_DIR:
        extra["two_step_thinning_sec"] = timed(lambda: run(qs["two_step_thinning"][0](spark, SF_DIR)))
    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(sf.group(1)) if sf else SF_DIR, "rows": n_rows, **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
