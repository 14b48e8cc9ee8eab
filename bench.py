"""Benchmark the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query runs to completion into Spark's no-op sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from triagelake.plans.catalog import QUERIES  # noqa: E402
from triagelake.session import build_session  # noqa: E402

HEADLINE = [
    "incident_clean", "kb_text", "corpus_union", "embed_hash", "topk_batch", "topk_self",
    "hits", "text_search", "request_hits", "context_fold", "decision_gate", "payload_check",
    "action_plan", "outcome", "ticket_apply", "issue_class_rules", "ci_route",
    "final_record", "prompt_answer", "prompt_group", "prompt_decision", "prompt_payload", "stream_triage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                                 "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-checkpoint-")})
    # untimed warm-up: JVM code paths, the Parquet reader and Python workers
    warm = spark.read.parquet(os.path.join(sf_dir, "region.parquet"))
    warm.groupBy().count().collect()
    warm.mapInPandas(lambda it: it, warm.schema).collect()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]:.2f}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
