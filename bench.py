"""Seconds per headline query, the better of two runs; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from screenlens.plans import registry
from screenlens.session import local_session, release

HEADLINE = [
    "signal_peaks",
    "detect_events",
    "threshold_sweep",
    "anchor_diff",
    "screen_periods",
    "assign_segments",
    "hosts",
    "sections",
    "render_context",
    "timeline_readout",
    "parse_timed_blocks",
    "subtitle_quality",
    "rank_subtitles",
    "compare_metrics",
    "flag_dedupe",
    "review_status",
    "image_tokens",
]


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    release(spark)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    run = registry.queries()
    seconds = {}
    for name in HEADLINE:
        seconds[name] = round(min(timed(run[name], spark, sf_dir) for _ in range(2)), 3)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "conversations")}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "signals_per_sec": round(rows["events"] / seconds["detect_events"]),
                "segments_per_sec": round(rows["conversations"] / seconds["assign_segments"]),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
