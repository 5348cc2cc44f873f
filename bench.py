"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cytoloom import catalog  # noqa: E402
from cytoloom.session import build_session  # noqa: E402

HEADLINE = [
    "grand_total",
    "containment",
    "non_composite",
    "duplicate_subset",
    "leg_attach",
    "seam_nms",
    "unsharp",
    "otsu",
    "clahe",
    "morph_close",
    "connected_regions",
    "homogeneity",
    "proximity_edges",
    "greedy_endpoint_match",
    "activation_index",
    "map_at_50",
    "label_sync_stream",
    "baseline_extraction",
    "canny",
    "crop_silhouette",
    "density_clusters",
    "contour_table",
    "dup_leg_sequential",
]
#: Run once before the clock starts, so that no query carries the start of the JVM.
WARM_UP = "gray_signal"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores)
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    queries[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spent: dict[str, float] = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(found.group(1)) if found else None,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
