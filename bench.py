"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fellwalk import plans
from fellwalk.session import local_session

HEADLINE = ["trail_length_by_cell", "classify_trails", "route_membership", "line_measures", "build_edges", "expert_speed", "nearest_nodes", "points_in_polygons", "trace_segments",
            "trace_heat", "densify_lines", "local_density", "area_stats", "best_scenes_per_grid", "paint_order", "threshold_sweep", "tokens", "rule_parse", "browse", "plan_packs", "trail_report"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    plans.load()
    q = plans.all_queries()
    q["parse_markings"](spark, sf).write.format("noop").mode("overwrite").save()  # warm the session
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        q[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf).removeprefix("sf")}))


if __name__ == "__main__":
    main()
