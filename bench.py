"""Runs the headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from cellweave.plans import registry
from cellweave.session import local_session

#: Queries that stand for the engine: self-joins, phase group-bys, windows, repairs, pixels to objects, tracking.
HEADLINE = (
    "relatives_join", "phase_quantities", "derived_cycle_end", "generation_of_relative", "mother_bud_total", "fix_will_divide", "corrected_blocks", "ensure_compat",
    "combine_metrics_outer", "integrity_frame", "propagate_edits", "object_counts", "region_props", "intensity_stats", "corrected_amounts", "rotational_volume",
    "z_project_median", "connect_3d", "overlap_ioa", "ioa_assignment", "track_sequence", "lineage_diff", "measure_position",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    found, times = registry.queries(), {}
    found["object_counts"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the session's machinery
    for name in HEADLINE:
        began = time.time()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
