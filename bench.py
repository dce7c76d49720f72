"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query is
built and run to the end (all rows, no sink) once to warm up and then three
times, the median counts; the first run is reported as ``cold``. ``reference``
is the time of a fixed job without any table, by which times of two machines
can be compared.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldtally.plans import catalog  # noqa: E402
from fieldtally.session import build_session  # noqa: E402

HEADLINES = [
    "scan_survey",
    "attach_weights",
    "cover_to_roster",
    "frame_join",
    "head_attributes",
    "freq_counts",
    "descriptives",
    "weighted_freq",
    "crosstab_margins",
    "crosstab_region",
    "banner_single",
    "banner_report",
    "banner_unweighted",
    "banner_multi",
    "multiselect_region",
    "rating_distribution",
    "rating_means",
    "likert_summary",
    "expand_by_weight",
    "duplicate_keys",
    "first_completed",
    "kpis",
    "progress_table",
    "design_weights",
    "systematic_sample",
    "polygon_centroids",
    "open_text_words",
    "open_text_trigrams",
    "refresh_latest",
    "stream_status_counts",
]


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def reference(spark) -> float:
    """Seconds of a job that depends on the machine alone: median of five."""

    def once() -> float:
        start = time.perf_counter()
        spark.range(0, 60_000_000, 1, 8).selectExpr("id % 1009 AS k", "hash(id) AS h").groupBy("k").agg({"h": "sum"}).collect()
        return time.perf_counter() - start

    once()
    return round(statistics.median(once() for _ in range(5)), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    wanted = sys.argv[1:] or HEADLINES
    fixed = reference(spark)
    queries, warm, cold = catalog.queries(), {}, {}
    for name in wanted:
        cold[name] = round(run(queries[name], spark, folder), 3)
        warm[name] = round(statistics.median(run(queries[name], spark, folder) for _ in range(3)), 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "sum of warm medians over headline queries",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "reference": fixed,
        "cpus": int(cpus),
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
