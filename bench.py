"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from planmark.plans import catalog  # noqa: E402
from planmark.session import build_session  # noqa: E402

HEADLINE = [
    "extract_entities", "entities_oem", "title_block_fields", "normalize_dimension", "entity_search",
    "query_drawings", "page_stats", "drawings_missing_part_number",
    "associate_text_shapes", "obstacle_filter_advanced", "link_dimensions", "containment_pairs",
    "overlapping_entities", "similar_hashes",
    "llm_daily_costs", "cost_report", "cost_cube", "running_spend", "budget_plan", "processing_statistics",
    "extraction_statistics", "validation_report", "routing_scores", "route_drawings", "review_flags",
    "root_component", "assembly_edges", "hierarchy_tree", "multi_view_groups", "export_summary", "nested_json_export",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    workers = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(workers),
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.sql.files.maxPartitionBytes": "2m",
            "spark.sql.files.openCostInBytes": "256k",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_linenumber").count().collect()  # start-up
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in chosen:
        start = time.perf_counter()
        try:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # one bad query must not hide the others
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    if failed:
        line["failed"] = failed
    print(json.dumps(line))


if __name__ == "__main__":
    main()
