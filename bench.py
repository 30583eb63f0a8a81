"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the number of threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from webloom import queries as Q
from webloom.session import build_session

HEADLINES = (
    "extract_pages",
    "apply_crawl_edges",
    "upsert_links",
    "upsert_edges",
    "upsert_documents",
    "build_postings",
    "search_match",
    "search_or_not_all",
    "search_phrase",
    "match_all",
    "search_results",
    "match_summary",
    "highlight",
    "out_degree",
    "pagerank_steps",
    "pagerank",
    "stream_crawl",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, only = Q.queries(), sys.argv[1:]

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("out_degree")  # start the workers
    start = time.perf_counter()
    Q._postings(spark, sf_dir)
    times = {"index": round(time.perf_counter() - start, 3)}
    for name in HEADLINES:
        if not only or name in only:
            times[name] = run(name)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
