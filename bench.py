"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the cores. The search index of the sections is
built first and timed apart as text_index, so no query's figure depends on which one ran before it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from passages.queries import QUERIES
from passages.queries.bindings import text_index
from passages.session import build_session

HEADLINE = [
    "hybrid_search", "bm25_rank", "pdf_search", "knn", "hash_embed", "word_frequency", "scan_text",
    "section_text", "index_build", "toc_end_pages", "matched_features", "learnings_prompts",
    "normalize_meta", "table_penalty", "library_upsert", "merge_hits", "stream_progress",
]


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    start = time.perf_counter()
    text_index(spark, folder)
    seconds["text_index"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
