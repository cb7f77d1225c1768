"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from codelantern.plans.registry import QUERIES  # noqa: E402

HEADLINE = (
    "file_filter", "corpus_size", "chunk_summary", "ingest_summary", "inventory_cap", "tokenize", "markdown_sections", "chunk_router",
    "ast_python", "ast_js", "chunk_coverage", "hash_embed", "cosine", "bm25_postings", "bm25_df", "bm25_topk", "stored_topk",
    "semantic_topk", "rrf_fusion", "hybrid_search", "confidence", "citation_audit", "unretrieved_refs",
    "reference_lookup", "context_budget", "prompt_assemble", "upsert", "grounded_answers",
)


def main(checkpoints: str) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", checkpoints).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    # Start the JVM's and the Python workers' machinery outside the timings.
    QUERIES["ast_python"](spark, sf_dir.replace("sf0.1", "sf0.001")).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name,
    }))


if __name__ == "__main__":
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        main(folder)
