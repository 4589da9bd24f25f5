"""Times the headline queries and prints one JSON line.

Each query is built and run three times, results discarded after full evaluation; the
median is reported.  Throughput in lines per second goes to stderr.  `end_to_end` starts from the raw
table: scan, generate a map of four types, anonymise, nothing prepared.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veilmap.operators import findings, generate, replace  # noqa: E402
from veilmap.plans.corpora import log_lines  # noqa: E402
from veilmap.plans.registry import APPROVED, QUERIES  # noqa: E402

HEADLINE = ["detect_all_raw", "scan_corpus", "scan_unique", "generate_map", "anonymize_lines",
            "reveal_lines", "roundtrip_audit", "anonymize_join"]
RUNS = 3


def end_to_end(spark, folder):
    lines = log_lines(spark, folder)
    found = findings.approve(findings.unique_identifiers(findings.scan(lines, "line_id", "line"), "line_id"), APPROVED)
    return replace.anonymize(lines, generate.generate_map(found), "line")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("veilmap-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.veilmap.inputPartitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    lines = spark.read.parquet(f"{folder}/events.parquet").count()

    queries = {**QUERIES, "end_to_end": end_to_end}

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The inventory and the map several queries start from are written here, untimed.
    once("map_projection")
    seconds = {}
    for name in [*HEADLINE, "end_to_end"]:
        seconds[name] = round(statistics.median(once(name) for _ in range(RUNS)), 3)
        print(f"{name}: {seconds[name]} s, {lines / seconds[name]:,.0f} lines/s", file=sys.stderr)
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
