"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) are read from
the environment. Each query is run to the ``noop`` sink: one warm-up, then the median
of three runs (one run where a run is long), with everything the query does in it,
fitting included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from doctriage.plans.catalog import QUERIES  # noqa: E402
from doctriage.session import build_session  # noqa: E402

HEADLINE = ["word_totals", "clean_documents", "html_to_text", "clean_pages", "tokens_word",
            "ocr_assemble", "exact_split", "doc_frequency", "tfidf_weights", "binary_bag",
            "nb_predict", "nb_report", "centroid_predict", "flow_general", "flow_utility",
            "flow_identity", "outcome_summary", "csv_roundtrip", "score_stream"]

LONG_RUN = 12           # seconds


def timed(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="12g", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = 3 if timed(spark, folder, name) < LONG_RUN else 1
        seconds[name] = round(statistics.median(timed(spark, folder, name)
                                                for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of warm medians",
                      "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
