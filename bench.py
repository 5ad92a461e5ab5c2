"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pi1_regex_entities_documents",
    "pi2_entity_type_detectors",
    "de8_regex_redact",
    "de3_strategy_placeholder",
    "de22_multi_output",
    "de5_strategy_consistent",
    "pi3_gazetteer_entities",
    "tx9_content_tokens",
    "tx20_collocations",
    "kw6_tf_idf",
    "kw1_yake_keywords",
    "sn1_lexicon_polarity",
    "ag6_grouped_term_clouds",
    "an4_aligned_series",
]
PER_DOCUMENT = ["pi1_regex_entities_documents", "pi2_entity_type_detectors"]


def session(cpus: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    import checks
    from checks import base

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    checks.load()
    names = sys.argv[1:] or HEADLINE
    run(base.documents(spark, sf))  # starts the JVM threads and the file listing before the clock runs
    times = {}
    for name in names:
        start = time.perf_counter()
        run(base.QUERIES[name](spark, sf))
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    n = base.documents(spark, sf).count()
    rates = {name: round(n / times[name], 1) for name in PER_DOCUMENT if name in times}
    scaling = {}
    if not sys.argv[1:]:
        from textspark.operators import pii

        docs = base.documents(spark, sf).select("doc_id", "text").persist()
        docs.count()
        for parts in (1, 4, 16):
            start = time.perf_counter()
            run(pii.structured(docs.repartition(parts), "text"))
            scaling[str(parts)] = round(n / (time.perf_counter() - start), 1)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("sf")[-1],
                "documents": n, "documents_per_second": rates, "documents_per_second_by_partitions": scaling,
            }
        )
    )


if __name__ == "__main__":
    main()
