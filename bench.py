"""Benchmark: run the registered queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and print ONE JSON line.

Each query is fully materialised into a ``noop`` sink; every registered
query of the reference's operators is timed. ``pipeline_full`` runs the
whole composed analysis (E1) by region and materialises every output. Set
``BENCH_QUERIES`` (comma list) to run a subset, ``BENCH_GBT_ITER`` to
change the boosting rounds of the model queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidemark.session import get_spark
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, app="tidemark-bench")

    from tidemark.config import PipelineConfig
    from tidemark.plans import catalog, pipeline
    from tidemark.sources.tables import sales_fact

    if os.environ.get("BENCH_GBT_ITER"):
        catalog.CFG = PipelineConfig(gbt_iter=int(os.environ["BENCH_GBT_ITER"]))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = wanted or list(catalog.CATALOG)
    times: dict[str, float] = {}
    for name in names:
        if name == "pipeline_full":
            continue
        t = time.perf_counter()
        catalog.CATALOG[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        spark.catalog.clearCache()
    if not wanted or "pipeline_full" in wanted:
        t = time.perf_counter()
        txn = sales_fact(spark, sf_dir)
        out = pipeline.run_pipeline(txn, catalog.CFG, key="region")
        for df in out.values():
            df.write.format("noop").mode("overwrite").save()
        times["pipeline_full"] = round(time.perf_counter() - t, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
