"""

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query builds its own profile from the Parquet tables (nothing is shared
or memoized between queries) and is forced with ``collect()`` on its small
result, so every timing covers the scans, shuffles and the written result
tables of that query alone.  A tiny warm-up query runs first so JVM start-up
and class loading are not charged to the first query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from dqengine.operators.advisor import advisor_inputs, recommend_algorithms  # noqa: E402
from dqengine.operators.correlation import pair_correlations, top_correlations  # noqa: E402
from dqengine.functions.keys import specs_of  # noqa: E402
from dqengine.plans.dirty import dirty  # noqa: E402
from dqengine.plans.report import profile, profile_many  # noqa: E402
from dqengine.session import local_session  # noqa: E402
from dqengine.sources.tables import TABLES, read_table  # noqa: E402


def q_profile_lineitem(spark, sf):
    """R9 on lineitem: the full report row."""
    return profile(read_table(spark, sf, "lineitem"), "lineitem").reports().collect()


def q_health_report(spark, sf):
    """A9, A10, H1, H2 on the dirty view (flags, duplicates, outliers)."""
    return profile(dirty(spark, sf), "dirty").summary.collect()


def q_top_correlations(spark, sf):
    """P4, A11, K2 on the dirty view."""
    df = dirty(spark, sf)
    return top_correlations(pair_correlations(df, specs_of(df.schema), "dirty")).collect()


def q_top_values(spark, sf):
    """A7, K1 on documents (long texts keyed by hash)."""
    p = profile(read_table(spark, sf, "documents"), "documents")
    return p.columns.select("name", "top_values").collect()


def q_algo_recommendations(spark, sf):
    """All 14 tables profiled together, then the advisor over their reports."""
    p = profile_many({t: read_table(spark, sf, t) for t in TABLES})
    inp = advisor_inputs(p.summary, p.columns, p.flags, p.correlations)
    return recommend_algorithms(inp).select("dataset", "rank", F.col("name")).collect()


QUERIES = {
    "profile_lineitem": q_profile_lineitem,
    "health_report": q_health_report,
    "top_correlations": q_top_correlations,
    "top_values": q_top_values,
    "algo_recommendations": q_algo_recommendations,
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    read_table(spark, sf, "region").agg(F.count(F.lit(1))).collect()
    times = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        fn(spark, sf)
        times[name] = round(time.perf_counter() - t0, 3)
    sf_name = os.path.basename(os.path.normpath(sf))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_name.replace("sf", "") if sf_name.startswith("sf") else sf,
                      "cpus": cpus, "spark": spark.version,
                      "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))
    spark.stop()


if __name__ == "__main__":
    main()
