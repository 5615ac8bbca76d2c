"""The ``dirty`` view: lineitem with injected nulls, spikes, noise, a rare
class, a constant column and duplicated rows.  The same SQL runs in Spark
and in the DuckDB oracle, and it triggers every flag rule F1-F6 and the
recommendations R1-R5 (FIXTURES.md section 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

DIRTY_BODY = """
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
         l_extendedprice * 1.1 + l_quantity AS gross,
         CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS l_discount,
         CASE WHEN l_orderkey % 10 < 7 THEN NULL ELSE l_tax END AS l_tax,
         CASE WHEN l_orderkey % 97 = 0 THEN l_quantity * 1000 ELSE l_quantity END AS spiky,
         CASE WHEN l_orderkey % 8 = 0 THEN l_quantity + 500 ELSE l_quantity END AS noisy,
         CASE WHEN l_suppkey % 100 = 1 THEN 'rare' ELSE 'common' END AS klass,
         CAST(1 AS DOUBLE) AS konst,
         l_returnflag
  FROM lineitem"""

DIRTY_SQL = f"WITH b AS ({DIRTY_BODY})\nSELECT * FROM b UNION ALL SELECT * FROM b WHERE l_orderkey % 50 = 0"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(DIRTY_SQL)
