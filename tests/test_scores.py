"""H1 health score goldens (FIXTURES section 3) and the score bands."""

import pytest
from pyspark.sql import functions as F

from dqengine.operators.score import (correlation_band, health_score, missing_band,
                                      raw_health, score_band)

CASES = [
    ((3.2, 20, 1000, 40, 1, 2), 66.6, 67),
    ((0.75, 0, 1000, 0, 0, 0), 98.5, 98),
    ((1.25, 0, 1000, 0, 0, 0), 97.5, 98),
    ((50.0, 500, 1000, 900, 9, 9), 0.0, 10),
    ((0.0, 0, 10, 0, 0, 0), 100.0, 100),
]


@pytest.mark.parametrize("args,raw,score", CASES)
def test_health_score(spark, args, raw, score):
    df = spark.createDataFrame([args], "m DOUBLE, d BIGINT, n BIGINT, o BIGINT, dr INT, f BIGINT")
    cols = [F.col(c) for c in df.columns]
    r = df.select(raw_health(*cols).alias("raw"), health_score(*cols).alias("s")).collect()[0]
    assert r.raw == pytest.approx(raw, abs=1e-9)
    assert r.s == score


def test_bands(spark):
    df = spark.createDataFrame([(80, 20.0, 0.7), (79, 20.5, -0.71), (59, 10.0, 0.4)], "s INT, m DOUBLE, r DOUBLE")
    got = df.select(score_band(F.col("s")).alias("a"), missing_band(F.col("m")).alias("b"),
                    correlation_band(F.col("r")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("High", "medium", "moderate"), ("Moderate", "high", "strong"),
                                       ("Poor", "low", "weak")]
