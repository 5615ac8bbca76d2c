"""Fast mode: states of batches merge to what one pass gives, within stated errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqengine.operators.sketches import (DISTINCT_ERROR, RANK_ERROR, add_batch, approximate, merged, state_of,
                                         stored_states)
from dqengine.session import stage_dir


def rows_of(df):
    return {(r.dataset, r.name, r.dtype): r for r in approximate(df).collect()}


@pytest.fixture(scope="module")
def wide(spark):
    return spark.range(60_000).select(
        F.col("id"), F.exp(F.randn(3) * 2).alias("skewed"), (F.col("id") % 7).cast("int").alias("few"),
        F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("v"), F.col("id") % 5000)).alias("text"),
        F.when(F.col("id") % 10 == 0, F.lit("NaN").cast("double")).otherwise(F.col("id") * 1e-3 + 1e9).alias("far")).repartition(8)


def test_batches_equal_one_pass(spark, wide, tmp_path):
    wide.write.parquet(f"{tmp_path}/in")
    wide = spark.read.parquet(f"{tmp_path}/in")
    root = stage_dir(spark)
    for i in list(range(9)) + [4]:  # one batch comes twice and stands once
        add_batch(state_of(wide.where(F.pmod(F.hash("id"), F.lit(9)) == i), "t"), root, f"b/{i} é")
    one = rows_of(merged(state_of(wide, "t").withColumn("part", F.lit(0))))
    exact = wide.toPandas()
    for fan in (64, 2):  # in one level and in four
        many = rows_of(merged(stored_states(spark, root), fan))
        assert set(many) == set(one) and len(many) == 5
        for key, m in many.items():
            o, values = one[key], exact[key[1]]
            assert (m.rows, m.nulls, m.nans, m.min, m.max, m.missing_pct) == (o.rows, o.nulls, o.nans, o.min, o.max, o.missing_pct) and m.rows == 60_000
            distinct = len(set(values.dropna())) + int(key[1] in ("text", "far"))  # null, NaN
            assert abs(m.distinct_estimate - distinct) <= DISTINCT_ERROR * distinct
            if m.kind != "numeric":
                assert (m.mean, m.q1, m.outlier_estimate) == (None, None, None)
                continue
            values = np.sort(values.dropna().to_numpy(float))
            assert m.mean == pytest.approx(values.mean(), rel=1e-12) and m.std == pytest.approx(values.std(), rel=1e-6)
            for p, got, bounds in ((.25, m.q1, m.q1_bounds), (.5, m.median, None), (.75, m.q3, m.q3_bounds)):
                lo, hi = np.searchsorted(values, got, "left") / len(values), np.searchsorted(values, got, "right") / len(values)
                assert lo - RANK_ERROR <= p <= hi + RANK_ERROR
                if bounds:
                    assert bounds.low <= np.quantile(values, p) <= bounds.high
            q1, q3 = np.quantile(values, [.25, .75])
            out = ((values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))).sum()
            assert abs(m.outlier_estimate - out) <= 2 * RANK_ERROR * len(values)


def test_empty_batches_nulls_infinities_and_names(spark):
    schema = "`a.b` DOUBLE, `A.B` INT, `__dq0` STRING, arr ARRAY<INT>, m MAP<STRING,INT>"
    rows = [(float("inf"), 1, "x", [1], {"a": 1, "b": 2}), (1.0, None, None, [1], {"b": 2, "a": 1}), (None, None, "x", None, None), (float("nan"), None, "", [2], {})]
    empty, full = spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)
    root = stage_dir(spark)
    add_batch(state_of(empty, "e").unionByName(state_of(empty, "t")), root, "1")
    add_batch(state_of(full, "t"), root, "2")
    got = rows_of(merged(stored_states(spark, root)))
    e = got["e", "a.b", "double"]
    assert (e.rows, e.missing_pct, e.distinct_estimate, e.mean, e.q1, e.outlier_estimate) == (0, 0.0, 0, None, None, None)
    a = got["t", "a.b", "double"]
    assert (a.rows, a.nulls, a.nans, a.min, a.max, a.mean, a.distinct_estimate, a.outlier_estimate) == (4, 1, 1, 1.0, float("inf"), float("inf"), 4, None)
    b = got["t", "A.B", "int"]
    assert (b.nulls, b.mean, b.std, b.q1, b.q3, b.missing_pct) == (3, 1.0, 0.0, 1.0, 1.0, 75.0)
    assert {n: r.distinct_estimate for (d, n, _), r in got.items() if d == "t"} == {"a.b": 4, "A.B": 2, "__dq0": 3, "arr": 3, "m": 3}


def test_a_column_whose_type_changes_stands_once_for_each_type(spark):
    root = stage_dir(spark)
    add_batch(state_of(spark.range(10), "t"), root, "1")
    add_batch(state_of(spark.range(4).select(F.col("id").cast("string")), "t"), root, "2")
    got = rows_of(merged(stored_states(spark, root)))
    assert {k[2]: r.rows for k, r in got.items()} == {"bigint": 10, "string": 4}
