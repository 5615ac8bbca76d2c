"""Numeric columns are profiled from counted values."""


def test_numbers_are_read_from_counted_values(spark):
    """Distinct values, quartiles and outliers of a column that repeats come from one
    row for each value."""
    import numpy as np

    from dqengine.operators.profile import ColumnProfiler, base_stats
    rows = [(float(i % 5), i * 3 - 500, None if i % 4 else i) for i in range(2000)] + [(float("nan"), 7, None), (-0.0, 2**53 + 1, None), (1e9, 2**53, 1)]
    df = spark.createDataFrame(rows, "a DOUBLE, b BIGINT, c INT")
    p = ColumnProfiler([(df, base_stats(df, "t"))])
    assert p.numeric_distinct() == {("t", 0): 7, ("t", 1): 2003 - 1}
    found = p.outliers()
    for pos in (0, 1):
        x = np.array([r[pos] for r in rows], float)
        x = x[~np.isnan(x)]
        q1, q3 = np.percentile(x, [25, 75])
        out = int(((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum())
        assert found["t", pos][:4] == (len(x), q1, q3, out)
    assert p.numbers.where("column = 0").count() == 7
