"""Whole numbers counted by blocks, and inputs that need no dealing out."""

import numpy as np
import pytest


def test_blocks_equal_single_values(spark, monkeypatch):
    """Distinct values, quartiles and outliers are the same by blocks of 64 as by value."""
    from dqengine.operators import profile as P
    rng = np.random.default_rng(5)
    dense = [int(x) for x in rng.integers(-700, 900, 3000)]
    rows = [(x, x * 2**40, x % 7, 2**53 + x, None if i % 2 else -abs(x) // 9, x / 3) for i, x in enumerate(dense)]
    rows += [(4000, 0, 5000, 2**53, -5000, 1.0), (-4000, 1, -5000, 0, 5000, -0.0), (None,) * 6]
    df = spark.createDataFrame(rows, "a BIGINT, gaps BIGINT, few INT, far BIGINT, nulls SMALLINT, real DOUBLE")
    stats = P.base_stats(df, "t")

    def found():
        p = P.ColumnProfiler([(df, stats)])
        return p.numeric_distinct(), p.outliers(), p.numbers

    distinct, outliers, numbers = found()
    assert numbers.where("n_values > 1").count() == 0
    monkeypatch.setattr(P, "BLOCK_VALUES", 100)
    by_blocks = found()
    assert by_blocks[:2] == (distinct, outliers)
    blocks = {r["column"]: r.n for r in by_blocks[2].where("n_values > 1").groupBy("column").count().withColumnRenamed("count", "n").collect()}
    assert set(blocks) == {0, 2, 4} and by_blocks[2].where("column = 0").count() < distinct["t", 0] / 20
    x = np.array([r[0] for r in rows[:-1]], float)
    q1, q3 = np.percentile(x, [25, 75])
    assert by_blocks[1]["t", 0][:4] == (len(x), q1, q3, int(((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()))


@pytest.mark.parametrize("even", [True, False])
def test_input_that_is_dealt_out_evenly_is_not_written_again(spark, tmp_path, monkeypatch, even):
    """One file of many row groups is read by many tasks as it lies; of one row group, by one."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from dqengine.plans import report as R
    cores = spark.sparkContext.defaultParallelism
    n = 20_000 * cores
    pq.write_table(pa.table({"a": np.arange(n), "b": np.random.default_rng(1).random(n)}), tmp_path / "t.parquet", row_group_size=n // (4 * cores) if even else n)
    monkeypatch.setattr(R, "WORTH_SPREADING", 1)
    size = (tmp_path / "t.parquet").stat().st_size
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert (R.spread(df) is df) == even
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
