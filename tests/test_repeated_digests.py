"""More repeated rows than are broadcast."""

import pytest


@pytest.mark.parametrize("limit", [0, 500_000])
def test_repeated_rows_beyond_the_broadcast(spark, monkeypatch, limit):
    from dqengine.functions.keys import specs_of
    from dqengine.operators import duplicates as D
    monkeypatch.setattr(D, "BROADCAST_DIGESTS", limit)
    df = spark.range(1000).selectExpr("id % 700 AS a", "CASE WHEN id % 700 % 3 = 0 THEN NULL ELSE cast(id % 700 AS STRING) END AS b")
    parts = [(df, specs_of(df.schema), "t"), (df.limit(0), specs_of(df.schema), "none")]
    assert {r.dataset: r.duplicate_rows for r in D.duplicates_of(parts).collect()} == {"t": 300, "none": 0}
