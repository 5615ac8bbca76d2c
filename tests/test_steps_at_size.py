"""Steps of the profile that must not slow down or move more than they need."""

import math

import numpy as np


def test_counted_quantiles_by_width_need_no_python(spark, monkeypatch):
    """Columns of usual values are settled by bins of equal width; the rest goes on by bits."""
    from dqengine.operators import quantiles as Q
    rng = np.random.default_rng(3)
    columns = [rng.normal(0, 1, 900), np.arange(1000.0), np.array([1.5] * 9), np.array([0.0, 5e-324]), np.array([-1.7e308, 1.7e308, 0.0]),
               np.append(rng.normal(1e15, 1, 999), 1e300), np.repeat([1.0, 2.0, 7.0], [600, 1, 3])]
    rows = [(i, float(v), int(n)) for i, x in enumerate(columns) for v, n in zip(*np.unique(x, return_counts=True), strict=True)] + [(0, math.nan, 3)]
    counted = spark.createDataFrame(rows, "column INT, value DOUBLE, cnt LONG")
    counts, ends = {i: len(x) for i, x in enumerate(columns)}, {i: (x.min(), x.max()) for i, x in enumerate(columns)}
    want = Q.quantiles([], counts, counted=counted)  # without ends: by bits alone
    assert Q.quantiles([], counts, ends=ends, counted=counted) == want
    with np.errstate(over="ignore"):
        assert all(np.allclose(want[i], np.percentile(x, [25, 75])) for i, x in enumerate(columns) if i not in (3, 4))
    monkeypatch.setattr(Q, "_counted_histogram", None)
    usual = [i for i in counts if i not in (3, 5)]
    assert Q.quantiles([], {i: counts[i] for i in usual}, ends=ends, counted=counted) == {i: want[i] for i in usual}


def test_times_are_grouped_before_they_are_shown(spark):
    """Texts are made of distinct times only, and times that are shown alike are one value."""
    from dqengine.functions.keys import Placed, positional, specs_of
    from dqengine.operators.frequency import frequency_table
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        df = spark.createDataFrame([(1635640200, True), (1635643800, None), (1635643800, False), (0, True), (None, True)], "s LONG, b BOOLEAN") \
                  .selectExpr("timestamp_seconds(s) AS t", "b", "date '2020-01-02' AS d")  # the first two: 02:30 twice, an hour apart
        table = frequency_table(Placed(positional(df)), specs_of(df.schema))
        found = {(r.pos, r.key): r.cnt for r in table.collect()}
        assert found == {(0, "2021-10-31 02:30:00"): 3, (0, "1970-01-01 01:00:00"): 1, (1, "True"): 3, (1, "False"): 1, (2, "2020-01-02"): 5}
        assert "Expand" not in table._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rows_pass_the_filter_before_they_are_shuffled(spark, monkeypatch):
    """The optimizer may not move the join of repeated digests below the filter of fixed size."""
    from dqengine.functions.keys import specs_of
    from dqengine.operators import duplicates as D
    monkeypatch.setattr(D, "BROADCAST_DIGESTS", 0)
    kind = type(spark.range(1))
    plans, collect = [], kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (plans.append(self._jdf.queryExecution().optimizedPlan().toString()), collect(self))[1])
    df = spark.range(1000).selectExpr("id % 700 AS a", "cast(id % 700 AS STRING) AS b")
    assert [r.duplicate_rows for r in D.duplicates_of([(df, specs_of(df.schema), "t")]).collect()] == [300]
    lines = next(p for p in plans if "shiftleft" in p).splitlines()
    depth = lambda kind: [i for i, x in enumerate(lines) if kind in x and "Join" in x]
    assert not depth("LeftSemi") and len(depth("Inner")) == 2
    assert "slot" in lines[depth("Inner")[1]] and "d1" in lines[depth("Inner")[0]]


def test_few_columns_are_added_up_by_spark(spark):
    from dqengine.operators.correlation import co_moments
    df = spark.range(50).selectExpr("double(id) AS a", "double(id * id) AS b")
    plain = co_moments(df, np.array([25.0, 800.0]))
    assert "MapInArrow" not in plain._jdf.queryExecution().executedPlan().toString()
    key = lambda rows: sorted((r.a, r.b, r.n, round(r.s, 6), str(r.lo), str(r.hi)) for r in rows)
    assert [x[:4] for x in key(plain.collect())] == [x[:4] for x in key(co_moments(df, np.array([25.0, 800.0]), tile=1).collect())]
    assert co_moments(df.limit(0), np.zeros(2)).count() == 0


def test_parts_are_planned_once(spark):
    """What other outputs are made of, and the reports, are read back: plans over them hold no grouping."""
    from conftest import profile_of
    p = profile_of(spark, [(float(i), i % 3, "ab"[i % 2]) for i in range(30)], "a DOUBLE, b INT, c STRING")
    for df in (p.flags, p.summary, p.reports()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan


def test_sketches_hash_numbers_and_times_as_they_are(spark):
    from dqengine.operators.sketches import approximate, state_of
    df = spark.range(2000).selectExpr("CASE WHEN id % 2 = 0 THEN 0D ELSE -0D END AS zero", "double('NaN') AS nan", "timestamp_seconds(id) AS t",
                                      "id % 2 = 0 AS b", "cast(id as decimal(20,2)) AS d", "CASE WHEN id % 2 = 0 THEN '' END AS s")
    state = state_of(df, "t")
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    assert " as string" not in plan
    found = {r.name: r.distinct_estimate for r in approximate(state).collect()}
    assert (found["zero"], found["nan"], found["b"], found["s"]) == (1, 1, 2, 2)
    assert abs(found["t"] - 2000) < 80 and abs(found["d"] - 2000) < 80
