"""FIXTURES section 3: unit goldens of the column profile (A3, A4, A6, A8,
A9, P1, F2, F6, A11, R6)."""

from conftest import col_row, profile_of


def test_a6_outlier_one_of_five(spark):
    p = profile_of(spark, [(float(x),) for x in [1, 2, 3, 4, 100]], "x DOUBLE")
    r = col_row(p, "x")
    assert (r.q1, r.q3) == (2.0, 4.0)
    assert (r.outlier_count, r.outlier_pct) == (1, 20.0)


def test_a6_zero_iqr_guard(spark):
    p = profile_of(spark, [(float(x),) for x in [5, 5, 5, 5, 100]], "x DOUBLE")
    r = col_row(p, "x")
    assert (r.outlier_count, r.outlier_pct) == (0, 0.0)


def test_a6_fewer_than_four_values(spark):
    p = profile_of(spark, [(float(x),) for x in [1, 2, 100]], "x DOUBLE")
    r = col_row(p, "x")
    assert (r.outlier_count, r.outlier_pct) == (0, 0.0)


def test_a3_null_counts_as_a_value(spark):
    p = profile_of(spark, [("a",), ("a",), (None,)], "s STRING")
    assert col_row(p, "s").unique_count == 2


def test_a4_population_std(spark):
    p = profile_of(spark, [(1.0,), (3.0,)], "x DOUBLE")
    r = col_row(p, "x")
    assert (r.mean, r.std, r.min, r.max) == (2.0, 1.0, 1.0, 3.0)


def test_a8_duplicates_after_drop(spark):
    # second column is 100 % null -> dropped first; then rows 1 and 2 are equal
    p = profile_of(spark, [(1, None), (1, None), (2, None)], "a INT, b STRING")
    s = p.summary.collect()[0]
    assert s.duplicate_rows == 1
    assert s.dropped_count == 1


def test_a8_nulls_compare_equal(spark):
    p = profile_of(spark, [(1, None), (1, None), (2, "x"), (2, "y")] * 1, "a INT, b STRING")
    assert p.summary.collect()[0].duplicate_rows == 1


def test_a9_missing_cells_formula(spark):
    p = profile_of(spark, [(1, 1), (2, None), (3, 3)], "a INT, b INT")
    s = p.summary.collect()[0]
    # 33.33 % rounded, * 3 rows / 100 = 0.9999 -> 0 cells (D1); exact is 1
    assert (s.missing_cells, s.missing_cells_exact, s.missing_pct) == (0, 1, 0.0)


def test_p1_drop_threshold(spark):
    rows = [(i, None if i < 6 else i, None if i < 7 else i) for i in range(10)]
    p = profile_of(spark, rows, "k INT, six INT, seven INT")
    kept = {r.name for r in p.columns.collect()}
    assert kept == {"k", "six"}
    assert [r.name for r in p.dropped.collect()] == ["seven"]
    # 60 % missing is kept and is not an F2 flag (F2 needs < 60)
    assert not [r for r in p.flags.collect() if r.rule_id == "F2" and r.column == "six"]


def test_f2_five_percent_not_flagged(spark):
    rows = [(i, None if i == 0 else float(i)) for i in range(20)]
    p = profile_of(spark, rows, "k INT, x DOUBLE")
    assert col_row(p, "x").missing_pct == 5.0
    assert not [r for r in p.flags.collect() if r.rule_id == "F2"]


def test_f6_imbalance_boundary(spark):
    flagged = profile_of(spark, [("a",)] * 8 + [("b",)] * 2, "c STRING")
    assert [r.rule_id for r in flagged.flags.collect()].count("F6") == 1
    not_flagged = profile_of(spark, [("a",)] * 7 + [("b",)] * 2, "c STRING")
    assert "F6" not in [r.rule_id for r in not_flagged.flags.collect()]


def test_a11_constant_column_no_pair_no_error(spark):
    rows = [(float(i), 1.0, float(2 * i)) for i in range(10)]
    p = profile_of(spark, rows, "a DOUBLE, k DOUBLE, b DOUBLE")
    pairs = [(r.col1, r.col2, r.value) for r in p.correlations.collect()]
    assert pairs == [("a", "b", 1.0)]


def test_r6_row_count_bands(spark):
    from pyspark.sql import functions as F
    from dqengine.plans.report import profile
    for n, expect in [(999, ["small"]), (1000, [])]:
        df = spark.range(n).select((F.col("id") % 7).alias("x"))
        r6 = [r.message for r in profile(df, "t").recommendations.collect() if r.rule_id == "R6"]
        assert ["small" if "only" in m else "large" for m in r6] == expect, (n, r6)


def test_boolean_top_values_capitalised(spark):
    p = profile_of(spark, [(True,), (True,), (False,)], "b BOOLEAN")
    tv = col_row(p, "b").top_values
    assert [(t["value"], t["count"]) for t in tv] == [("True", 2), ("False", 1)]


def test_zero_rows(spark):
    p = profile_of(spark, [], "a INT, s STRING")
    s = p.summary.collect()[0]
    assert s.total_rows == 0 and s.health_score == 100
    assert not p.flags.collect()


def test_infinite_values_are_no_outliers(spark):
    inf = float("inf")
    p = profile_of(spark, [(x,) for x in [1.0, 2.0, 3.0, inf, inf, inf, inf, -inf, -inf, -inf]], "x DOUBLE")
    r = col_row(p, "x")
    assert (r.outlier_count, r.max, r.min) == (0, inf, -inf)


def test_column_names_are_data(spark):
    p = profile_of(spark, [(1.0, 2.0, "x"), (2.0, 4.0, "y"), (3.0, 5.0, "y")], "`a``b` DOUBLE, `A``B` DOUBLE, `c.d` STRING")
    assert {r.name for r in p.columns.collect()} == {"a`b", "A`B", "c.d"}
    assert [(r.col1, r.col2) for r in p.correlations.collect()] == [("a`b", "A`B")]


def test_maps_and_variants_in_duplicates(spark):
    from pyspark.sql import functions as F
    from dqengine.plans.report import profile
    df = spark.createDataFrame([({"a": 1, "b": 2}, "{}"), ({"b": 2, "a": 1}, "{}"), ({"a": 3}, "[1]")], "m MAP<STRING, INT>, j STRING")
    df = df.select("m", F.parse_json("j").alias("v"))
    assert profile(df, "t").summary.first().duplicate_rows == 1


def test_no_columns_left(spark):
    p = profile_of(spark, [(None, None)] * 3, "a INT, b STRING")
    assert [(r.rule_id, r.column) for r in p.flags.collect()] == [("D12", "no_columns")]


def test_pairs_of_few_rows_and_many_columns(spark):
    wide = ", ".join(f"x{i} DOUBLE" for i in range(60))
    for n in (0, 1):
        p = profile_of(spark, [tuple(float(i * j) for i in range(60)) for j in range(n)], wide)
        assert p.correlations.collect() == []
    import numpy as np
    x = np.random.default_rng(0).normal(1e6, 1, (50, 60))
    x[:, 7] = 2 * x[:, 3] + 1e-3 * x[:, 7]
    p = profile_of(spark, [tuple(map(float, r)) for r in x], wide)
    c = np.corrcoef(x.T)
    got = p.correlations.orderBy("rank").collect()
    assert len(got) == 30 and got[0].left_out == 60 * 59 // 2 - 30
    assert all(abs(r.value - c[r.i, r.j]) < 6e-5 for r in got) and (got[0].i, got[0].j) == (3, 7)


def test_rounding_is_pythons(spark):
    import random
    from dqengine.functions.scalar import py_round
    rnd = random.Random(2)
    xs = [rnd.uniform(-1, 1) * 10 ** rnd.randint(-8, 16) for _ in range(3000)] + [0.5, 1.5, 2.675, 1e300, 5e-324, 123456789.0000005]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i INT, x DOUBLE")
    for k in (0, 2, 4, 6):
        got = {r.i: r.y for r in df.select("i", py_round(df.x, k).alias("y")).collect()}
        assert all(got[i] == round(x, k) for i, x in enumerate(xs)), k


def test_long_texts_tie_by_whole_value(spark):
    head = "h" * 64
    rows = [(head + f"{i:02d}",) for i in range(25)] + [("short",), ("short",)]
    p = profile_of(spark, rows, "s STRING")
    tv = col_row(p, "s").top_values
    assert [(t["value"], t["count"]) for t in tv] == [("short", 2)] + [(head + f"{i:02d}", 1) for i in range(9)]


def test_top_values_of_unique_texts_with_a_common_head(spark):
    from pyspark.sql import functions as F
    from dqengine.operators.profile import ColumnProfiler, base_stats
    from dqengine.plans.report import profile
    head = "<html lang='en'>" * 13  # 208 characters
    texts = spark.range(100_000).select(F.concat(F.lit(head), F.format_string("%06d", (F.col("id") * 7919) % 100_000), F.lit(" tail")).alias("s"))
    more = spark.createDataFrame([("short",)] * 3 + [(head,)] * 2 + [(head[:64],)] * 2, "s STRING")
    df = texts.union(more)
    found = ColumnProfiler([(df, base_stats(df, "t"))]).top_keys()
    assert [len(v) for v in found.values()] == [10]  # candidate rows that leave the tasks
    tv = profile(df, "t").columns.first().top_values
    assert [(t["value"], t["count"]) for t in tv] == [("short", 3), (head[:64], 2), (head, 2)] + [(f"{head}{i:06d} tail", 1) for i in range(7)]


def test_top_values_with_many_ties(spark):
    import random
    from collections import Counter
    rnd = random.Random(4)
    for _ in range(3):
        pool = ["a" * n + rnd.choice("bc") * rnd.randint(0, 140) for n in (0, 3, 63, 64, 65, 128, 190)] + [f"x{i}" for i in range(9)]
        rows = [(rnd.choice(pool),) for _ in range(60)] + [(None,)] * 3
        tv = col_row(profile_of(spark, rows, "s STRING"), "s").top_values
        want = sorted(Counter(r[0] for r in rows if r[0] is not None).items(), key=lambda x: (-x[1], x[0]))[:10]
        assert [(t["value"], t["count"]) for t in tv] == want


def test_duplicates_with_equal_digests(spark):
    from pyspark.sql import functions as F
    from dqengine.functions.keys import specs_of
    from dqengine.operators.duplicates import duplicates_of
    rows = [(1, None, 0.0), (1, None, -0.0), (None, 1, 0.0), (1, "x" * 100, None), (1, "x" * 100, None), (1, "x" * 99 + "y", None), (2, "1", float("nan")), (2, "1", float("nan"))]
    df = spark.createDataFrame([(a, None if b is None else str(b), c) for a, b, c in rows], "a INT, b STRING, c DOUBLE")
    one = lambda keys: (F.lit(1).cast("long"), F.lit(2).cast("long"))
    for kw in ({}, {"digest": one}):
        got = duplicates_of([(df, specs_of(df.schema), "t"), (df.limit(0), specs_of(df.schema), "empty"), (df, [], "none")], **kw)
        assert {r.dataset: r.duplicate_rows for r in got.collect()} == {"t": 3, "empty": 0, "none": 0}


def test_names_that_look_like_places(spark):
    p = profile_of(spark, [(1, "a"), (2, "b")], "__dq1 INT, __dq0 STRING")
    assert {(r.name, r.kind) for r in p.columns.collect()} == {("__dq1", "numeric"), ("__dq0", "categorical")}
    assert [r.name for r in profile_of(spark, [(5,)], "__dqx INT").columns.collect()] == ["__dqx"]


def test_co_moments_in_tiles(spark):
    import numpy as np
    from dqengine.operators.correlation import co_moments
    x = np.random.default_rng(5).normal(50, 3, (300, 11))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} DOUBLE" for i in range(11))).repartition(4)
    for tile, shift in ((4, 50.0), (11, 0.0), (100, 49.0), (1, 50.0)):
        rows = {(r.a, r.b): r for r in co_moments(df, np.full(11, shift), tile).collect()}
        assert len(rows) == 11 * 12 // 2 + 11
        for (a, b), r in rows.items():
            assert r.n == 300
            if b == -1:
                assert abs(r.s - (x[:, a] - shift).sum()) < 1e-8 and (r.lo, r.hi) == (x[:, a].min(), x[:, a].max())
            else:
                assert abs(r.s - ((x[:, a] - shift) * (x[:, b] - shift)).sum()) < 1e-6
