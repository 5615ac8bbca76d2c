"""A5: exact quantiles equal numpy's linear interpolation, on random data, on a
hot value holding a third of all rows, on infinities and extreme exponents, and
for any number of partitions and bits a pass."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dqengine.operators import quantiles as Q


def _check(spark, groups, partitions=5, bits=None):
    """Columns of unequal length, padded with nulls and NaN."""
    n = max(map(len, groups.values()))
    padded = [[float(x) for x in v] + [None, float("nan")] * ((n - len(v)) // 2) + [None] * ((n - len(v)) % 2) for v in groups.values()]
    df = spark.createDataFrame(list(zip(*padded, strict=True)), ", ".join(f"c{i} DOUBLE" for i in groups)).repartition(partitions)
    got = Q.quantiles([(df, [(i, f"c{i}") for i in groups])], {i: len(v) for i, v in groups.items()}, bits=bits)
    for i, v in groups.items():
        with np.errstate(invalid="ignore"):
            assert repr(got[i]) == repr(tuple(map(float, np.percentile(np.asarray(v, dtype=float), [25, 75])))), i


def test_skewed_hot_value(spark):
    rng = np.random.default_rng(7)
    hot = [42.0] * 3000 + list(rng.normal(0, 100, 6000))
    _check(spark, {0: hot, 1: list(rng.integers(0, 50, 2000)), 2: [1.0, 2.0]}, partitions=7)


@pytest.mark.parametrize("partitions,bits", [(1, None), (3, 16), (16, 7), (4, 13)])
def test_partitions_and_bits(spark, partitions, bits):
    rng = np.random.default_rng(partitions)
    _check(spark, {0: list(rng.exponential(10, 5000)), 3: list(rng.integers(-5, 5, 777)), 4: list(rng.normal(0, 1, 500) * 10.0 ** rng.integers(-300, 300, 500))}, partitions, bits)


def test_infinities_zeros_and_single_values(spark):
    inf = float("inf")
    _check(spark, {0: [1.0, 2.0, 3.0, inf, inf, inf, inf, -inf, -inf, -inf], 1: [-inf] * 9 + [inf], 2: [0.0, 0.0, -1.0, 5e-324], 3: [7.5], 4: [-3.0] * 5})
    assert Q.quantiles([(spark.createDataFrame([(None,)], "c0 DOUBLE"), [(0, "c0")])], {0: 0}) == {}


def test_order_of_bits():
    x = np.array([-np.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.5, 1e300, np.inf])
    u = Q.ordered(x)
    assert (np.diff(u.astype(object)) >= 0).all() and u[4] == u[5]
    assert [Q.value_of(int(v)) for v in u] == x.tolist()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_random_lists(spark, values):
    _check(spark, {0: [v + 0.0 for v in values]}, partitions=4)


@pytest.mark.parametrize("values", [[900.0, 901.5, 104949.5, 5000.25], [-3.0, -2.5, 7.0], [-0.0, 0.0], [5.0, 5.0, 5.0],
                                    [float("-inf"), 1.0, 2.0, float("inf")], [1e-320, 1e308]])
def test_known_ends_change_no_result(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    ends = {0: (min(values), max(values))}
    known, prefix = Q.common_bits(*ends[0])
    assert all(int(u) >> (64 - known) == prefix for u in Q.ordered(np.array(values)))
    counts = {0: len(values)}
    plain = Q.quantiles([(df, [(0, "x")])], counts, (0.25, 0.5, 0.75))
    assert repr(Q.quantiles([(df, [(0, "x")])], counts, (0.25, 0.5, 0.75), ends=ends)) == repr(plain)
    assert repr(Q.quantiles([(df, [(0, "x")])], counts, (0.25, 0.5, 0.75), bits=7, ends=ends)) == repr(plain)
