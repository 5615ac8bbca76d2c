"""Driver contract and the dirty-view expectations of FIXTURES section 2."""

import pytest

import __spark_entry__ as E
from conftest import SF01


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].dataset == "lineitem"
    assert 10 <= rows[0].health_score <= 100


def test_every_oracle_has_a_query():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 40


@pytest.fixture(scope="module")
def dirty_profile(spark):
    from dqengine.plans.dirty import dirty
    from dqengine.plans.report import profile
    return profile(dirty(spark, SF01), "dirty")


def test_dirty_summary(dirty_profile):
    s = dirty_profile.summary.collect()[0]
    assert (s.total_rows, s.total_columns, s.duplicate_rows) == (61176, 11, 1176)
    assert (s.missing_cells, s.missing_cells_exact, s.missing_pct) == (20353, 20354, 3.02)
    assert s.outlier_count == 8328
    assert (s.health_score, s.completeness_score, s.consistency_score, s.noise_score) == (46, 94.0, 92.3, 79.6)


def test_dirty_flags_and_recs(dirty_profile):
    flags = [(r.rule_id, r.column) for r in dirty_profile.flags.orderBy("seq").collect()]
    assert flags == [("F1", "l_extendedprice"), ("F1", "gross"), ("F2", "l_discount"), ("F3", "spiky"),
                     ("F4", "noisy"), ("F5", "l_extendedprice~gross"), ("F6", "klass")]
    recs = [r.rule_id for r in dirty_profile.recommendations.orderBy("seq").collect()]
    assert recs == ["R1", "R2", "R3", "R4", "R5"]


def test_dirty_distinct_and_pairs(dirty_profile):
    u = {r.name: r.unique_count for r in dirty_profile.columns.collect()}
    assert u["l_discount"] == 12 and u["gross"] == 59979 and u["konst"] == 1
    pairs = dirty_profile.correlations.orderBy("rank").collect()
    assert len(pairs) == 28 and all("konst" not in (p.col1, p.col2) for p in pairs)
    assert (pairs[0].col1, pairs[0].col2, pairs[0].value) == ("l_extendedprice", "gross", 1.0)
