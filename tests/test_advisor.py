"""V1-V6 + K5 golden cases (FIXTURES section 4)."""

import pytest

from dqengine.operators.advisor import recommend_algorithms

SCHEMA = ("dataset STRING, total_rows BIGINT, missing_pct DOUBLE, outlier_count BIGINT, duplicate_rows BIGINT, "
          "has_imbalance BOOLEAN, has_high_corr BOOLEAN, problem_type STRING")

CASES = [
    (("a", 60000, 0.0, 0, 0, False, False, "classification"), [(1, 90), (0, 80), (8, 75), (2, 70), (5, 60)]),
    (("b", 800, 6.0, 48, 48, True, True, "classification"), [(1, 85), (0, 75), (5, 33), (9, 31), (2, 27)]),
    (("c", 200000, 0.0, 0, 0, False, False, "regression"), [(1, 98), (0, 80), (8, 75), (6, 72), (5, 60)]),
    (("d", 600000, 0.0, 0, 0, False, False, "classification"), [(1, 98), (0, 80), (2, 70), (8, 65), (5, 60)]),
    (("e", 600000, 0.0, 0, 0, False, False, "clustering"), [(7, 65)]),
    (("f", 5, 0.0, 0, 0, False, False, "regression"), []),
]


@pytest.fixture(scope="module")
def ranked(spark):
    inp = spark.createDataFrame([c for c, _ in CASES], SCHEMA)
    out = {}
    for r in recommend_algorithms(inp).orderBy("dataset", "rank").collect():
        out.setdefault(r.dataset, []).append((r.algo_idx, r.score))
    return out


@pytest.mark.parametrize("case,want", CASES)
def test_golden(ranked, case, want):
    assert ranked.get(case[0], []) == want


def test_reason_text(spark):
    inp = spark.createDataFrame([CASES[1][0]], SCHEMA)
    top = recommend_algorithms(inp).where("rank = 1").collect()[0]
    assert top.reason.startswith("Recommended for a classification task with 800 rows.")
    assert "Handles the 6.0% missing data natively." in top.reason
    assert top.reason.endswith("Strong fit for this dataset's profile.")
