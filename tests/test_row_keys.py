"""Rows that a key tells apart are not hashed."""


def test_rows_of_a_key_are_not_hashed(spark, monkeypatch):
    """A column of as many values as rows settles its dataset; one that only looks like a key does not."""
    from dqengine.operators import duplicates as D
    from dqengine.plans.report import profile_many
    hashed, digest = [], D._digest
    monkeypatch.setattr(D, "_digest", lambda f, keys: (hashed.append(len(keys)), digest(f, keys))[1])
    frames = {
        "key": spark.range(200).selectExpr("id - 100 AS a", "'x' AS b"),
        "twice": spark.range(200).selectExpr("CASE WHEN id IN (5, 9) THEN 3 ELSE id END AS a", "'x' AS b", "1 AS c"),
        "sparse": spark.range(200).selectExpr("id * 100000 AS a", "'x' AS b", "1 AS c", "2 AS d"),
        "nulls": spark.range(200).selectExpr("CASE WHEN id > 3 THEN id END AS a", "'x' AS b", "1 AS c", "2 AS d", "3 AS e"),
        "huge": spark.range(200).selectExpr("9007199254740992 + id DIV 2 AS a", "'x' AS b", "1 AS c", "2 AS d", "3 AS e", "4 AS f"),
        "none": spark.range(0).selectExpr("id AS a", "'x' AS b", "1 AS c", "2 AS d", "3 AS e", "4 AS f", "5 AS g"),
    }
    found = {r.dataset: r.duplicate_rows for r in profile_many(frames).duplicates.collect()}
    assert found == {"key": 0, "twice": 2, "sparse": 0, "nulls": 3, "huge": 100, "none": 0}
    assert set(hashed) == {3, 4, 5, 6, 7}  # not the two columns of "key"
