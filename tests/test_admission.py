"""What a listing's suffixes and sizes decide."""

from dqengine.operators.catalog import admission

MIB = 1024 * 1024
CASES = [("a.csv", 0, ".csv", True), ("d.x/A.XLSX", 50 * MIB, ".xlsx", True), ("a.xls", 50 * MIB + 1, ".xls", False),
         ("d.csv/a", 1, "", False), ("a.csv.gz", 1, ".gz", False), ("a.", 1, "", False)]


def test_admission(spark):
    df = spark.createDataFrame([c[:2] for c in CASES], "path STRING, length LONG")
    got = {r.path: r for r in admission(df).collect()}
    for path, _, suffix, ok in CASES:
        assert (got[path].suffix, got[path].admitted, got[path].reason is None) == (suffix, ok, ok)
    assert got["a.xls"].reason == "File exceeds the 50 MB limit." and got["a.csv.gz"].reason == "Unsupported file type '.gz'. Use CSV or Excel."
    assert admission(df, None).where("admitted").count() == 3 and admission(df.limit(0)).count() == 0
