"""CSV cells are looked at once, by cheap patterns first."""

from pyspark.sql import functions as F


def test_csv_rows_are_parsed_once(spark, tmp_path):
    """The typed rows come from a written table, not from the text again."""
    from dqengine.sources.files import read_csv
    p = tmp_path / "a.csv"
    p.write_text("a,b,c\n1,2.5,x\n2,3.25,\n")
    df = read_csv(spark, str(p))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    assert not any(f.endswith("a.csv") for f in df.inputFiles())
    assert sorted(map(tuple, df.collect())) == [(1, 2.5, "x"), (2, 3.25, None)]


def test_plain_types_agree_with_cell_types(spark):
    from dqengine.sources.files import cell_types, plain_types
    cells = ["0", "-0", "7", "-12", "007", "+1", "999999999999999", "1234567890123456", "1.5", "-0.0", "0.000001", "1.5\n", "12\n", "1e4", "1E-4", "1995-03-04",
             "true", "True", "TRUE", "tRue", "NaN", "inf", "-inf", "Infinity", "-Infinity", "-", ".", "", "N", "F", "x y", "10D", "1.2.3", ".5", "5.", None]
    df = spark.createDataFrame([(c,) for c in cells], "c STRING")
    for r in df.select("c", plain_types(F.col("c")).alias("p"), cell_types(F.col("c")).alias("t")).collect():
        assert r.p in (None, r.t), r
    assert df.where(plain_types(F.col("c")).isNotNull()).count() > 15
