"""Q1 routing (FIXTURES section 5) and Q4 text cleaning (section 6)."""

import pytest
from pyspark.sql import functions as F

from dqengine.operators.answers import clean_text, intent

ROUTES = [
    ("What are the main quality issues?", "health"),
    ("Which columns have most missing data?", "missing"),
    ("Is this data suitable for classification?", "model"),
    ("Explain the outliers found.", "outlier"),
    ("Which columns were dropped?", "column"),
    ("What was removed?", "dropped"),
    ("Do features correlate?", "column"),
    ("Show correlations", "correlation"),
    ("Is finance data fair?", "missing"),
    ("List every transaction", "recommend"),
    ("Is it html?", "model"),
    ("hello", "default"),
]


def test_routing(spark):
    df = spark.createDataFrame(ROUTES, "q STRING, want STRING")
    got = df.select("want", intent(F.col("q")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


FENCE = "`" * 3


@pytest.mark.parametrize("text,want", [
    (" hi ", "hi"),
    (f"{FENCE}json\n{{a}}\n{FENCE}", "{a}"),
    (f"a{FENCE}b", "ab"),
    (None, ""),
])
def test_clean_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(clean_text(F.col("t")).alias("c")).collect()[0].c == want
