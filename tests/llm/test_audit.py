"""Filter orders against a plain simulation of each order."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from dqengine.llm import audit as A
from dqengine.llm.queries import ORACLES, QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")
CALM = " ".join(f"word{i}" for i in range(220))


def simulated(docs, labels):
    """Every order applied document by document."""
    least, good, toxic = {}, set(), set()
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    for k, q, x in labels:
        good |= {k} if q == 1 else set()
        toxic |= {k} if x == 1 else set()
    parts = defaultdict(list)
    for k, t, s in docs:
        t = t or ""
        words = WORD.findall(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": k is not None and k > least[t]}
        parts[s or ""].append((k, fails))
    out = {}
    for part, rows in parts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(r[1][f] for r in rows) - len(removed),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in rows),
                    sum(r[0] in good and r[0] is not None for r in removed), sum(r[0] in toxic and r[0] is not None for r in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in (*A.COUNTS, "shapley")] for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Nulls, empty and repeated rows, ties, copies across parts, clashing names."""
    rnd = random.Random(3)
    texts = [None, "", "short", CALM, CALM + " #", CALM.upper(), "same " * 300, "SAME " * 300 + "$", CALM + " é\x0b 日本　x"]
    docs = [(None if i % 17 == 0 else i % 50, rnd.choice(texts), rnd.choice([None, "", "a", "b"])) for i in range(130)]
    docs += docs[:5]
    labels = [(None if i % 9 == 0 else i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(40)] + [(7, 1, 0), (7, 0, 1)]
    folder = str(tmp_path_factory.mktemp("audit"))
    spark.createDataFrame([(k, t, s, "x", 1) for k, t, s in docs], "doc_id long, text string, source string, digest string, n int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, labels


def test_every_order_is_as_if_applied(spark, tables):
    folder, docs, labels = tables
    got = QUERIES["op11_filter_audit"](spark, folder)
    assert result(got) == simulated(docs, labels)


def test_sql_says_the_same(spark, tables):
    import duckdb
    folder, docs, labels = tables
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    rel = con.sql(ORACLES["op11_filter_audit"])
    at = {c: i for i, c in enumerate(rel.columns)}
    rows = rel.fetchall()
    assert {(r[at["part"]], r[at["filter_order"]], r[at["step"]]): [r[at[c]] for c in (*A.COUNTS, "shapley")] for r in rows} == simulated(docs, labels)


def test_tables_without_rows_and_any_number_of_filters(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    rows = A.text_measures(docs)
    assert rows.collect() == []
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 3, 1), ("p", 3, 2, 0, 2), ("p", 3, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    assert A.audit(cells.limit(0), "XY").collect() == []
    got = result(A.audit(cells, "XY"))
    assert got == {("p", "XY", 1): [5, 6, 0, 3, 3, 3, 9], ("p", "XY", 2): [5, 0, 3, 0, 0, 0, 3],
                   ("p", "YX", 1): [8, 3, 0, 0, 0, 2, 3], ("p", "YX", 2): [5, 3, 3, 3, 3, 1, 9]}


def test_long_text_and_missing_part(spark):
    long = ("Ab c# " * 400_000).strip()
    row = A.text_measures(spark.createDataFrame([(1, long)], "doc_id int, text string")).first()
    assert (row.part, row.n_words, row.n_distinct, row.n_upper, row.n_chars, row.n_marks) == ("", 800_000, 2, 400_000, len(long), 400_000)


def test_a_condition_that_is_null_does_not_hold(spark):
    got = spark.range(1).select(A.mask_of([F.lit(None).cast("boolean"), F.lit(True), F.lit(False)]).alias("m")).first().m
    assert got == 2
