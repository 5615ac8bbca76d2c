"""Positive-unlabelled classifier: moments, solver, held-out accuracy."""

import zlib

import numpy as np
import pytest
from conftest import SF01, SF001

from dqengine.llm import quality as Q
from dqengine.sources.tables import read_table


def test_features_are_shares(monkeypatch):
    texts = [None, "", " \n", "word", "Und " * 400, "A!! B!! C!!", "a | b | c", "x*** y### z$$$", "\x00\x01", "é" * 50, "one\none\ntwo"]
    whole = [Q.features(t) for t in texts]
    assert all(len(f) == len(Q.FEATURES) and all(0 <= x <= 1 for x in f) for f in whole)
    assert whole[0] == whole[1] == whole[2] and whole[0][-1] == 1
    monkeypatch.setattr("dqengine.llm.simhash.TEXT_BLOCK", 16)
    assert [Q.features(t) for t in texts] == whole


def test_moments_and_scores(spark):
    rng = np.random.default_rng(0)
    shares = rng.random((500, len(Q.FEATURES))) ** 4
    df = spark.createDataFrame([(i, [float(x) for x in s]) for i, s in enumerate(shares)], "k long, shares array<double>").repartition(4)
    n, mean, second = Q.moments(df)
    x = Q._steps(shares)
    assert n == 500 and np.allclose(mean, x.mean(0)) and np.allclose(second, x.T @ x / 500)
    w = rng.normal(size=x.shape[1]) * 0.2
    got = {r.k: r.s for r in df.select("k", Q._score(w, df.shares).alias("s")).collect()}
    assert np.allclose([got[i] for i in range(500)], np.clip((1 + x @ w) / 2, 0, 1))


def test_solver_minimises_the_non_negative_risk():
    rng = np.random.default_rng(1)
    for prior in (0.5, 0.95):
        p = np.concatenate([np.ones((4000, 1)), rng.normal(1, 1, (4000, 2))], axis=1)
        n = np.concatenate([np.ones((4000, 1)), rng.normal(-1, 1, (4000, 2))], axis=1)
        u = np.concatenate([p[:2000], n[:2000]])
        args = p.mean(0), p.T @ p / len(p), u.mean(0), u.T @ u / len(u)
        w = Q.solve(prior, *args)

        def risk(w, prior=prior, p=p, u=u):
            loss = lambda g, y: ((1 - y * g) ** 2 / 4).mean()
            return prior * loss(p @ w, 1) + max(0, loss(u @ w, -1) - prior * loss(p @ w, -1)) + Q.RIDGE / 2 * w @ w
        best = min(risk(w + d) for d in rng.normal(0, 0.05, (300, 3)))
        assert risk(w) <= best + 1e-9


def test_held_out_accuracy(spark):
    docs, labels = read_table(spark, SF01, "documents"), read_table(spark, SF01, "labels")
    got = Q.quality_scores(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    test = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (test.predicted == test.quality).mean() > 0.97
    good = test[test.quality == 1]
    assert (good.predicted == 1).mean() > 0.98
    kept = Q.of_quality(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(got[got.predicted == 1].doc_id)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = read_table(spark, SF001, "documents"), read_table(spark, SF001, "labels")
    flipped = labels.withColumn("quality", Q.F.when(Q.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    one, two = (Q.quality_scores(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert np.allclose(one.score, two.score)


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "c"), (None, "some text", "c"), (2, "", None), (2, "", None)], "doc_id long, text string, shares string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert Q.quality_scores(docs, labels).count() == 4
    none = Q.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and Q.of_quality(docs, labels.limit(0)).count() == 4
    assert Q.quality_scores(docs.limit(0), labels).collect() == []
