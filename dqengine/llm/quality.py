"""Operator 5: quality classifier by positive-unlabelled learning.

Only trusted positives (label 1) and unlabelled text are used, no negatives.
With squared loss l(g, y) = (1 - y g)^2 / 4 and class prior pi, the
non-negative unbiased risk

    R(g) = pi E_p[l(g, +1)] + max(0, E_u[l(g, -1)] - pi E_p[l(g, -1)])

of a function linear in its features needs nothing but the first and second
moments of the features under positives and under unlabelled text.  They are
sums, so one distributed pass over *all* rows gives them; the solver then works
on two small matrices.  Where the max is not active, ``g = 2 pi r - 1`` with
r the least-squares estimate of the density ratio p/u, and the score
``(1 + g) / 2 = pi r`` estimates the probability of label 1.

The class prior is estimated from the same data: where text is surely
positive, unlabelled text is as dense as pi times the positives, so pi is the
ratio of their shares in the region that holds the top 95 % of positives.

Features are shares in the text (symbols, capitals, repeated words and lines,
...) cut at fixed thresholds: an additive model of steps.  Language, source,
key and labels are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, schema_of, staged, text_rows
from .simhash import word_blocks

FEATURES = ("symbols", "exclamations", "bars", "capitals", "digits", "repeats", "sameness", "long_words", "short_words", "line_repeats", "control", "no_words")
CUTS = (0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4)
#: Ridge penalty on the weights.
RIDGE = 1e-3
_CLASS = np.zeros((256, 7), np.int64)
_CLASS[[ord(c) for c in "#*$%&<>^~\\{}[]@_="], 0] = 1
_CLASS[ord("!"), 1] = 1
_CLASS[ord("|"), 2] = 1
_CLASS[65:91, 3] = 1
_CLASS[48:58, 4] = 1
_CLASS[[*range(9), *range(14, 32), 127], 5] = 1
_CLASS[[*range(65, 91), *range(97, 123)], 6] = 1


def features(text: str | None) -> list[float]:
    """Shares of a whole text, each from 0 to 1, in the order of FEATURES."""
    raw = (text or "").encode()
    n = same = long = short = 0
    distinct: set[bytes] = set()
    previous = None
    for words in word_blocks(raw, 0):
        n += len(words)
        distinct.update(words)
        same += sum(map(bytes.__eq__, words, words[1:])) + (bool(words) and words[0] == previous)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        long += int((sizes > 12).sum())
        short += int((sizes < 2).sum())
        previous = words[-1] if words else previous
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols, exclamations, bars, capitals, digits, control, letters = (counts @ _CLASS).tolist()
    lines = [x for x in raw.split(b"\n") if x]
    return [symbols / len(raw), exclamations / len(raw), bars / len(raw), capitals / max(letters, 1), digits / len(raw), same / n,
            1 - np.log1p(len(distinct)) / np.log1p(n), long / n, short / n, 1 - len(set(lines)) / max(len(lines), 1), control / len(raw), 0.0]


def _steps(shares: np.ndarray) -> np.ndarray:
    """Shares (rows x features) -> a constant and 0/1 steps."""
    steps = (shares[:, :, None] > np.array(CUTS)).reshape(len(shares), -1)
    return np.concatenate([np.ones((len(shares), 1)), steps], axis=1)


def text_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, shares) of every row; no shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    schema, arrow = schema_of(f"k {kind}, shares array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([features(t) for t in b.column("text").to_pylist()], arrow.field("shares").type)], schema=arrow)

    rows = text_rows(docs, F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def moments(shares: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean and second moment of the steps.  Tasks send partial sums;
    what comes to the driver depends on the number of features alone."""
    schema, arrow = schema_of("i int, j int, s double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in arrow_rows(batches, 8192):
            x = _steps(np.array(b.column("shares").to_pylist(), float).reshape(b.num_rows, len(FEATURES)))
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], schema=arrow)

    sums = shares.select("shares").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    d = 1 + len(FEATURES) * len(CUTS)
    m = np.zeros((d, d))
    m[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("s").to_numpy()
    n = m[0, 0]
    return n, m[0] / max(n, 1), m / max(n, 1)


def solve(prior: float, mean_p: np.ndarray, second_p: np.ndarray, mean_u: np.ndarray, second_u: np.ndarray) -> np.ndarray:
    """Weights of the least non-negative risk for given moments.

    The risk is the larger of two convex quadratics, with the part under the
    max and without it; its minimiser is that of a mixture of the two whose
    share ``t`` is 1, 0 or makes them equal.
    """
    ridge = RIDGE * np.eye(len(mean_p))

    def least(t: float) -> np.ndarray:
        hessian = t * second_u / 2 + (1 - t) * prior * second_p / 2 + ridge
        return np.linalg.solve(hessian, t * (prior * mean_p - mean_u / 2) + (1 - t) * prior * mean_p / 2)

    def negative(w: np.ndarray) -> float:
        risk = lambda m, s: (1 + 2 * m @ w + w @ s @ w) / 4  # noqa: E731  E[l(g, -1)]
        return risk(mean_u, second_u) - prior * risk(mean_p, second_p)

    if negative(least(1.0)) >= 0:
        return least(1.0)
    low, high = 0.0, 1.0
    for _ in range(50):
        t = (low + high) / 2
        low, high = (t, high) if negative(least(t)) > 0 else (low, t)
    return least(low)


def _score(weights: np.ndarray, shares: Column) -> Column:
    """(1 + g) / 2 from 0 to 1, as JVM arithmetic over the shares."""
    g = F.lit(float(weights[0]))
    for f in range(len(FEATURES)):
        steps = [float(w) for w in np.cumsum(weights[1 + f * len(CUTS):1 + (f + 1) * len(CUTS)])]
        at = shares[f]
        step = F.lit(0.0)
        for cut, w in zip(CUTS, steps, strict=True):
            step = F.when(at > cut, F.lit(w)).otherwise(step)
        g = g + step
    return F.least(F.greatest((1 + g) / 2, F.lit(0.0)), F.lit(1.0))


def scores(weights: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The same of rows of shares in a task, added in the same order."""
    g = np.full(len(shares), float(weights[0]))
    for f in range(len(FEATURES)):
        steps = np.concatenate([[0.0], np.cumsum(weights[1 + f * len(CUTS):1 + (f + 1) * len(CUTS)])])
        g = g + steps[(shares[:, f, None] > np.array(CUTS)).sum(axis=1)]
    return np.clip((1 + g) / 2, 0.0, 1.0)


def held_out(key: Column) -> Column:
    """Whether labels of this row may not be learnt from; not for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(shares: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> tuple[np.ndarray, float]:
    """(weights, class prior) from (k, shares) of all texts and a label table.

    Rows that are held out are neither positives nor unlabelled text here.
    Labels other than 1, null ones and null keys are passed over.  Without any
    positive the weights are zero: every score is 0.5, nothing is rejected.
    """
    own = shares.where(~held_out(F.col("k")))
    sure = labels.where((F.col(f"`{label}`") == 1) & ~held_out(F.col(f"`{key}`"))).select(F.col(f"`{key}`").alias("k")).distinct()
    positive = staged(own.join(sure, "k", "left_semi"))
    n_p, mean_p, second_p = moments(positive)
    n_u, mean_u, second_u = moments(own)
    if not n_p or not n_u:
        return np.zeros_like(mean_p), 0.5
    ratio = np.linalg.solve(second_u + 2 * RIDGE * np.eye(len(mean_u)), mean_p)  # density ratio p/u
    at = _score(2 * ratio / 10, F.col("shares"))  # any rising function of it ranks alike
    edge = positive.select(F.percentile_approx(at, F.lit(0.05), F.lit(10000))).first()[0]
    share = lambda rows: rows.select(F.avg((at >= edge).cast("double"))).first()[0]
    prior = float(min(max(share(own) / share(positive), 0.01), 0.99))
    return solve(prior, mean_p, second_p, mean_u, second_u), prior


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``held_out``, ``score``,
    ``predicted`` (1 from 0.5 on).

    A null or empty text is scored like a text without words; a null key is
    not held out; repeated rows give repeated results; an empty table an empty
    one; other columns are never read.
    """
    shares = staged(text_features(docs, key, text))
    weights, _ = fit(shares, labels, key, label)
    out = shares.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), _score(weights, F.col("shares")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def of_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they
    were: texts are scored where they lie, nothing is joined or shuffled."""
    weights, _ = fit(staged(text_features(docs, key, text)), labels, key, label)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = text_rows(docs.toDF(*names), F.col(names[docs.columns.index(text)]).cast("string").alias("text"), *names)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            good = scores(weights, np.array([features(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(FEATURES))) >= 0.5
            yield b.select(names).filter(pa.array(good))

    return rows.mapInArrow(keep, rows.select(*names).schema).toDF(*docs.columns)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    from ..sources.tables import read_table
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
