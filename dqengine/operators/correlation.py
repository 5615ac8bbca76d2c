"""Pearson correlation of numeric column pairs (P4, J1, A11) and the top-30
ranking (K2).

Rows with a null or NaN in *any* numeric column are dropped first (listwise
deletion, like ``pandas.dropna``).  One pass over the complete rows adds up, for
each column, rows, shifted sums, least and greatest value, and for each pair the
products of shifted values.  All of these
are plain sums that merge in any order; a column's shift is its mean over the
table, or over some first rows where that is not known yet.  The shift changes no
result: a shift within a few deviations of the true mean keeps the sums stable,
and r is (S_ab - S_a S_b / n) / sqrt(...).

Up to ``NARROW`` columns these sums are one plain aggregate; moving every cell into
Python costs more than adding it up.  Wider tables go
through the matrix products and are cut into tiles of ``TILE`` columns: a task holds
the products of one pair of tiles (8 MB), and each pair of tiles is a scan of its columns.  Pairs
stay distributed rows.

A pair is skipped when either column is constant on the complete rows
(``min == max``) or when r is NaN; fewer than two complete rows give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.keys import NUMERIC, ColumnSpec, positional
from ..functions.scalar import py_round
from ..session import materialize, stage_dir

PAIR_SCHEMA = "dataset STRING, i INT, j INT, col1 STRING, col2 STRING, r DOUBLE"
#: Columns whose products with as many others a task holds.
TILE = 1024
#: Columns up to which the sums are a plain aggregate.
NARROW = 12
#: Complete rows that give the shifts where no means are known.
SHIFT_ROWS = 1000


def complete_rows(df: DataFrame, numeric: list[ColumnSpec]) -> DataFrame:
    """Listwise deletion over the numeric columns (null and NaN)."""
    return positional(df).select(*[s.col.cast("double") for s in numeric]).na.drop(how="any")


def _plain_moments(clean: DataFrame, shifts: np.ndarray) -> DataFrame:
    """``co_moments`` of few columns, added up by Spark."""
    x = [F.col(c) for c in clean.columns]
    y = [c - F.lit(float(at)) for c, at in zip(x, shifts, strict=True)]
    none = F.lit(None).cast("double")
    cells = [(a, -1, F.sum(y[a]), F.min(x[a]), F.max(x[a])) for a in range(len(x))]
    cells += [(a, b, F.sum(y[a] * y[b]), none, none) for a in range(len(x)) for b in range(a, len(x))]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.lit(1)).alias("n"), s.alias("s"), lo.alias("lo"), hi.alias("hi")) for a, b, s, lo, hi in cells]
    return clean.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).where("n > 0")


def co_moments(clean: DataFrame, shifts: np.ndarray, tile: int = TILE) -> DataFrame:
    """(a, b, n, s, lo, hi): for columns a < b the sum of products of their
    shifted values; for a = b the sum of squares; and with b = -1 the rows, shifted
    sum, least and greatest value of column a."""
    k = len(shifts)
    if k <= min(NARROW, tile):
        return _plain_moments(clean, shifts)
    cuts = [(at, min(at + tile, k)) for at in range(0, k, tile)]
    names = clean.columns

    def scan(left: tuple[int, int], right: tuple[int, int]) -> DataFrame:
        own = [*range(*left)] if left == right else [*range(*left), *range(*right)]
        at, width = shifts[own][:, None], left[1] - left[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, sums = np.zeros((width, right[1] - right[0])), 0, np.zeros(width)
            lo, hi = np.full(width, np.inf), np.full(width, -np.inf)
            with np.errstate(invalid="ignore", over="ignore"):
                for batch in batches:
                    x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                    if not x.shape[1]:
                        continue
                    n += x.shape[1]
                    lo, hi = np.minimum(lo, x[:width].min(1)), np.maximum(hi, x[:width].max(1))
                    x = x - at
                    sums += x[:width].sum(1)
                    total += x[:width] @ (x[:width] if left == right else x[width:]).T
            if not n:
                return
            if left == right:
                a, b = np.triu_indices(width)
                ones = np.arange(width)
                a, b = np.append(a, ones), np.append(b + left[0], np.full(width, -1))
                s = np.append(total[a[:-width], b[:-width] - left[0]], sums)
                ends = [np.append(np.full(len(a) - width, np.nan), x) for x in (lo, hi)]
            else:
                a, b = (x.ravel() for x in np.indices(total.shape))
                s, b, ends = total.ravel(), b + right[0], [np.full(total.size, np.nan)] * 2
            yield pa.RecordBatch.from_arrays([pa.array((a + left[0]).astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.full(len(a), n)), pa.array(s),
                                              *map(pa.array, ends)], ["a", "b", "n", "s", "lo", "hi"])

        return clean.select(*[names[i] for i in own]).mapInArrow(run, "a INT, b INT, n LONG, s DOUBLE, lo DOUBLE, hi DOUBLE")

    parts = [scan(x, y) for i, x in enumerate(cuts) for y in cuts[i:]]
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    return reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(*sums)


def _moments(df: DataFrame, specs: list[ColumnSpec], dataset: str, means: dict[int, float] | None) -> tuple[DataFrame, list[ColumnSpec]] | None:
    """Co-moments of one dataset's numeric columns; none where no pair is possible."""
    numeric = [s for s in specs if s.kind == NUMERIC]
    if len(numeric) < 2:
        return None
    clean = complete_rows(df, numeric)
    if means is None:
        some = clean.limit(SHIFT_ROWS).agg(*[F.avg(s.col).alias(s.alias) for s in numeric]).first()
        means = {s.pos: some[s.alias] for s in numeric}
    shifts = np.array([means.get(s.pos) or 0.0 for s in numeric], float)
    shifts[~np.isfinite(shifts)] = 0.0
    return co_moments(clean, shifts).withColumn("dataset", F.lit(dataset)), numeric


def pairs_of(parts: list[tuple[DataFrame, list[ColumnSpec], str]], means: dict[str, dict[int, float]] | None = None) -> DataFrame:
    """(dataset, i, j, col1, col2, r) for every usable pair of every
    (frame, columns, name), r unrounded.  ``means``: per dataset, of its columns
    by place (any close value does)."""
    spark = positional(parts[0][0]).sparkSession
    with ThreadPoolExecutor(max_workers=min(4, len(parts))) as ex:  # the datasets are independent
        found = [(p[2], m) for p, m in zip(parts, ex.map(lambda p: _moments(*p, (means or {}).get(p[2])), parts), strict=True) if m]
    if not found:
        return spark.createDataFrame([], PAIR_SCHEMA)
    # a row per pair, read twice: for the columns' own moments and for the pairs
    sums = materialize(reduce(DataFrame.unionByName, [m[0] for _, m in found]), f"{stage_dir(spark)}/products")
    own: dict[str, dict[int, tuple]] = {}
    for r in sums.where("b = -1 OR a = b").collect():  # two rows a column
        entry = own.setdefault(r.dataset, {}).setdefault(r.a, [0, 0.0, 0.0, 0.0, 0.0])
        if r.b == -1:
            entry[:4] = r.n, r.s, r.lo, r.hi
        else:
            entry[4] = r.s
    columns = []
    for dataset, (_, numeric) in found:
        for a, (n, s, lo, hi, squares) in sorted(own.get(dataset, {}).items()):
            if n < 2 or not lo < hi or not np.isfinite([lo, hi]).all():
                continue
            spec, spare = numeric[a], squares - s * s / n
            if spare > 0 and np.isfinite(spare):
                columns.append((dataset, a, spec.pos, spec.name, s / n, float(np.sqrt(spare))))
    side = spark.createDataFrame(columns, "dataset STRING, a INT, pos INT, name STRING, m DOUBLE, sd DOUBLE")
    left = F.broadcast(side.select("dataset", "a", F.col("sd").alias("sd1"), F.col("m").alias("m1"), F.col("pos").alias("i"), F.col("name").alias("col1")))
    right = F.broadcast(side.select("dataset", F.col("a").alias("b"), F.col("sd").alias("sd2"), F.col("m").alias("m2"), F.col("pos").alias("j"), F.col("name").alias("col2")))
    pairs = sums.where("a < b").join(left, ["dataset", "a"]).join(right, ["dataset", "b"])  # one row a column
    r = F.try_divide(F.col("s") - F.col("n") * F.col("m1") * F.col("m2"), F.col("sd1") * F.col("sd2"))
    return (pairs.select("dataset", "i", "j", "col1", "col2", F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)).alias("r"))
                 .where(F.col("r").isNotNull() & ~F.isnan("r")))


def pair_correlations(df: DataFrame, specs: list[ColumnSpec], dataset: str) -> DataFrame:
    """``pairs_of`` a single dataset."""
    return pairs_of([(df, specs, dataset)])


def top_correlations(pairs: DataFrame, top: int = C.TOP_CORRELATIONS) -> DataFrame:
    """K2: (dataset, rank, i, j, col1, col2, value, left_out) with value
    rounded to 4 places; order |value| desc, then pair order (Python's stable
    sort).  ``left_out`` tells how many of the dataset's pairs rank below."""
    v = py_round(F.col("r"), 4)
    w = Window.partitionBy("dataset").orderBy(F.desc(F.abs("value")), "i", "j")
    ranked = (pairs.withColumn("value", v)
                   .withColumn("rank", F.row_number().over(w))
                   .where(F.col("rank") <= top)
                   .select("dataset", "rank", "i", "j", "col1", "col2", "value"))
    total = pairs.groupBy("dataset").agg(F.count(F.lit(1)).alias("pairs"))
    return ranked.join(F.broadcast(total), "dataset").withColumn("left_out", F.greatest(F.col("pairs") - top, F.lit(0)).cast("long")).drop("pairs")
