"""Exact linear-interpolation quantiles (A5) by radix selection.

The bits of a double, with the lower ones of negative numbers turned over, order
like the numbers themselves.  The values at given ranks are found from the first
bits on: one pass counts, for every column, how many values begin with which
bits; the bin that holds a rank is known then, and the next pass looks at its
values only, at their next bits.  Bins also carry their least and greatest value:
where these are equal the rank is found, so columns of few values end after one
or two passes and any column after at most 64 bits.  Where a column's least and
greatest value are known, the bits that both begin with are known before the first
pass (for most columns the sign and most of the exponent).

Nothing is sorted, written or shuffled but histograms: a task sends the bins it
has seen, at most ``2 ** bits`` for each wanted prefix.  ``bits`` is chosen so
that a task's counters stay within ``COUNTER_BYTES`` whatever the number of
columns (wide tables take more passes of fewer bits).

Counted values whose ends are known are looked at in bins of equal width first, in
plain SQL: each round cuts the stretch that holds a rank into ``WIDTHS`` bins and goes
on with the least and greatest value of its bin.  A column that is not done after
``ROUNDS`` rounds (values of very different size) is left to the bits.  The driver sees four rows
a column and pass: the bins that hold the ranks floor(h) and floor(h) + 1,
h = (n - 1) p, of the two quartiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNTER_BYTES = 64 << 20
MOST_BITS = 16
#: Bins of equal width in a stretch, and rounds of them.
WIDTHS = 4096
ROUNDS = 3
_TOP = np.uint64(1 << 63)
BINS = "column INT, prefix INT, bin INT, n LONG, lo LONG, hi LONG"


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers that order like the doubles ``x`` (no NaN); both zeros
    are one value."""
    b = (x + 0.0).view(np.uint64)
    return np.where(b >= _TOP, ~b, b | _TOP)


def value_of(u: int) -> float:
    """The double that ``ordered`` turned into ``u``."""
    b = u ^ (1 << 63) if u >> 63 else ~u & ((1 << 64) - 1)
    return float(np.array([b], np.uint64).view(np.float64)[0])


@dataclass(frozen=True)
class Rank:
    """The value of rank ``rank`` among those of column ``column`` whose first
    bits are ``prefix``."""
    column: int
    prefix: int
    rank: int


def common_bits(low: float, high: float) -> tuple[int, int]:
    """(number, value) of the first bits that ``ordered`` gives all of [low, high]."""
    a, b = (int(x) for x in ordered(np.array([low, high], float)))
    known = 64 - (a ^ b).bit_length()
    return known, a >> (64 - known)


def _bins(counters: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """What a task has counted, without empty bins."""
    for (i, k), (n, lo, hi) in counters.items():
        at = np.flatnonzero(n)
        ends = [pa.array((x[at] ^ _TOP).view(np.int64)) for x in (lo, hi)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(np.full(len(at), k, np.int32)),
                                          pa.array(at.astype(np.int32)), pa.array(n[at]), *ends], ["column", "prefix", "bin", "n", "lo", "hi"])


def _histogram(df: DataFrame, columns: list[tuple[int, str]], wanted: dict[int, list[int]], known: dict[int, int], bits: int) -> DataFrame:
    """(column, prefix, bin, n, lo, hi) of the columns (number, name) of one frame;
    prefixes of column i have ``known[i]`` bits."""
    columns = [(i, name) for i, name in columns if i in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for (i, _), column in zip(columns, batch.columns, strict=True):
                x = column.to_numpy(zero_copy_only=False).astype(np.float64)
                u = ordered(x[~np.isnan(x)])
                step = min(bits, 64 - known[i])
                size, low = 1 << step, np.uint64(64 - known[i] - step)
                for k, prefix in enumerate(wanted[i]):
                    own = u[u >> np.uint64(64 - known[i]) == np.uint64(prefix)] if known[i] else u
                    if not len(own):
                        continue
                    if (i, k) not in counters:
                        counters[i, k] = np.zeros(size, np.int64), np.full(size, 2**64 - 1, np.uint64), np.zeros(size, np.uint64)
                    n, lo, hi = counters[i, k]
                    at = (own >> low & np.uint64(size - 1)).astype(np.int64)
                    n += np.bincount(at, minlength=size)
                    np.minimum.at(lo, at, own)
                    np.maximum.at(hi, at, own)
        yield from _bins(counters)

    cells = df.select(*[F.col(name).cast("double") for _, name in columns])
    return cells.mapInArrow(run, BINS)


def _counted_histogram(table: DataFrame, wanted: dict[int, list[int]], known: dict[int, int], bits: int, within: dict[int, tuple[float, float]]) -> DataFrame:
    """``_histogram`` of a table (column, value, cnt).  ``within``: the least and
    greatest value that is still looked at, by column; the others stay in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            of, x, cnt = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for i in np.unique(of).tolist():
                here = of == i
                u, times = ordered(x[here]), cnt[here]
                step = min(bits, 64 - known[i])
                size, low = 1 << step, np.uint64(64 - known[i] - step)
                for k, prefix in enumerate(wanted[i]):
                    inside = u >> np.uint64(64 - known[i]) == np.uint64(prefix) if known[i] else np.ones(len(u), bool)
                    own = u[inside]
                    if not len(own):
                        continue
                    if (i, k) not in counters:
                        counters[i, k] = np.zeros(size, np.int64), np.full(size, 2**64 - 1, np.uint64), np.zeros(size, np.uint64)
                    n, lo, hi = counters[i, k]
                    at = (own >> low & np.uint64(size - 1)).astype(np.int64)
                    np.add.at(n, at, times[inside])
                    np.minimum.at(lo, at, own)
                    np.maximum.at(hi, at, own)
        yield from _bins(counters)

    near = reduce(lambda a, b: a | b, [(F.col("column") == i) & (F.col("value").between(*within[i]) if i in within else F.lit(True)) for i in wanted])
    cells = table.select(F.col("column").cast("int"), "value", "cnt").where(F.col("value").isNotNull() & ~F.isnan("value") & near)
    return cells.mapInArrow(run, BINS)


def _by_width(counted: DataFrame, ranks: dict[int, list[int]], ends: dict[int, tuple[float, float]]) -> dict[tuple[int, int], float]:
    """(column, rank) -> value of the columns that rounds of equal widths settle.

    A bin's number never falls while the value rises (each step of its formula keeps
    the order of doubles), so the bins of a stretch are in the order of its values."""
    spark = counted.sparkSession
    stretches = {c: (float(ends[c][0]), float(ends[c][1])) for c in ranks if c in ends}
    found = {(c, r): low + 0.0 for c, (low, high) in stretches.items() if low == high for r in ranks[c]}
    # (column, first rank) -> stretch that holds it, rank there
    open_ = {(c, r): (low, high, r) for c, (low, high) in stretches.items() if low != high for r in ranks[c]}
    for _ in range(ROUNDS):
        # halves, so that no difference is beyond the greatest double
        open_ = {k: v for k, v in open_.items() if math.isfinite(v[0]) and math.isfinite(v[1]) and v[1] / 2 - v[0] / 2 > 0}
        if not open_:
            break
        places = sorted({(c, low, high) for (c, _), (low, high, _) in open_.items()})
        number = {p: i for i, p in enumerate(places)}
        sides = spark.createDataFrame([(c, i, low, high, high / 2 - low / 2) for (c, low, high), i in number.items()],
                                      "column INT, stretch INT, low DOUBLE, high DOUBLE, width DOUBLE")
        share = (F.col("value") / 2 - F.col("low") / 2) / F.col("width") * WIDTHS
        # a few stretches a column
        cells = counted.join(F.broadcast(sides), "column").where(F.col("value").between(F.col("low"), F.col("high")))
        bins = cells.groupBy("stretch", F.least(share, F.lit(WIDTHS - 1.0)).cast("int").alias("bin")).agg(
            F.sum("cnt").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("stretch").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        asked = spark.createDataFrame([(number[c, low, high], c, first, r) for (c, first), (low, high, r) in open_.items()],
                                      "stretch INT, column INT, first LONG, rank LONG")
        hits = (bins.withColumn("upto", upto).join(F.broadcast(asked), "stretch")  # a few ranks a column
                    .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).collect())
        found |= {(h.column, h.first): h.lo for h in hits if h.lo == h.hi}
        open_ = {(h.column, h.first): (h.lo, h.hi, h.rank - (h.upto - h.n)) for h in hits if h.lo != h.hi}
    return found


def values_at(frames: list[tuple[DataFrame, list[tuple[int, str]]]], ranks: dict[int, list[int]], bits: int | None = None,
              ends: dict[int, tuple[float, float]] | None = None, counted: DataFrame | None = None) -> dict[tuple[int, int], float]:
    """(column, rank) -> value, ranks from 0 among the non-null, non-NaN values.

    ``frames`` are tables with the numbers and names of their columns; a number
    stands for one column of one table.  A null, NaN, or empty column has no
    ranks to ask for.  ``ends``: the least and greatest value of columns, as far
    as they are known.  ``counted``: instead of frames, a table (column, value, cnt)
    of values and how often they occur."""
    spark = (counted if counted is not None else frames[0][0]).sparkSession
    within: dict[int, tuple[float, float]] = {}
    found: dict[tuple[int, int], float] = {}
    open_: dict[Rank, int] = {}  # -> the rank first asked for
    known: dict[int, int] = {}
    if counted is not None:
        settled = _by_width(counted, ranks, ends or {})
        found |= settled
        ranks = {c: rs for c, rs in ranks.items() if any((c, r) not in settled for r in rs)}
    for c, rs in ranks.items():
        low, high = (ends or {}).get(c, (-math.inf, math.inf))
        known[c], prefix = common_bits(low, high)
        if known[c] == 64:
            found |= {(c, r): low + 0.0 for r in rs}
        else:
            open_ |= {Rank(c, prefix, r): r for r in rs}
    while open_:
        wanted: dict[int, list[int]] = {}
        for r in sorted(open_, key=lambda r: (r.column, r.prefix)):
            if r.prefix not in wanted.setdefault(r.column, []):
                wanted[r.column].append(r.prefix)
        counters = sum(map(len, wanted.values()))
        step = bits or max(6, min(MOST_BITS, int(math.log2(COUNTER_BYTES / 24 / counters))))
        bins = _counted_histogram(counted, wanted, known, step, within) if counted is not None else reduce(DataFrame.unionByName, [_histogram(df, cs, wanted, known, step) for df, cs in frames if any(i in wanted for i, _ in cs)])
        bins = bins.groupBy("column", "prefix", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("column", "prefix").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        asked = spark.createDataFrame([(r.column, wanted[r.column].index(r.prefix), r.rank) for r in open_], "column INT, prefix INT, rank LONG")
        hits = (bins.withColumn("upto", upto).join(F.broadcast(asked), ["column", "prefix"])  # a few ranks a column
                    .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).collect())
        following: dict[Rank, int] = {}
        within = {}
        for h in hits:
            prefix = wanted[h.column][h.prefix]
            first = open_[Rank(h.column, prefix, h.rank)]
            if h.lo == h.hi:
                found[h.column, first] = value_of(h.lo + (1 << 63))
            else:
                low, high = value_of(h.lo + (1 << 63)), value_of(h.hi + (1 << 63))
                was = within.get(h.column, (low, high))
                within[h.column] = min(low, was[0]), max(high, was[1])
                taken = min(step, 64 - known[h.column])
                following[Rank(h.column, prefix << taken | h.bin, h.rank - (h.upto - h.n))] = first
        known = {c: min(64, k + step) for c, k in known.items()}
        open_ = following
    return found


def quantiles(frames: list[tuple[DataFrame, list[tuple[int, str]]]], counts: dict[int, int], probs: tuple[float, ...] = (0.25, 0.75),
              bits: int | None = None, ends: dict[int, tuple[float, float]] | None = None, counted: DataFrame | None = None,
              refine: Callable[[dict[tuple[int, int], float]], dict[tuple[int, int], float]] | None = None) -> dict[int, tuple[float, ...]]:
    """column -> its quantiles, interpolated like ``numpy.percentile``.
    ``counts`` are the numbers of non-null, non-NaN values; columns of none are
    left out.  ``ends`` and ``counted`` as for ``values_at``; ``refine`` turns what that
    finds into values where ``counted`` has something coarser."""
    places: dict[int, list[tuple[int, int, float]]] = {}
    for c, n in counts.items():
        if n > 0:
            for p in probs:
                h = (n - 1) * p
                lo = math.floor(h)
                places.setdefault(c, []).append((lo, min(lo + 1, n - 1), h - lo))
    if not places:
        return {}
    at = values_at(frames, {c: sorted({r for a, b, _ in e for r in (a, b)}) for c, e in places.items()}, bits, ends, counted)
    if refine:
        at = refine(at)

    def between(a: float, b: float, t: float) -> float:
        # numpy's lerp: a + (b-a)t below t = 0.5, b - (b-a)(1-t) from 0.5 up
        return b - (b - a) * (1.0 - t) if t >= 0.5 else a + (b - a) * t

    return {c: tuple(between(at[c, a], at[c, b], t) for a, b, t in e) for c, e in places.items()}
