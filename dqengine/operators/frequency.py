"""The frequency table: one row per (column, value) with its count.

It is the shared intermediate of the profiler.  Distinct counts (A3), top
values (K1), class counts (A12), exact quantiles (A5) and outlier counts (A6)
are all derived from it without touching the input again.

Plan: columns are grouped one by one, each scan reading its column only, so that a
column of many values does not push those of few out of a task's hash table.  The
map-side partial aggregate collapses hot values before the shuffle, so a value that
holds a third of all rows costs one row per map task, not a third of the shuffle.
Times, dates and booleans are grouped by their own value, and only what is left is
shown as text and grouped by that (times an hour apart may be shown alike).
Long strings travel as ``prefix || sha256`` (functions/keys.py).

Integral columns of many rows and few gaps are counted by blocks of 64 neighbouring
numbers (``block_table``), which is exact for distinct values and leaves little to
shuffle and write; the profiler looks into the blocks it needs.

Numeric values are grouped by their typed value (a long for integral types,
a double for floating ones) rather than by a string rendering: fixed-width
keys hash and compare in the unsafe row format without building a string
per cell, and integral values above 2^53 stay distinct.  Only non-numeric
columns carry a string key (their top values are shown).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import NUMERIC, ColumnSpec, positional, value_key

FREQ_SCHEMA = "pos INT, key STRING, dval DOUBLE, cnt BIGINT"


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
#: Types whose values are of fixed size and longer as text.
_BRIEF = (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _number(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """The values of one numeric column, grouped by their own type."""
    c = spec.col
    if isinstance(spec.dt, _INTEGRAL):
        c = c.cast("long")
    elif isinstance(spec.dt, _FLOATING):
        # + 0.0 folds -0.0 into 0.0 (D16); NaN stays one value
        c = c.cast("double") + F.lit(0.0)
    else:
        c = c.cast("string")  # decimals: exact string key, double for the statistics
    counted = df.select(c.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select(F.lit(spec.pos).alias("pos"), F.lit(None).cast("string").alias("key"), F.col("v").cast("double").alias("dval"), "cnt")


def _text(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """The values of one column that is not numeric, by display key."""
    if isinstance(spec.dt, _BRIEF):
        values = df.select(spec.col.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("cnt"))
        counted = values.groupBy(value_key(F.col("v"), spec.dt).alias("key")).agg(F.sum("cnt").alias("cnt"))
    else:
        counted = df.select(value_key(spec.col, spec.dt).alias("key")).where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select(F.lit(spec.pos).alias("pos"), "key", F.lit(None).cast("double").alias("dval"), "cnt")


def integral(spec: ColumnSpec) -> bool:
    return isinstance(spec.dt, _INTEGRAL)


def block_of(c: Column) -> Column:
    """The number of the 64 neighbouring whole numbers that a whole number is one of."""
    return F.shiftright(c.cast("long"), 6)


def block_table(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """(block, cnt, n_values) of an integral column: how many rows and how many
    different values each block has, the values seen being the bits of a word.  Columns
    without many gaps have up to 64 times fewer blocks than values."""
    c = spec.col.cast("long")
    cells = df.select(block_of(spec.col).alias("block"), F.expr(f"shiftleft(1L, cast({spec.alias} & 63 AS INT))").alias("bit")).where(c.isNotNull())
    found = cells.groupBy("block").agg(F.bit_or("bit").alias("seen"), F.count(F.lit(1)).alias("cnt"))
    return found.select("block", "cnt", F.bit_count("seen").cast("long").alias("n_values"))


def frequency_table(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """(pos, key, dval, cnt) over the non-null values of ``specs``.

    ``dval`` is the value as double for numeric columns (NaN kept, so NaN is
    one distinct value like in the reference), null otherwise; ``key`` is the
    display key of non-numeric values, null for numeric ones.
    """
    df = positional(df)
    if not specs:
        return df.sparkSession.createDataFrame([], FREQ_SCHEMA)
    tables = [_number(df, s) for s in specs if s.kind == NUMERIC]
    tables += [_text(df, s) for s in specs if s.kind != NUMERIC]
    return reduce(DataFrame.unionByName, tables)
