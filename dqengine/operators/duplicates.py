"""Duplicate rows (A8): rows minus distinct rows, nulls equal.

Rows are counted by a 64-bit digest first: 8 bytes a row and a count travel, whatever
the number and width of the columns, and a row that repeats a third of the table is
one row for each map task after the partial count.  Equal digests do not prove
equal rows, so the rows of digests that occur more than once (and only these) are
counted again by their whole keys, long texts by prefix and SHA-256.  Different rows
of one digest (one pair in 6 billion rows, on average) cost that second look, no more.

The repeated digests are broadcast up to ``BROADCAST_DIGESTS`` of them (their
number is known then).  Beyond, rows pass a filter of fixed size first (``WORDS`` words,
three bits for each repeated digest, broadcast), which loses no repeated row, and
what it lets through is joined by a shuffle on the digest (an inner join, as each digest
stands once: the optimizer would push a semi join below the filter, and all rows would
be shuffled).

Rows that differ in one column differ.  A dataset with an integral column that base
statistics say may be a key (no nulls, a range with room for all rows and not many more) is
asked for that column's distinct values first, by blocks of 64 numbers: where there
are as many as rows, no row is hashed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import ColumnSpec, positional, row_key
from ..session import materialize, stage_dir
from .frequency import block_table

#: Of 8 bytes each.
BROADCAST_DIGESTS = 500_000
#: Of 64 bits each.
WORDS = 1 << 19
_SLOT = f"pmod(d1, {WORDS}L)"  # the low bits; the word's bits come from others
_BITS = " | ".join(f"shiftleft(1L, cast(shiftright(d1, {at}) & 63 AS INT))" for at in (24, 36, 48))


def _keys(kept: list[ColumnSpec]) -> list[Column]:
    zero = F.lit(0.0)  # folds -0.0 into 0.0, as grouping does
    return [(row_key(s.col, s.dt) + zero.cast(s.dt) if isinstance(s.dt, (T.FloatType, T.DoubleType)) else row_key(s.col, s.dt)).alias(f"k{s.pos}")
            for s in kept]


def row_digest(keys: list[Column]) -> Column:
    """A 64-bit hash of a row; hashes skip nulls, so which keys are null is hashed too."""
    masks = [reduce(Column.bitwiseOR, [F.when(k.isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys[at:at + 30])])
             for at in range(0, len(keys), 30)]
    return F.xxhash64(*masks, *keys)


def _digest(digest, keys: list[Column]) -> Column:
    found = digest(keys)
    return F.xxhash64(*found) if isinstance(found, tuple) else found


def _told_apart(work: list[tuple[DataFrame, list[ColumnSpec], str]], keys: dict[str, tuple[ColumnSpec, int]]) -> set[str]:
    """The datasets whose rows one column tells apart: it has as many values as they have rows."""
    tables = [block_table(df, keys[name][0]).agg(F.sum("n_values").alias("n")).select(F.lit(name).alias("dataset"), "n") for df, _, name in work if name in keys]
    if not tables:
        return set()
    return {r.dataset for r in reduce(DataFrame.unionByName, tables).collect() if r.n == keys[r.dataset][1]}


def duplicates_of(parts: list[tuple[DataFrame, list[ColumnSpec], str]], digest=row_digest, keys: dict[str, tuple[ColumnSpec, int]] | None = None) -> DataFrame:
    """(dataset, duplicate_rows) for every (frame, kept columns, name).

    A dataset without columns has none (D12).  ``keys``: by dataset, a kept integral column
    without nulls that may have no value twice, and the number of rows."""
    spark = positional(parts[0][0]).sparkSession
    work = [(positional(df), kept, name) for df, kept, name in parts if kept]
    found = dict.fromkeys((name for _, _, name in parts), 0)
    apart = _told_apart(work, keys or {})
    work = [w for w in work if w[2] not in apart]
    if work:
        marked = []
        for i, (df, kept, _) in enumerate(work):
            marked.append(df.select(F.lit(i).alias("dataset"), _digest(digest, _keys(kept)).alias("d1")))
        counted = reduce(DataFrame.unionByName, marked).groupBy("dataset", "d1").agg(F.count(F.lit(1)).alias("n"))
        again = materialize(counted.where("n > 1").select("dataset", "d1"), f"{stage_dir(spark)}/again")
        repeated = {r.dataset: r.digests for r in again.groupBy("dataset").agg(F.count(F.lit(1)).alias("digests")).collect()}
        exact = []
        for i, (df, kept, name) in enumerate(work):
            if i not in repeated:
                continue
            keys = _keys(kept)
            own = again.where(F.col("dataset") == i).select("d1")
            rows = df.select(*keys, _digest(digest, keys).alias("d1"))
            if repeated[i] <= BROADCAST_DIGESTS:
                own = F.broadcast(own)
            else:
                words = own.groupBy(F.expr(_SLOT).alias("slot")).agg(F.bit_or(F.expr(_BITS)).alias("word"))
                rows = rows.withColumn("slot", F.expr(_SLOT)).join(F.broadcast(words), "slot").where(f"(word & ({_BITS})) = ({_BITS})")
                own = own.hint("merge")
            rows = rows.join(own, "d1")  # a digest stands once there
            exact.append(rows.groupBy(*[f"k{s.pos}" for s in kept]).count().agg(F.sum(F.col("count") - 1).alias("n")).select(F.lit(name).alias("dataset"), "n"))
        if exact:
            found |= {r.dataset: r.n or 0 for r in reduce(DataFrame.unionByName, exact).collect()}
    return spark.createDataFrame(list(found.items()), "dataset STRING, duplicate_rows BIGINT")


def duplicate_rows(df: DataFrame, kept: list[ColumnSpec], dataset: str) -> DataFrame:
    """``duplicates_of`` a single dataset: one row."""
    return duplicates_of([(df, kept, dataset)])
