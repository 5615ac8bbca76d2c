"""Per-column profiles: shape (A1), nulls (A2), distinct (A3), moments (A4),
quantiles and IQR outliers (A5, A6, P5, J6), top values (K1), missingness
pruning (P1) and the overall missing cells (A9).

Work split:

* one wide aggregate over the input (row count, null counts, NaN counts and
  moments of every numeric column), collected: the drop decision of P1 changes
  which columns later steps read;
* numeric columns: the frequency table, grouped column by column and written once,
  gives distinct values, quartiles by radix selection (``quantiles``) and what
  lies beyond the fences; whole numbers of many rows in a range not much wider
  are counted by blocks of 64 numbers, and only the few blocks that hold a rank
  are read again;
* other columns: the frequency table, written once, gives class counts and top
  values.

The driver collects a fixed number of values for each column; texts longer than a
key's head never pass through it.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.keys import (NUMERIC, ColumnSpec, Placed, display_value,
                              positional, specs_of, value_key)
from ..functions.scalar import py_round
from ..session import materialize, stage_dir
from .frequency import block_of, block_table, frequency_table, integral
from .quantiles import quantiles

META_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("dtype", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("total_rows", T.LongType(), False),
    T.StructField("null_count", T.LongType(), False),
    T.StructField("nan_count", T.LongType(), False),
    T.StructField("missing_ratio", T.DoubleType(), False),
    T.StructField("missing_pct", T.DoubleType(), False),
    T.StructField("kept", T.BooleanType(), False),
    T.StructField("mean_raw", T.DoubleType(), True),
    T.StructField("std_raw", T.DoubleType(), True),
    T.StructField("min_raw", T.DoubleType(), True),
    T.StructField("max_raw", T.DoubleType(), True),
])


def _py_round(x: float, k: int) -> float:
    return round(x, k)


@dataclass
class BaseStats:
    """Result of the single wide aggregate for one dataset."""
    dataset: str
    total_rows: int
    specs: list[ColumnSpec]
    null_count: dict[int, int]
    nan_count: dict[int, int]
    moments: dict[int, tuple]
    meta: DataFrame = field(repr=False)

    @property
    def kept(self) -> list[ColumnSpec]:
        return [s for s in self.specs if not self.dropped_ratio(s)]

    @property
    def dropped(self) -> list[tuple[ColumnSpec, float]]:
        return [(s, self.ratio(s)) for s in self.specs if self.dropped_ratio(s)]

    def ratio(self, s: ColumnSpec) -> float:
        return self.null_count[s.pos] / self.total_rows if self.total_rows > 0 else 0.0

    def dropped_ratio(self, s: ColumnSpec) -> bool:
        return self.ratio(s) > C.MISSING_DROP_THRESH

    def missing_pct(self, s: ColumnSpec) -> float:
        return _py_round(self.null_count[s.pos] / self.total_rows * 100, 2) if self.total_rows > 0 else 0.0

    @property
    def means(self) -> dict[int, float]:
        """Means of the numeric columns by place."""
        return {pos: m[0] for pos, m in self.moments.items() if m[0] is not None}

    def raw_moments(self, s: ColumnSpec) -> list[float | None]:
        """Mean, deviation, least and greatest value of a numeric column."""
        return [None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x) for x in self.moments.get(s.pos, (None,) * 4)]

    @property
    def likely_key(self) -> ColumnSpec | None:
        """An integral column that may have a value of its own in every row: no nulls, and a
        range with room for all rows and at most ``BLOCK_SAVES`` times as many; the narrowest."""
        found = []
        for s in self.specs:
            low, high = self.raw_moments(s)[2:]
            if integral(s) and not self.null_count[s.pos] and None not in (low, high) and max(-low, high) < _WHOLE and self.total_rows <= high - low + 1 <= BLOCK_SAVES * self.total_rows:
                found.append((high - low, s.pos))
        return self.specs[min(found)[1]] if found else None

    @property
    def missing_cells(self) -> int:
        """A9, the reference's formula: truncated sum over *rounded* pcts."""
        return int(sum(self.missing_pct(s) / 100 * self.total_rows for s in self.kept))

    @property
    def missing_cells_exact(self) -> int:
        return sum(self.null_count[s.pos] for s in self.kept)

    @property
    def overall_missing_pct(self) -> float:
        cells = self.total_rows * len(self.kept)
        return _py_round(self.missing_cells / cells * 100, 2) if cells > 0 else 0.0


def base_stats(df: DataFrame | Placed, dataset: str, schema: T.StructType | None = None) -> BaseStats:
    """Job 1: one pass, one row.  ``schema`` has the names of a placed frame."""
    specs = specs_of(schema or df.schema)
    df = positional(df)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for s in specs:
        c = s.col
        aggs.append(F.count_if(c.isNull()).alias(f"n{s.pos}"))
        if s.kind == NUMERIC:
            is_float = isinstance(s.dt, (T.FloatType, T.DoubleType))
            v = c.cast("double")
            if is_float:
                aggs.append(F.count_if(F.isnan(c)).alias(f"nan{s.pos}"))
                v = F.when(~F.isnan(c), v)
            aggs += [F.avg(v).alias(f"avg{s.pos}"), F.stddev_pop(v).alias(f"std{s.pos}"),
                     F.min(v).alias(f"min{s.pos}"), F.max(v).alias(f"max{s.pos}")]
    row = df.agg(*aggs).collect()[0].asDict()
    total = int(row["__rows"])
    nulls = {s.pos: int(row[f"n{s.pos}"]) for s in specs}
    nans = {s.pos: int(row.get(f"nan{s.pos}") or 0) for s in specs}
    moments = {s.pos: (row[f"avg{s.pos}"], row[f"std{s.pos}"], row[f"min{s.pos}"], row[f"max{s.pos}"])
               for s in specs if s.kind == NUMERIC}
    rows = []
    stats = BaseStats(dataset, total, specs, nulls, nans, moments, None)
    for s in specs:
        ratio = nulls[s.pos] / total if total > 0 else 0.0
        mp = _py_round(nulls[s.pos] / total * 100, 2) if total > 0 else 0.0
        rows.append((dataset, s.pos, s.name, s.dtype, s.kind, total, nulls[s.pos], nans[s.pos],
                     float(ratio), float(mp), not ratio > C.MISSING_DROP_THRESH,
                     *stats.raw_moments(s)))
    stats.meta = df.sparkSession.createDataFrame(rows, META_SCHEMA)
    return stats


KEYS = ("dataset", "pos")
#: Values from which an integral column may be counted by blocks, and how many times
#: fewer blocks than values its range must have.
BLOCK_VALUES = 1 << 20
BLOCK_SAVES = 8
#: Whole numbers below are doubles.
_WHOLE = 1 << 53


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


COLUMNS_SCHEMA = (
    "dataset STRING, pos INT, name STRING, dtype STRING, kind STRING, total_rows BIGINT, null_count BIGINT, nan_count BIGINT, "
    "missing_pct DOUBLE, unique_count BIGINT, mean DOUBLE, std DOUBLE, min DOUBLE, max DOUBLE, outlier_pct DOUBLE, outlier_count BIGINT, "
    "top_values ARRAY<STRUCT<value: STRING, count: BIGINT>>, mean_raw DOUBLE, std_raw DOUBLE, min_raw DOUBLE, max_raw DOUBLE, "
    "q1 DOUBLE, q3 DOUBLE, n_valid BIGINT, max_class_count BIGINT, min_class_count BIGINT, n_values BIGINT")


@dataclass
class TopKeys:
    """The keys of the k most frequent values of one column, in part: (count,
    key) of those that are certain, and how many more are wanted of one group of
    equal count and equal beginning."""
    keys: list[tuple[int, str]]
    edge: tuple[int, str] | None = None
    wanted: int = 0


class ColumnProfiler:
    """Column statistics of any number of datasets, each step in one plan:
    every table is keyed by (dataset, pos), so 15 small tables cost no more
    jobs than one large table."""

    def __init__(self, parts: list[tuple[DataFrame, BaseStats]]):
        self.parts = [(positional(df), st) for df, st in parts]
        self.spark = self.parts[0][0].sparkSession
        self._freq: DataFrame | None = None
        self._numbers: DataFrame | None = None

    def _specs(self, numeric: bool) -> list[tuple[DataFrame, BaseStats, list[ColumnSpec]]]:
        found = [(df, st, [s for s in st.kept if (s.kind == NUMERIC) == numeric]) for df, st in self.parts]
        return [x for x in found if x[2]]

    # -- numeric columns: A3, A5, A6 ----------------------------------------
    @property
    def numbers(self) -> DataFrame:
        """(column, value, cnt, n_values) of the numeric columns, numbered through all
        datasets; written once.  Distinct values, quartiles and outliers come from
        it, so the input is not read again and a value that repeats is one row.  Of
        columns in blocks, ``value`` is the block."""
        if self._numbers is None:
            tables = []
            for at, df, st, specs in self._numbered():
                blocks = [s for s in specs if self._in_blocks(st, s)]
                if single := [s for s in specs if s not in blocks]:
                    tables.append(frequency_table(Placed(df), single).select((F.col("pos") + F.lit(at)).alias("column"), F.col("dval").alias("value"), "cnt", F.lit(1).cast("long").alias("n_values")))
                tables += [block_table(df, s).select(F.lit(at + s.pos).alias("column"), F.col("block").cast("double").alias("value"), "cnt", "n_values") for s in blocks]
            self._numbers = materialize(_union(tables), f"{stage_dir(self.spark)}/numbers")
        return self._numbers

    @staticmethod
    def _in_blocks(st: BaseStats, s: ColumnSpec) -> bool:
        """Whether a column's range has far fewer blocks than the column has values
        (known from the base statistics)."""
        low, high = st.raw_moments(s)[2:]
        n = st.total_rows - st.null_count[s.pos]
        return integral(s) and n >= BLOCK_VALUES and None not in (low, high) and max(-low, high) < _WHOLE and (high - low) / 64 * BLOCK_SAVES <= n

    def _numbered(self) -> list[tuple[int, DataFrame, BaseStats, list[ColumnSpec]]]:
        """The datasets that have numeric columns, each with the number of its first place."""
        found, at = [], 0
        for df, st, specs in self._specs(True):
            found.append((at, df, st, specs))
            at += len(st.specs)
        return found

    def _places(self) -> dict[int, tuple[BaseStats, ColumnSpec]]:
        return {at + s.pos: (st, s) for at, _, st, specs in self._numbered() for s in specs}

    def numeric_distinct(self) -> dict[tuple[str, int], int]:
        """Distinct non-null values of numeric columns."""
        places = self._places()
        if not places:
            return {}
        found = self.numbers.groupBy("column").agg(F.sum("n_values").alias("n")).collect()
        return {(places[r.column][0].dataset, places[r.column][1].pos): r.n for r in found}

    def quartiles(self) -> dict[tuple[str, int], tuple[int, float, float]]:
        """n, q1 and q3 of the non-null, non-NaN values of numeric columns."""
        counts, names, ends = {}, {}, {}
        for at, (st, s) in self._places().items():
            names[at] = (st.dataset, s.pos)
            counts[at] = st.total_rows - st.null_count[s.pos] - st.nan_count[s.pos]
            if None not in (range_ := st.raw_moments(s)[2:]):
                ends[at] = tuple(float(int(x) >> 6) for x in range_) if self._in_blocks(st, s) else range_
        return {names[i]: (counts[i], *q) for i, q in quantiles([], counts, ends=ends, counted=self.numbers, refine=self._inside).items()} if names else {}

    def _inside(self, at: dict[tuple[int, int], float]) -> dict[tuple[int, int], float]:
        """(column, rank) -> value, where ``at`` has the block of columns in blocks:
        the rows below a block are added up, its values (64 at most) are counted."""
        places = self._places()
        asked = {(c, r): int(block) for (c, r), block in at.items() if self._in_blocks(*places[c])}
        if not asked:
            return at
        wanted: dict[int, list[int]] = {}
        for c, block in sorted({(c, block) for (c, _), block in asked.items()}):
            wanted.setdefault(c, []).append(block)
        sides = self.spark.createDataFrame([(c, float(block)) for c, blocks in wanted.items() for block in blocks], "column INT, block DOUBLE")
        # four blocks a column at most
        under = self.numbers.join(F.broadcast(sides), "column").where(F.col("value") < F.col("block")).groupBy("column", "block").agg(F.sum("cnt").alias("n"))
        below = {(r.column, int(r.block)): r.n for r in under.collect()}
        cells = [df.where(block_of(s.col).isin(wanted[first + s.pos])).groupBy(s.col.cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(first + s.pos).alias("column"), "value", "n")
                 for first, df, _, specs in self._numbered() for s in specs if first + s.pos in wanted]
        inside: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in sorted(_union(cells).collect(), key=lambda r: r.value):
            inside.setdefault((r.column, r.value >> 6), []).append((r.value, r.n))
        found = dict(at)
        for (c, rank), block in asked.items():
            upto = below.get((c, block), 0)
            for value, n in inside[c, block]:
                upto += n
                if rank < upto:
                    found[c, rank] = float(value)
                    break
        return found

    def outliers(self) -> dict[tuple[str, int], tuple[int, float, float, int, float]]:
        """n, q1, q3, outlier count and percentage of numeric columns: one
        aggregate of the counted values, with the fences as literals (of the input,
        for columns in blocks)."""
        found = {k: (*v, 0, 0.0) for k, v in self.quartiles().items()}
        places = self._places()
        fences: dict[int, tuple[float, float]] = {}
        for at, (st, s) in places.items():
            n, q1, q3, *_ = found.get((st.dataset, s.pos), (0, 0.0, 0.0))
            iqr = q3 - q1
            # infinite quartiles make the range NaN: comparisons with NaN are false in the reference
            if n < C.MIN_IQR_VALUES or iqr == 0 or math.isnan(iqr):
                continue
            fences[at] = (q1 - C.OUTLIER_IQR_FACTOR * iqr, q3 + C.OUTLIER_IQR_FACTOR * iqr)

        def beyond(x: Column, at: int) -> Column:
            return (x < fences[at][0]) | (x > fences[at][1])

        tables = []
        if counted := [(F.col("column") == at) & beyond(F.col("value"), at) for at in fences if not self._in_blocks(*places[at])]:
            out = self.numbers.where(~F.isnan("value") & reduce(lambda a, b: a | b, counted))
            tables.append(out.groupBy("column").agg(F.sum("cnt").alias("n")))
        for first, df, st, specs in self._numbered():
            blocks = [s for s in specs if first + s.pos in fences and self._in_blocks(st, s)]
            if blocks:
                sums = [F.struct(F.lit(first + s.pos).alias("column"), F.count_if(beyond(s.col.cast("double"), first + s.pos)).alias("n")) for s in blocks]
                tables.append(df.agg(F.array(*sums).alias("sums")).select(F.inline("sums")).where("n > 0"))
        if tables:
            for r in _union(tables).collect():
                st, s = places[r.column]
                n, q1, q3, *_ = found[st.dataset, s.pos]
                found[st.dataset, s.pos] = (n, q1, q3, r.n, _py_round(r.n / n * 100, 2))
        return found

    # -- other columns: A7, A12 input, K1 -------------------------------------
    @property
    def freq(self) -> DataFrame:
        """(dataset, pos, key, cnt) of the columns that are not numeric, computed
        once, written to the shared folder and read from there."""
        if self._freq is None:
            tables = [frequency_table(Placed(df), specs).select(F.lit(st.dataset).alias("dataset"), "pos", "key", "cnt") for df, st, specs in self._specs(False)]
            self._freq = materialize(_union(tables), f"{stage_dir(self.spark)}/freq")
        return self._freq

    def class_counts(self) -> dict[tuple[str, int], tuple[int, int, int]]:
        """Distinct values, greatest and least count of the columns that are not numeric."""
        found = self.freq.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("cnt").alias("most"), F.min("cnt").alias("least")).collect()
        return {(r.dataset, r.pos): (r.n, r.most, r.least) for r in found}

    def top_keys(self, k: int = C.TOP_VALUES) -> dict[tuple[str, int], list[tuple[int, str]]]:
        """(count, key) of the k most frequent values of each column, ties by
        value; a long value's key is its beginning and a digest.

        Values are grouped by count and beginning (64 characters); a task sends
        its first k groups a column, and a group that lies whole within the first
        k gives all its keys.  Where one goes beyond, its values are told apart by
        their next characters, twice as many in each round, and only those still
        tied with the k-th go into the next."""
        head = F.substring("key", 1, C.LONG_TEXT_CHARS)
        state: dict[tuple[str, int], TopKeys] = {}
        self._take(self.freq.withColumn("part", head), [F.desc("cnt"), F.asc("part")], ["cnt"], state, k)
        offset = width = C.LONG_TEXT_CHARS
        left = None
        while edges := {c: t for c, t in state.items() if t.edge}:
            if left is None:
                rows = [(d, p, *t.edge) for (d, p), t in edges.items()]
                heads = {(d, p): t.edge[1] for (d, p), t in edges.items()}
                left = self.freq.withColumn("part", head).join(F.broadcast(self.spark.createDataFrame(rows, "dataset STRING, pos INT, cnt LONG, part STRING")), [*KEYS, "cnt", "part"])
            else:
                rows = [(d, p, t.edge[1]) for (d, p), t in edges.items()]
                left = now.join(F.broadcast(self.spark.createDataFrame(rows, "dataset STRING, pos INT, part STRING")), [*KEYS, "part"])  # noqa: F821
            nexts = []
            for df, st, specs in self._specs(False):
                for s in specs:
                    if (st.dataset, s.pos) in edges:
                        value = display_value(s.col, s.dt)
                        nexts.append(df.where(F.substring(value, 1, C.LONG_TEXT_CHARS) == heads[st.dataset, s.pos]).select(
                            F.lit(st.dataset).alias("dataset"), F.lit(s.pos).alias("pos"), value_key(s.col, s.dt).alias("key"),
                            F.substring(value, offset + 1, width).alias("part")))
            parts = _union(nexts).groupBy(*KEYS, "key").agg(F.min("part").alias("part"))
            now = materialize(left.select(*KEYS, "key", "cnt").join(parts, [*KEYS, "key"]), f"{stage_dir(self.spark)}/tied")
            self._take(now, [F.asc("part")], [], state, k)
            offset, width = offset + width, 2 * width
        return {c: t.keys for c, t in state.items()}

    def _take(self, table: DataFrame, order: list, by: list[str], state: dict[tuple[str, int], TopKeys], k: int) -> None:
        """Go through the first groups of equal ``part`` (and ``by``) of each
        column: whole groups as long as they fit, then the one that does not."""
        groups = table.groupBy(*KEYS, "part", *by).agg(F.count(F.lit(1)).alias("n"), F.min("cnt").alias("cnt_"), F.min("key").alias("only"))
        first = groups.withColumn("place", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order))).where(F.col("place") <= k).collect()
        whole: list[tuple[str, int, str, int]] = []
        had = {c: t.wanted for c, t in state.items()}
        for t in state.values():
            t.edge, t.wanted = None, 0
        for r in sorted(first, key=lambda r: (r.dataset, r.pos, r.place)):
            column = (r.dataset, r.pos)
            t = state.setdefault(column, TopKeys([]))
            room = had.setdefault(column, k)
            if t.edge or not room:
                continue
            if r.n > room:
                t.edge, t.wanted = (r.cnt_, r.part), room
                continue
            had[column] = room - r.n
            if r.n == 1:
                t.keys.append((r.cnt_, r.only))
            else:
                whole.append((r.dataset, r.pos, r.part, r.cnt_))
        if whole:  # k keys a column at most
            wanted = self.spark.createDataFrame(whole, "dataset STRING, pos INT, part STRING, cnt LONG")
            for r in table.join(F.broadcast(wanted), [*KEYS, "part", "cnt"], "left_semi").select(*KEYS, "key", "cnt").collect():
                state[r.dataset, r.pos].keys.append((r.cnt, r.key))

    def _long_values(self, keys: dict[tuple[str, int], list[tuple[int, str]]], k: int) -> DataFrame | None:
        """(dataset, pos, tv) for the columns that have long values among the
        first: a second scan finds the texts of these few keys."""
        long = {c: ks for c, ks in keys.items() if any(len(key) > C.LONG_TEXT_CHARS for _, key in ks)}
        if not long:
            return None
        top = self.spark.createDataFrame([(d, p, key, n) for (d, p), ks in long.items() for n, key in ks], "dataset STRING, pos INT, key STRING, count LONG")
        want = top.where(F.length("key") > C.LONG_TEXT_CHARS)
        heads = want.select(*KEYS, F.substring("key", 1, C.LONG_TEXT_CHARS).alias("head")).distinct()
        cells = []
        for df, st, specs in self._specs(False):
            for s in specs:
                if (st.dataset, s.pos) in long:
                    value = display_value(s.col, s.dt)
                    cells.append(df.select(F.lit(st.dataset).alias("dataset"), F.lit(s.pos).alias("pos"), value.alias("value")).where(F.length("value") > C.LONG_TEXT_CHARS))
        # k rows a column on the small side; texts are hashed only where their beginning is wanted
        texts = (_union(cells).withColumn("head", F.substring("value", 1, C.LONG_TEXT_CHARS))
                 .join(F.broadcast(heads), [*KEYS, "head"], "left_semi").withColumn("key", F.concat("head", F.sha2("value", 256)))
                 .join(F.broadcast(want.select(*KEYS, "key")), [*KEYS, "key"], "left_semi").groupBy(*KEYS, "key").agg(F.min("value").alias("full")))
        shown = top.join(texts, [*KEYS, "key"], "left").select(*KEYS, F.coalesce("full", "key").alias("value"), "count")
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("rank"), "value", "count")))
        return shown.groupBy(*KEYS).agg(F.transform(ranked, lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("tv"))

    # -- assembled per-column table ------------------------------------------
    def columns(self, k: int = C.TOP_VALUES) -> DataFrame:
        """One row per kept column, in the report's ColumnProfile shape plus
        raw moments and quantiles."""
        with ThreadPoolExecutor(max_workers=1) as ex:  # the two kinds of columns are independent of each other
            other = bool(self._specs(False))
            numeric, distinct = ex.submit(self.outliers), ex.submit(self.numeric_distinct)
            keys = self.top_keys(k) if other else {}
            classes = self.class_counts() if other else {}
            numeric, distinct = numeric.result(), distinct.result()
        rows = []
        for _, st in self.parts:
            for s in st.kept:
                at = (st.dataset, s.pos)
                mean, std, low, high = st.raw_moments(s)
                stats = s.kind == NUMERIC and low is not None
                values, most, least = (distinct.get(at, 0), None, None) if s.kind == NUMERIC else classes.get(at, (0, None, None))
                n, q1, q3, outlying, share = numeric.get(at, (None, None, None, 0, 0.0))
                tops = None if s.kind == NUMERIC else [(key, n) for n, key in sorted(keys.get(at, []), key=lambda x: (-x[0], x[1]))]
                rounded = [None if x is None or not stats else x if math.isinf(x) else _py_round(x, 6) for x in (mean, std, low, high)]
                rows.append((st.dataset, s.pos, s.name, s.dtype, s.kind, st.total_rows, st.null_count[s.pos], st.nan_count[s.pos], st.missing_pct(s),
                             values + (st.null_count[s.pos] > 0), *rounded, share if stats else None, outlying if stats else None, tops,
                             mean, std, low, high, q1, q3, n, most, least, values))
        table = self.spark.createDataFrame(rows, COLUMNS_SCHEMA)
        long = self._long_values(keys, k)
        if long is None:
            return table
        return table.join(long, list(KEYS), "left").withColumn("top_values", F.coalesce("tv", "top_values")).drop("tv")


def dropped_columns(stats: BaseStats) -> DataFrame:
    """(dataset, pos, name, missing_ratio, reason)."""
    r = F.col("missing_ratio")
    reason = F.concat(F.lit(C.DROP_REASON[0]), F.format_string("%.1f", py_round(r * 100, 1)), F.lit(C.DROP_REASON[1]))
    return stats.meta.where(~F.col("kept")).select("dataset", "pos", "name", "missing_ratio", reason.alias("reason"))
