"""The full profiling plan, for one DataFrame or many.

``profile(df, name)`` and ``profile_many({name: df})`` return a ``Profile``: a
bundle of DataFrames keyed by ``dataset``, each computed when it is asked for.
Whatever the number of columns, a dataset is read once for each of: the wide
aggregate, the values of each column, the long texts among the top values, the
pair moments, the duplicates; everything after that is
O(columns) rows.  The per-dataset pieces are unioned before the rules run, so
flags, recommendations, scores and report rows of many datasets come from one
plan.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import Placed, positional
from ..operators.correlation import pairs_of, top_correlations
from ..operators.duplicates import duplicates_of
from ..operators.profile import BaseStats, ColumnProfiler, base_stats, dropped_columns
from ..operators.rules import bias_flags, imbalance, recommendations
from ..operators.score import (completeness_score, consistency_score,
                               health_score, noise_score, raw_health)
from ..session import materialize, stage_dir

SUMMARY_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("total_rows", T.LongType(), False),
    T.StructField("total_columns", T.IntegerType(), False),
    T.StructField("missing_cells", T.LongType(), False),
    T.StructField("missing_cells_exact", T.LongType(), False),
    T.StructField("missing_pct", T.DoubleType(), False),
    T.StructField("dropped_count", T.IntegerType(), False),
])


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


#: Datasets up to which all outputs are planned side by side (of more, two are): plans grow with the number
#: of datasets, and the driver holds all that are being planned.
SIDE_BY_SIDE = 4
#: Columns that one plan covers, so that what the driver plans does not grow with the
#: number of datasets (a dataset is not cut).
PLANNED = 32
#: Estimated bytes from which an input of few splits is dealt out.
WORTH_SPREADING = 64 << 20
#: Times a core's even share that one task may read of an input that is left as it lies.
UNEVEN = 2
_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def spread(df: DataFrame) -> DataFrame:
    """An input that too few tasks would read (a file is one task if it has one
    row group, and every step reads it again) is written once in as many parts as
    there are cores.  Only inputs of at most one split for each core are: what is
    larger has enough tasks, what is tiny needs none.  Sizes come from the
    optimizer's estimate; of what is left, the rows of each task are counted (from the
    footers of Parquet files), and an input that is dealt out evenly as it lies is
    not written again."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    most = cores * int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not WORTH_SPREADING <= size <= most or not all(isinstance(f.dataType, _PLAIN) for f in df.schema.fields):
        return df
    if len(df.inputFiles()) >= cores:
        return df
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # one a task
    if not rows or max(rows) * cores <= UNEVEN * sum(rows):
        return df
    return materialize(df.repartition(cores), f"{stage_dir(spark)}/input")


class Pieces:
    """One dataset: its base statistics now, everything else when asked for."""

    def __init__(self, df: DataFrame, name: str):
        placed = spread(positional(df))
        self.stats: BaseStats = base_stats(Placed(placed), name, df.schema)
        self.df = Placed(placed.select(*[s.col for s in self.stats.kept]))


def at_once(work: list, most: int = 4) -> list:
    """Calls that are independent of each other, a few at a time: their Spark
    jobs share the cluster, stages of one fill the slots another leaves idle."""
    with ThreadPoolExecutor(max_workers=min(most, len(work))) as ex:
        return list(ex.map(lambda f: f(), work))


def _groups(pieces: list[Pieces]) -> list[list[Pieces]]:
    """Datasets that are planned together."""
    groups, width = [[]], 0
    for p in pieces:
        width += len(p.stats.kept)
        if groups[-1] and width > PLANNED:
            groups.append([])
            width = len(p.stats.kept)
        groups[-1].append(p)
    return groups


class Profile:
    """All outputs of the profiler for a set of datasets.

    Each output is a table with rows for every dataset.  It is computed when
    it is first asked for, and only then; those that others are made of (columns,
    correlations, flags, summary) and the reports are O(columns) rows, written once
    and read back from Parquet, so that plans over them stay small.
    """

    def __init__(self, spark: SparkSession, pieces: list[Pieces]):
        self.spark = spark
        self.pieces = pieces
        self.path = stage_dir(spark)

    def _result(self, name: str, df: DataFrame) -> DataFrame:
        return materialize(df, f"{self.path}/{name}")

    def _together(self, *names: str) -> None:
        """Outputs that do not need each other, computed at once where they are
        still to be computed (of few datasets all, of many two at a time)."""
        todo = [n for n in names if n not in self.__dict__]
        if len(todo) > 1:
            at_once([partial(getattr, self, n) for n in todo], 4 if len(self.pieces) <= SIDE_BY_SIDE else 2)

    @cached_property
    def columns(self) -> DataFrame:
        found = _union([ColumnProfiler([(p.df, p.stats) for p in g]).columns() for g in _groups(self.pieces)])
        return found if found.isLocal() else self._result("columns", found)

    @cached_property
    def correlations(self) -> DataFrame:
        return self._result("correlations", _union([top_correlations(pairs_of(
            [(p.df, p.stats.kept, p.stats.dataset) for p in g], {p.stats.dataset: p.stats.means for p in g})) for g in _groups(self.pieces)]))

    @cached_property
    def duplicates(self) -> DataFrame:
        keys = {p.stats.dataset: (p.stats.likely_key, p.stats.total_rows) for p in self.pieces if p.stats.likely_key}
        return _union([duplicates_of([(p.df, p.stats.kept, p.stats.dataset) for p in g], keys=keys) for g in _groups(self.pieces)])

    @cached_property
    def dropped(self) -> DataFrame:
        return _union([dropped_columns(p.stats) for p in self.pieces])

    @cached_property
    def imbalance(self) -> DataFrame:
        return imbalance(self.columns)

    @cached_property
    def flags(self) -> DataFrame:
        self._together("columns", "correlations")
        return self._result("flags", bias_flags(self.columns, self.correlations, self.no_columns))

    @cached_property
    def no_columns(self) -> DataFrame:
        """Datasets that lost every column to the missing-value rule."""
        names = [(p.stats.dataset, len(p.stats.specs)) for p in self.pieces if p.stats.specs and not p.stats.kept]
        return self.spark.createDataFrame(names, "dataset STRING, columns INT")

    @cached_property
    def recommendations(self) -> DataFrame:
        return recommendations(self.summary, self.columns, self.correlations, self.dropped)

    @cached_property
    def base(self) -> DataFrame:
        """What the base statistics alone say of each dataset."""
        return self.spark.createDataFrame(
            [(p.stats.dataset, p.stats.total_rows, len(p.stats.kept), p.stats.missing_cells,
              p.stats.missing_cells_exact, float(p.stats.overall_missing_pct), len(p.stats.dropped))
             for p in self.pieces], SUMMARY_SCHEMA)

    @cached_property
    def summary(self) -> DataFrame:
        self._together("columns", "correlations", "duplicates")
        # one grouped sum over the few rows of all parts
        parts = [self.duplicates.select("dataset", "duplicate_rows", F.lit(0).alias("outlier_count"), F.lit(0).alias("flag_count")),
                 self.columns.select("dataset", F.lit(0).alias("duplicate_rows"), "outlier_count", F.lit(0).alias("flag_count")),
                 self.flags.select("dataset", F.lit(0).alias("duplicate_rows"), F.lit(0).alias("outlier_count"), F.lit(1).alias("flag_count"))]
        counts = _union(parts).groupBy("dataset").agg(*[F.sum(c).alias(c) for c in ("duplicate_rows", "outlier_count", "flag_count")])
        s = self.base.join(F.broadcast(counts), "dataset", "left").fillna(0, ["duplicate_rows", "outlier_count", "flag_count"])
        args = [F.col("missing_pct"), F.col("duplicate_rows"), F.col("total_rows"),
                F.col("outlier_count"), F.col("dropped_count"), F.col("flag_count")]
        return self._result("summary", s.select(
            "dataset", "total_rows", "total_columns", "missing_cells", "missing_cells_exact",
            "missing_pct", F.col("duplicate_rows").cast("long").alias("duplicate_rows"),
            F.col("outlier_count").cast("long").alias("outlier_count"),
            "dropped_count", F.col("flag_count").cast("long").alias("flag_count"),
            raw_health(*args).alias("raw_health"),
            health_score(*args).alias("health_score"),
            completeness_score(F.col("missing_pct")).alias("completeness_score"),
            consistency_score(F.col("duplicate_rows"), F.col("total_rows")).alias("consistency_score"),
            noise_score(F.col("outlier_count"), F.col("total_rows")).alias("noise_score")))

    def reports(self) -> DataFrame:
        """One row per dataset in the report shape of SURVEY §1.4."""
        summary = self.summary
        parts = {"s": summary.select("dataset", F.struct(*[c for c in summary.columns if c != "dataset"]).alias("s")),
                 "c": self.columns.select("dataset", F.struct("pos", "name", "dtype", "missing_pct", "unique_count", "mean", "std", "min", "max",
                                                              "outlier_pct", "outlier_count", "top_values").alias("c")),
                 "k": self.correlations.select("dataset", F.struct("rank", "col1", "col2", "value").alias("k")),
                 "f": self.flags.select("dataset", F.struct("seq", "message").alias("f")),
                 "r": self.recommendations.select("dataset", F.struct("seq", "message").alias("r")),
                 "d": self.dropped.select("dataset", F.struct("pos", "name", "reason").alias("d"))}
        # all parts in one grouping instead of a join for each
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())
        j = rows.groupBy("dataset").agg(F.first("s", ignorenulls=True).alias("s"), *[F.array_sort(F.collect_list(p)).alias(p) for p in "ckfrd"])
        j = j.select("dataset", "s.*", *"ckfrd")

        def strip(arr, fields):
            return F.coalesce(F.transform(arr, lambda x: F.struct(*[x[f].alias(f) for f in fields])),
                              F.array())
        return self._result("reports", j.select(
            "dataset", "health_score", "total_rows", "total_columns", "missing_cells", "missing_pct",
            "duplicate_rows", "outlier_count", "completeness_score", "consistency_score", "noise_score",
            strip(F.col("c"), ["name", "dtype", "missing_pct", "unique_count", "mean", "std", "min",
                               "max", "outlier_pct", "outlier_count", "top_values"]).alias("columns"),
            strip(F.col("k"), ["col1", "col2", "value"]).alias("correlations"),
            F.coalesce(F.transform("f", lambda x: x["message"]), F.array().cast("array<string>")).alias("bias_flags"),
            F.coalesce(F.transform("r", lambda x: x["message"]), F.array().cast("array<string>")).alias("recommendations"),
            strip(F.col("d"), ["name", "reason"]).alias("dropped_columns"),
            "missing_cells_exact"))


def profile(df: DataFrame, name: str) -> Profile:
    return Profile(df.sparkSession, [Pieces(df, name)])


def profile_many(frames: dict[str, DataFrame]) -> Profile:
    """Profile several datasets; their driver steps are independent and run a
    few at a time."""
    spark = next(iter(frames.values())).sparkSession
    return Profile(spark, at_once([partial(Pieces, df, n) for n, df in frames.items()]))
