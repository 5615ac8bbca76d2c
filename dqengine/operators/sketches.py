"""Fast mode of the profile (A1-A6 estimated): mergeable state for each column.

The exact profile reads the input several times and has to read all of it again
when rows are added.  Here a batch of rows becomes one small row for each column,
by one aggregate over the batch:

* exact and mergeable: rows, nulls, NaNs, least and greatest value, and count,
  sum and centred sum of squares (merged by the parallel update of the variance);
* distinct values: a HyperLogLog sketch of 2**14 registers, standard error 0.8 %;
* quartiles: a KLL sketch of k = 1024, rank error below 1 %.

States of batches are stored beside each other; the profile of a dataset merges
them and reads no row of its input.  A batch is a folder that is written as a
whole, so one that is added again under its id stands once.

Nulls count as one more distinct value (as in A3); NaN is one value and takes no
part in moments and quartiles (D6).  Empty batches and columns without any value
have null moments and quartiles.  Columns are told apart by dataset, place, name
and type: a column whose type changes between batches has one row for each type.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.keys import NUMERIC, ColumnSpec, display_value, positional, specs_of
from ..functions.scalar import py_round

#: Registers of the distinct sketch (as a power of two) and size of the quantile
#: sketch; every state that is merged must have been made with the same.
HLL_LG_K, KLL_K = 14, 1024
#: What the sketches promise: four and more standard errors for distinct counts, a
#: share of the rows for ranks.
DISTINCT_ERROR, RANK_ERROR = 0.04, 0.01
#: Ranks at which the shares beyond the fences are read off.
GRID = 1000
#: States that one task folds at a time, on average; more are merged in levels.
FAN_IN = 64

KEYS = ("dataset", "pos", "name", "dtype", "kind")
_OWN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _bare(c: Column, dt: T.DataType) -> Column:
    """What is hashed of a value: itself where its type tells values apart (both zeros
    are one), else the text it is shown as, which costs far more to make."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c + F.lit(0.0).cast(dt)
    return c if isinstance(dt, _OWN) else display_value(c, dt)


def _column_state(s: ColumnSpec) -> Column:
    c, double = s.col, "double"
    is_float = isinstance(s.dt, (T.FloatType, T.DoubleType))
    v = F.lit(None).cast(double)
    if s.kind == NUMERIC:
        v = F.when(~F.isnan(c), c.cast(double)) if is_float else c.cast(double)
    n = F.count(v)
    return F.struct(
        F.lit(s.pos).alias("pos"), F.lit(s.name).alias("name"), F.lit(s.dtype).alias("dtype"), F.lit(s.kind).alias("kind"),
        F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"),
        (F.count_if(F.isnan(c)) if is_float else F.lit(0).cast("long")).alias("nans"),
        n.alias("n"), F.sum(v).alias("total"), (F.var_pop(v) * n).alias("m2"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        # a sketch takes no empty string, so it gets 64-bit digests of the values
        F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(_bare(c, s.dt))), F.lit(HLL_LG_K)).alias("hll"),
        F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias("kll"))


def state_of(df: DataFrame, dataset: str) -> DataFrame:
    """The state of one batch of rows: one row for each column, in one pass."""
    states = [_column_state(s) for s in specs_of(df.schema)]
    return (positional(df).agg(F.array(*states).alias("states"))
            .select(F.lit(dataset).alias("dataset"), F.inline("states")))


def add_batch(state: DataFrame, root: str, batch: str) -> None:
    """Store states (of one or many datasets) as one batch.  The id may hold any
    character; a batch that comes again replaces itself."""
    folder = hashlib.sha256(batch.encode()).hexdigest()[:32]
    (state.withColumn("part", F.xxhash64(F.lit(batch))).coalesce(1)
          .write.mode("overwrite").parquet(f"{root}/sketches/batch={folder}"))


def stored_states(spark: SparkSession, root: str) -> DataFrame:
    """All stored states of a folder, batch by batch."""
    return spark.read.parquet(f"{root}/sketches").drop("batch")


def _pooled(a: Column, b: Column) -> Column:
    """Count, sum and centred squares of two groups, and their quantile sketches."""
    n = a["n"] + b["n"]
    delta = b["total"] / b["n"] - a["total"] / a["n"]
    both = F.struct(
        n.alias("n"), (a["total"] + b["total"]).alias("total"),
        (a["m2"] + b["m2"] + delta * delta * (a["n"].cast("double") * b["n"] / n)).alias("m2"),
        F.kll_sketch_merge_double(a["kll"], b["kll"]).alias("kll"))
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)


def _fold(state: DataFrame, groups: int) -> DataFrame:
    """One level: the states of each column merged within ``groups`` groups."""
    part = F.pmod(F.xxhash64("part", F.lit(groups)), F.lit(groups)).cast("long")
    groupable = F.array_sort(F.collect_list(F.struct("part", "n", "total", "m2", "kll")))
    bare = F.transform(groupable, lambda x: F.struct(x["n"].alias("n"), x["total"].alias("total"), x["m2"].alias("m2"), x["kll"].alias("kll")))
    return (state.groupBy(*KEYS, part.alias("to"))
            .agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.sum("nans").alias("nans"),
                 F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.hll_union_agg("hll").alias("hll"), bare.alias("all"))
            .withColumn("m", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), F.col("all")[0], _pooled))
            .select(*KEYS, "rows", "nulls", "nans", "m.n", "m.total", "m.m2", "lo", "hi", "hll", "m.kll", F.col("to").alias("part")))


def merged(state: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One state for each column.  States are folded in levels of about
    ``fan_in``, dealt by hash, so no task holds all states of a dataset that has
    very many batches; one number (the batches of a dataset) reaches the driver."""
    most = state.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 1
    while most > fan_in:
        most = math.ceil(most / fan_in)
        state = _fold(state, most)
    return _fold(state, 1)


def approximate(state: DataFrame) -> DataFrame:
    """The profile that merged states give: per column rows, nulls, missing %,
    distinct values (estimated), mean, std, min, max, quartiles (estimated), the
    bounds within which the exact quartiles lie, and the rows beyond the IQR fences
    (estimated, within 2 % of the rows)."""
    some = F.col("n") > 0
    ps = [p for q in (0.25, 0.5, 0.75) for p in (q - RANK_ERROR, q, q + RANK_ERROR)]
    at = F.when(some, F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit(p) for p in ps])))
    df = state.withColumn("at", at)
    low, high = F.col("at")[1], F.col("at")[7]
    reach = (high - low) * F.lit(C.OUTLIER_IQR_FACTOR)
    # Spark asks a sketch for ranks of literals only, so the shares beyond the fences
    # are read off a grid of quantiles
    grid = F.kll_sketch_get_quantile_double("kll", F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)]))
    beyond = F.size(F.filter(grid, lambda x: (x < low - reach) | (x > high + reach))) / GRID
    outliers = F.when(F.col("n") >= C.MIN_IQR_VALUES, F.round(beyond * F.col("n")).cast("long"))
    missing = F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(0.0)
    return df.select(
        "dataset", "pos", "name", "dtype", "kind", "rows", "nulls", "nans", missing.alias("missing_ratio"), py_round(missing * 100, 2).alias("missing_pct"),
        (F.hll_sketch_estimate("hll") + (F.col("nulls") > 0).cast("long")).alias("distinct_estimate"),
        F.when(some, F.col("total") / F.col("n")).alias("mean"), F.when(some, F.sqrt(F.col("m2") / F.col("n"))).alias("std"),
        F.col("lo").alias("min"), F.col("hi").alias("max"), low.alias("q1"), F.col("at")[4].alias("median"), high.alias("q3"),
        F.struct(F.col("at")[0].alias("low"), F.col("at")[2].alias("high")).alias("q1_bounds"),
        F.struct(F.col("at")[6].alias("low"), F.col("at")[8].alias("high")).alias("q3_bounds"),
        F.when(some, outliers).alias("outlier_estimate"))
