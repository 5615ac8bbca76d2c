"""Dashboard queries over report tables.

The reference computes these in the browser over one report; here they are
batch DataFrame queries over the column / correlation / summary tables of any
number of datasets (per-dataset windows over O(columns) rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import py_round
from .score import (column_missing_alert, completeness_fallback,
                    consistency_fallback, correlation_band, missing_band,
                    noise_fallback, outlier_band, overall_missing_alert,
                    score_band)


def js_round(x: Column) -> Column:
    """JavaScript ``Math.round``: halves go up (towards +infinity)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def missing_top12(columns: DataFrame, k: int = 12) -> DataFrame:
    """P6 + K9 + H5: columns with any missing values, worst first, value to
    1 place; (dataset, rank, column, missing_pct, band)."""
    w = Window.partitionBy("dataset").orderBy(F.desc("missing_pct"), "pos")
    return (columns.where(F.coalesce("missing_pct", F.lit(0.0)) > 0)
                   .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                   .select("dataset", "rank", F.col("name").alias("column"),
                           py_round(F.col("missing_pct"), 1).alias("missing_pct"),
                           missing_band(F.col("missing_pct")).alias("band")))


def no_missing(columns: DataFrame) -> DataFrame:
    """(dataset, no_missing) - true when every column has 0 missing."""
    return columns.groupBy("dataset").agg(
        F.bool_and(F.coalesce("missing_pct", F.lit(0.0)) == 0).alias("no_missing"))


def corr_top15(correlations: DataFrame, k: int = 15) -> DataFrame:
    """K10 + H6: (dataset, rank, pair, value, abs_value, band), 3 places."""
    return (correlations.where(F.col("rank") <= k)
            .select("dataset", "rank", F.concat("col1", F.lit(" × "), "col2").alias("pair"),
                    py_round(F.col("value"), 3).alias("value"),
                    py_round(F.abs("value"), 3).alias("abs_value"),
                    correlation_band(F.col("value")).alias("band")))


def score_cards(summary: DataFrame) -> DataFrame:
    """H3, H4, H7: health band, sub-scores (stored, else the UI fallback,
    rounded like the UI) and the missing-cells alert."""
    cs = completeness_fallback(F.col("completeness_score"), F.col("missing_pct"))
    ks = consistency_fallback(F.col("consistency_score"), F.col("duplicate_rows"))
    ns = noise_fallback(F.col("noise_score"), F.col("outlier_count"), F.col("total_rows"))
    return summary.select(
        "dataset", "health_score", score_band(F.col("health_score")).alias("band"),
        js_round(cs).alias("completeness_shown"), js_round(ks).alias("consistency_shown"),
        js_round(ns).alias("noise_shown"),
        overall_missing_alert(F.col("missing_pct")).alias("missing_alert"))


def column_cards(columns: DataFrame) -> DataFrame:
    """H7 + K11: per column the missing alert, the outlier band and the first
    five top values."""
    return columns.select(
        "dataset", "pos", "name", column_missing_alert(F.col("missing_pct")).alias("missing_alert"),
        F.when(F.col("mean").isNotNull(), outlier_band(F.col("outlier_pct"))).alias("outlier_band"),
        F.slice("top_values", 1, 5).alias("top5"))


def kpi_columns() -> list:
    """Count, ready, processing, rounded mean score, as aggregates."""
    return [F.count(F.lit(1)).alias("total_datasets"),
            F.count_if(F.col("status") == "ready").alias("ready"),
            F.count_if(F.col("status") == "processing").alias("processing"),
            F.coalesce(js_round(F.avg("health_score")), F.lit(0)).alias("avg_score")]


def kpis(datasets: DataFrame) -> DataFrame:
    """A13 over a catalogue."""
    return datasets.agg(*kpi_columns())


def _named(text: str):
    return F.lower("name").contains(text.lower())


def search(datasets: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring search on the dataset name."""
    return datasets.where(_named(text))


def hits(text: str):
    """How many names contain the text, as an aggregate."""
    return F.count_if(_named(text)).alias("hits")
