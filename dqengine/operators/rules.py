"""Quality flags (F1-F7) and recommendations.

Inputs are the small per-dataset tables (one row per column, per pair, per
dataset), keyed by ``dataset`` so that one plan handles any number of
datasets.  Every rule is a ``filter`` plus a message built with built-in
string functions; order follows the reference: per column (in table order)
the four column rules, then correlation pairs in ranking order, then class
imbalance per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.keys import CATEGORICAL, NUMERIC
from ..functions.scalar import (fmt_fixed, fmt_int, join_quoted, py_round,
                                safe_div)

FLAG_COLS = ["dataset", "grp", "pos", "sub", "rule_id", "column", "value", "message"]


def _flag(df: DataFrame, grp: int, pos, sub: int, rule: str, column, value, message) -> DataFrame:
    return df.select("dataset", F.lit(grp).alias("grp"), pos.cast("int").alias("pos"),
                     F.lit(sub).alias("sub"), F.lit(rule).alias("rule_id"),
                     column.alias("column"), value.cast("double").alias("value"),
                     message.alias("message"))


def imbalance(columns: DataFrame) -> DataFrame:
    """(dataset, pos, column, n_classes, max_count, min_count, ratio,
    majority_pct) for string/boolean columns with at least two classes."""
    ratio = safe_div(F.col("max_class_count"), F.col("min_class_count"), None)
    return (columns.where((F.col("kind") == CATEGORICAL) & (F.col("n_values") >= 2))
                   .select("dataset", "pos", F.col("name").alias("column"),
                           F.col("n_values").alias("n_classes"),
                           F.col("max_class_count").alias("max_count"),
                           F.col("min_class_count").alias("min_count"),
                           ratio.alias("ratio"),
                           py_round(safe_div(F.col("max_class_count"), F.col("total_rows")) * 100, 1)
                           .alias("majority_pct")))


# --- fixed values: the sentences of the rules below must equal the reference's,
# --- but for D12, which it does not have.
def bias_flags(columns: DataFrame, correlations: DataFrame, no_columns: DataFrame | None = None) -> DataFrame:
    """F1-F7, and D12 for datasets (dataset, columns) that kept no column:
    (dataset, seq, rule_id, column, value, message)."""
    name, total = F.col("name"), F.col("total_rows")
    uniq_ratio = safe_div(F.col("unique_count"), total, None)
    f1 = _flag(columns.where((total > 0) & (uniq_ratio > C.HIGH_CARDINALITY_RATIO)), 0, F.col("pos"), 0,
               "F1", name, F.col("unique_count"),
               F.concat(F.lit("Column '"), name, F.lit("' has very high cardinality ("),
                        fmt_int(F.col("unique_count")), F.lit(" unique values out of "), fmt_int(total),
                        F.lit(" rows). This looks like an ID or key column — exclude it from model features.")))
    mp = F.col("missing_pct")
    f2 = _flag(columns.where((mp > C.MISSING_WARN_THRESH * 100) & (mp < C.MISSING_DROP_THRESH * 100)),
               0, F.col("pos"), 1, "F2", name, mp,
               F.concat(F.lit("Column '"), name, F.lit("' is "), fmt_fixed(mp, 1),
                        F.lit("% missing. Consider imputation (median for numeric, mode or 'Unknown' for "
                              "categorical) before modeling.")))
    cv = F.col("std") / F.abs(F.col("mean"))
    f3 = _flag(columns.where(F.col("std").isNotNull() & F.col("mean").isNotNull() & (F.col("std") > 0)
                             & (F.abs(F.col("mean")) > 0) & (cv > C.CV_LIMIT)),
               0, F.col("pos"), 2, "F3", name, cv,
               F.concat(F.lit("Column '"), name, F.lit("' has very high coefficient of variation ("),
                        fmt_fixed(cv, 1),
                        F.lit("). The distribution is highly spread — consider log or box-cox transform.")))
    op = F.coalesce(F.col("outlier_pct"), F.lit(0.0))
    f4 = _flag(columns.where(op > C.OUTLIER_FLAG_PCT), 0, F.col("pos"), 3, "F4", name, op,
               F.concat(F.lit("Column '"), name, F.lit("' has "), fmt_fixed(op, 1),
                        F.lit("% outliers (IQR method). Inspect these rows — they may be data entry errors "
                              "or genuine anomalies.")))
    v = F.col("value")
    f5 = _flag(correlations.where(F.abs(v) >= C.CORR_HIGH_THRESH), 1, F.col("rank"), 0, "F5",
               F.concat(F.col("col1"), F.lit("~"), F.col("col2")), v,
               F.concat(F.lit("Columns '"), F.col("col1"), F.lit("' and '"), F.col("col2"),
                        F.lit("' are highly correlated (r = "), fmt_fixed(v, 3),
                        F.lit("). Consider removing one to reduce multicollinearity in linear models.")))
    imb = imbalance(columns)
    f6 = _flag(imb.where(F.col("ratio") >= C.CLASS_IMBALANCE_RATIO), 2, F.col("pos"), 0, "F6",
               F.col("column"), F.col("ratio"),
               F.concat(F.lit("Column '"), F.col("column"),
                        F.lit("' has severe class imbalance: the dominant class represents "),
                        F.format_string("%.1f", F.col("majority_pct")), F.lit("% of rows (imbalance ratio "),
                        fmt_fixed(F.col("ratio"), 1),
                        F.lit("×). Consider oversampling (SMOTE) or class weighting before classification.")))
    allf = f1.unionByName(f2).unionByName(f3).unionByName(f4).unionByName(f5).unionByName(f6)
    if no_columns is not None:
        allf = allf.unionByName(_flag(no_columns, 3, F.lit(0), 0, "D12", F.lit("no_columns"), F.col("columns"), F.lit(
            "Every column was dropped for missing values. There is nothing left to profile.")))
    w = Window.partitionBy("dataset").orderBy("grp", "pos", "sub")
    return allf.withColumn("seq", F.row_number().over(w)).select(
        "dataset", "seq", "rule_id", "column", "value", "message")


def recommendations(summary: DataFrame, columns: DataFrame, correlations: DataFrame,
                    dropped: DataFrame) -> DataFrame:
    """(dataset, seq, rule_id, message).  ``summary`` has one row per
    dataset with total_rows, missing_pct, duplicate_rows."""
    label = F.concat(F.col("col1"), F.lit(" ↔ "), F.col("col2"), F.lit(" ("),
                     fmt_fixed(F.col("value"), 2), F.lit(")"))
    hc = (correlations.where(F.abs("value") >= C.CORR_HIGH_THRESH)
          .select("dataset", "rank", label.alias("label"))
          .groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("hc")))
    oc = (columns.where(F.coalesce(F.col("outlier_pct"), F.lit(0.0)) > C.OUTLIER_REC_PCT)
          .groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("oc")))
    dr = dropped.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("dr"))
    s = summary.join(hc, "dataset", "left").join(oc, "dataset", "left").join(dr, "dataset", "left")
    rows, dup, mp = F.col("total_rows"), F.col("duplicate_rows"), F.col("missing_pct")
    pairs = F.array_join(F.transform(F.slice(F.col("hc"), 1, 3), lambda c: c["label"]), "; ")

    def rec(rule, cond, msg):
        return F.when(cond, F.struct(F.lit(rule).alias("rule_id"), msg.alias("message")))

    recs = F.array(
        rec("R1", dup > 0, F.concat(F.lit("Remove "), fmt_int(dup), F.lit(
            " duplicate rows before modeling — they can artificially inflate accuracy metrics."))),
        rec("R2", mp > C.MISSING_REC_PCT, F.concat(F.lit("Overall missing data is "), fmt_fixed(mp, 1), F.lit(
            "%. For numeric columns use median imputation; for categorical columns use mode or a "
            "dedicated 'Missing' category."))),
        rec("R3", F.size(F.coalesce("dr", F.array())) > 0, F.concat(
            F.lit("Columns "), join_quoted(F.transform("dr", lambda d: d["name"])), F.lit(
                " were automatically excluded due to excessive missing data (>60%). Review whether these "
                "can be recovered from another data source."))),
        rec("R4", F.size(F.coalesce("hc", F.array())) > 0, F.concat(
            F.lit("Highly correlated feature pairs detected: "), pairs,
            F.lit(". Drop one from each pair or apply PCA to reduce redundancy."))),
        rec("R5", F.size(F.coalesce("oc", F.array())) > 0, F.concat(
            F.lit("Columns "), join_quoted(F.transform(F.slice("oc", 1, 4), lambda d: d["name"])), F.lit(
                " contain more than 5% outliers. Use RobustScaler instead of StandardScaler, or cap values "
                "at the 1st/99th percentile."))),
        rec("R6", rows < C.SMALL_DATASET_ROWS, F.concat(F.lit("The dataset has only "), fmt_int(rows), F.lit(
            " rows. Models may overfit — prefer simpler algorithms (Logistic Regression, Decision Tree) "
            "and use cross-validation."))),
        rec("R6", rows > C.LARGE_DATASET_ROWS, F.concat(F.lit("Large dataset ("), fmt_int(rows), F.lit(
            " rows). Consider mini-batch training or tree-based methods like XGBoost / LightGBM that "
            "handle large data efficiently."))),
    )
    fallback = F.array(F.struct(F.lit("R7").alias("rule_id"), F.lit(
        "No critical issues found. The dataset appears ready for feature engineering and modeling.")
        .alias("message")))
    arr = F.array_compact(recs)
    arr = F.when(F.size(arr) == 0, fallback).otherwise(arr)
    return (s.select("dataset", arr.alias("arr"))
             .select("dataset", F.posexplode("arr").alias("i", "r"))
             .select("dataset", (F.col("i") + 1).alias("seq"), "r.rule_id", "r.message"))
