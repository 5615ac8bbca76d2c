"""Algorithm advisor (V1-V6), batch form: a table of reports in, the top-5
scored algorithms per report out.

The catalogue (V1) is a 10-row constant table; the hard problem-type filter
of V3 is expressed as an equi-join on the exploded problem types, so there
is no cross join, and the catalogue side is broadcast (fixed size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.scalar import fmt_fixed, fmt_int, safe_div

CLS, REG, CLU = "classification", "regression", "clustering"

# The algorithm catalogue (name, category, complexity, pros,
# cons, min rows, max rows, handles missing, handles outliers, handles
# imbalance, scale sensitive, problem types, base score), in catalogue order.
CATALOGUE = [
    ("Random Forest", "Classification / Regression", "medium",
     ["Handles missing values and outliers well", "Works on both classification and regression",
      "Provides feature importance out of the box", "Robust to overfitting with enough trees"],
     ["Slower to train on very large datasets", "Less interpretable than a single decision tree",
      "Memory-intensive for large forests"],
     100, None, True, True, True, False, [CLS, REG], 80),
    ("Gradient Boosting (XGBoost / LightGBM)", "Classification / Regression", "medium",
     ["State-of-the-art performance on tabular data", "Built-in handling of missing values (XGBoost)",
      "Fast with LightGBM for large datasets", "Supports class weights for imbalanced data"],
     ["More hyperparameters to tune", "Can overfit on small datasets",
      "Less interpretable without SHAP values"],
     500, None, True, True, True, False, [CLS, REG], 90),
    ("Logistic Regression", "Classification", "low",
     ["Fast to train and predict", "Highly interpretable — coefficients are meaningful",
      "Good baseline for binary classification", "Outputs calibrated probabilities"],
     ["Assumes linear decision boundary", "Sensitive to outliers and unscaled features",
      "Struggles with non-linear relationships"],
     50, None, False, False, True, True, [CLS], 70),
    ("Support Vector Machine (SVM)", "Classification", "high",
     ["Effective in high-dimensional spaces", "Works well when classes are clearly separable",
      "Many kernel options (RBF, polynomial, linear)"],
     ["Slow on datasets > 50k rows", "Requires feature scaling",
      "Sensitive to choice of kernel and C parameter"],
     50, 50_000, False, False, False, True, [CLS], 65),
    ("K-Nearest Neighbours (KNN)", "Classification / Regression", "low",
     ["No training phase — very simple to implement", "Naturally handles multi-class classification",
      "Good for small, clean datasets"],
     ["Very slow at prediction on large datasets", "Sensitive to outliers and unscaled features",
      "Performance degrades in high dimensions"],
     10, 20_000, False, False, False, True, [CLS, REG], 55),
    ("Decision Tree", "Classification / Regression", "low",
     ["Extremely interpretable — can be visualised as a tree", "No feature scaling needed",
      "Handles both numeric and categorical features"],
     ["Prone to overfitting without pruning", "Unstable — small data changes can alter the tree",
      "Poor generalisation compared to ensemble methods"],
     50, None, False, True, False, False, [CLS, REG], 60),
    ("Linear Regression / Ridge / Lasso", "Regression", "low",
     ["Fast and interpretable", "Lasso performs built-in feature selection",
      "Ridge handles multicollinearity well", "Excellent baseline for regression tasks"],
     ["Assumes linear relationship with target", "Sensitive to outliers",
      "Requires feature scaling for Ridge/Lasso"],
     30, None, False, False, False, True, [REG], 72),
    ("K-Means Clustering", "Clustering (Unsupervised)", "low",
     ["Simple and fast for large datasets", "Works well when clusters are roughly spherical",
      "Good for customer segmentation and grouping"],
     ["Must specify number of clusters (k) in advance", "Sensitive to outliers and feature scaling",
      "Assumes clusters are convex and isotropic"],
     100, None, False, False, False, True, [CLU], 65),
    ("Neural Network (MLP)", "Classification / Regression", "high",
     ["Can learn complex non-linear patterns", "Flexible architecture for many problem types",
      "Scales well with more data"],
     ["Needs large amounts of data to generalise", "Slow to train; requires GPU for speed",
      "Difficult to interpret — 'black box'", "Many hyperparameters to tune"],
     5_000, None, False, False, True, True, [CLS, REG], 75),
    ("Naive Bayes", "Classification", "low",
     ["Extremely fast training and prediction", "Works well on small datasets",
      "Handles high-dimensional data (e.g. text)"],
     ["Assumes feature independence (often violated)", "Poor calibration of probabilities",
      "Struggles with correlated features"],
     20, None, False, True, False, False, [CLS], 58),
]

CATALOGUE_SCHEMA = T.StructType([
    T.StructField("algo_idx", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("complexity", T.StringType(), False),
    T.StructField("pros", T.ArrayType(T.StringType()), False),
    T.StructField("cons", T.ArrayType(T.StringType()), False),
    T.StructField("min_rows", T.LongType(), False),
    T.StructField("max_rows", T.LongType(), True),
    T.StructField("handles_missing", T.BooleanType(), False),
    T.StructField("handles_outliers", T.BooleanType(), False),
    T.StructField("handles_imbalance", T.BooleanType(), False),
    T.StructField("scale_sensitive", T.BooleanType(), False),
    T.StructField("problem_types", T.ArrayType(T.StringType()), False),
    T.StructField("base_score", T.IntegerType(), False),
])


def catalogue(spark: SparkSession) -> DataFrame:
    """V1: the 10-row catalogue."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(CATALOGUE)], CATALOGUE_SCHEMA)


def problem_type(columns: DataFrame) -> DataFrame:
    """V2 per dataset from the column table: (dataset, problem_type).

    A non-numeric column (it has top values) with <= 20 distinct values means
    classification; otherwise >= 5 numeric columns means regression, else
    clustering."""
    has_top = F.col("top_values").isNotNull()
    has_mean = F.col("mean").isNotNull()
    g = columns.groupBy("dataset").agg(
        F.count_if(has_top & (F.col("unique_count") <= C.CLASSIFICATION_MAX_CLASSES)).alias("n_target"),
        F.count_if(has_mean).alias("n_numeric"))
    t = (F.when(F.col("n_target") > 0, F.lit(CLS))
          .when(F.col("n_numeric") == 0, F.lit(CLU))
          .when(F.col("n_numeric") >= C.REGRESSION_MIN_NUMERIC, F.lit(REG))
          .otherwise(F.lit(CLU)))
    return g.select("dataset", t.alias("problem_type"))


def advisor_inputs(summary: DataFrame, columns: DataFrame, flags: DataFrame,
                   correlations: DataFrame) -> DataFrame:
    """(dataset, total_rows, missing_pct, outlier_count, duplicate_rows,
    has_imbalance, has_high_corr, problem_type) - A15 and V2."""
    imb = flags.groupBy("dataset").agg(
        F.bool_or(F.lower("message").contains("imbalance")).alias("has_imbalance"))
    hc = correlations.groupBy("dataset").agg(
        F.bool_or(F.abs("value") >= C.CORR_HIGH_THRESH).alias("has_high_corr"))
    return (summary.select("dataset", "total_rows", "missing_pct", "outlier_count", "duplicate_rows")
            .join(imb, "dataset", "left").join(hc, "dataset", "left")
            .join(problem_type(columns), "dataset", "left")
            .fillna(False, ["has_imbalance", "has_high_corr"])
            .fillna(CLU, ["problem_type"]))


def recommend_algorithms(inputs: DataFrame, top: int = C.TOP_ALGORITHMS) -> DataFrame:
    """V3-V6 + K5: (dataset, rank, algo_idx, name, category, complexity,
    score, pros, cons, reason)."""
    cat = catalogue(inputs.sparkSession)
    by_type = cat.withColumn("problem_type", F.explode("problem_types"))
    rows = F.col("total_rows")
    j = inputs.join(F.broadcast(by_type), "problem_type")
    j = j.where((rows >= F.col("min_rows")) & (F.col("max_rows").isNull() | (rows <= F.col("max_rows"))))
    out_pct = safe_div(F.col("outlier_count"), rows) * F.lit(100.0)
    dup_pct = safe_div(F.col("duplicate_rows"), rows) * F.lit(100.0)

    def pts(cond, v):
        return F.when(cond, F.lit(v)).otherwise(F.lit(0))

    mp = F.col("missing_pct")
    score = (F.col("base_score")
             + pts((mp > 5) & ~F.col("handles_missing"), -15)
             + pts((out_pct > 5) & ~F.col("handles_outliers"), -10)
             + pts(F.col("has_imbalance") & ~F.col("handles_imbalance"), -12)
             + pts(F.col("scale_sensitive") & (out_pct > 3), -8)
             + pts(F.col("has_high_corr") & F.col("name").startswith("Logistic"), -10)
             + pts((rows > 100_000) & F.col("name").contains("Gradient"), 8)
             + pts((rows < 1_000) & (F.col("complexity") == "low"), 5)
             + pts((rows > 500_000) & (F.col("complexity") == "high"), -10)
             + pts(dup_pct > 5, -5))
    scored = j.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"))
    sc = F.col("score")
    reason = F.concat_ws(
        " ",
        F.concat(F.lit("Recommended for a "), F.col("problem_type"), F.lit(" task with "), fmt_int(rows),
                 F.lit(" rows.")),
        F.when(F.col("handles_missing") & (mp > 5),
               F.concat(F.lit("Handles the "), fmt_fixed(mp, 1), F.lit("% missing data natively."))),
        F.when(~F.col("scale_sensitive"), F.lit("Does not require feature scaling.")),
        F.when(sc >= 85, F.lit("Strong fit for this dataset's profile."))
         .when(sc >= 70, F.lit("Good fit with minor preprocessing recommended."))
         .otherwise(F.lit("Usable but consider addressing data quality issues first.")))
    w = Window.partitionBy("dataset").orderBy(F.desc("score"), "algo_idx")
    return (scored.withColumn("reason", reason)
                  .withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= top)
                  .select("dataset", "rank", "algo_idx", "name", "category", "complexity", "score",
                          "pros", "cons", "reason"))
