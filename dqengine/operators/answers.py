"""Rule-based question answering over reports (Q1-Q5), batch form.

A table of questions is joined to the report context of its dataset (J3,
an equi-join), the intent is the first keyword list that matches (Q1), and
the answer is the template of that intent (Q2).  Everything per dataset that
the templates list (worst columns, top flags, ...) is pre-formatted once
from the small report tables, so answering is a single projection per
question row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalar import ellipsis_join, fmt_fixed, fmt_int, quoted

# Intents and their keywords, in matching order.
INTENTS = [
    ("health", ["health", "score", "quality", "overall"]),
    ("missing", ["missing", "null", "empty", "nan"]),
    ("duplicate", ["duplicate", "repeat"]),
    ("outlier", ["outlier", "anomal"]),
    ("bias", ["bias", "imbalance", "fair"]),
    ("recommend", ["recommend", "suggest", "action", "fix", "improve", "next step"]),
    ("column", ["column", "feature", "field"]),
    ("dropped", ["drop", "remov", "exclud"]),
    ("model", ["classif", "regression", "algorithm", "model", "ml"]),
    ("correlation", ["correlat"]),
]
DEFAULT_INTENT = "default"


def intent(question: Column) -> Column:
    """Q1: the first intent whose keyword occurs in the lower-cased text."""
    q = F.lower(F.coalesce(question, F.lit("")))
    expr = None
    for name, words in INTENTS:
        cond = None
        for w in words:
            c = q.contains(w)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(DEFAULT_INTENT))


def answer_context(summary: DataFrame, columns: DataFrame, correlations: DataFrame,
                   flags: DataFrame, recs: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row per dataset with every list a template needs, pre-formatted."""
    w_miss = Window.partitionBy("dataset").orderBy(F.desc("missing_pct"), "pos")
    miss = (columns.withColumn("r", F.row_number().over(w_miss)).where((F.col("r") <= 3) & (F.col("missing_pct") > 0))
            .select("dataset", "r", F.concat(quoted(F.col("name")), F.lit(" ("), fmt_fixed(F.col("missing_pct"), 1),
                                             F.lit("%)")).alias("s"))
            .groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("r", "s"))).alias("miss")))
    w_out = Window.partitionBy("dataset").orderBy(F.desc("outlier_pct"), "pos")
    outl = (columns.where(F.coalesce("outlier_pct", F.lit(0.0)) > 0)
            .withColumn("r", F.row_number().over(w_out)).where(F.col("r") <= 3)
            .select("dataset", "r", F.concat(quoted(F.col("name")), F.lit(" ("), fmt_fixed(F.col("outlier_pct"), 1),
                                             F.lit("%)")).alias("s"))
            .groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("r", "s"))).alias("outl")))
    kinds = columns.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_cols"),
        F.array_sort(F.collect_list(F.when(F.col("mean").isNotNull(), F.struct("pos", "name")))).alias("num"),
        F.array_sort(F.collect_list(F.when(F.col("top_values").isNotNull(), F.struct("pos", "name")))).alias("cat"))
    corr = (correlations.where(F.col("rank") <= 3)
            .select("dataset", "rank", F.concat("col1", F.lit(" ↔ "), "col2", F.lit(" (r="),
                                                fmt_fixed(F.col("value"), 3), F.lit(")")).alias("s"))
            .groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("rank", "s"))).alias("corr")))
    fl = (flags.where(F.col("seq") <= 5).groupBy("dataset")
          .agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("fl")),
          flags.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_flags")))
    rc = (recs.where((F.col("seq") <= 5)).groupBy("dataset")
          .agg(F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("rc")))
    dr = dropped.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "reason"))).alias("dr"))
    ctx = summary
    for t in (miss, outl, kinds, corr, fl[0], fl[1], rc, dr):
        ctx = ctx.join(t, "dataset", "left")

    def texts(arr: str, f: str = "s") -> Column:
        return F.transform(F.coalesce(F.col(arr), F.array()), lambda x: x[f])

    names_num = F.filter(F.transform(F.coalesce("num", F.array()), lambda x: x["name"]), lambda x: x.isNotNull())
    names_cat = F.filter(F.transform(F.coalesce("cat", F.array()), lambda x: x["name"]), lambda x: x.isNotNull())
    return ctx.select(
        "dataset", "health_score", "total_rows", "total_columns", "missing_pct", "duplicate_rows",
        "outlier_count",
        F.array_join(texts("miss"), ", ").alias("miss_list"),
        F.array_join(texts("outl"), ", ").alias("outlier_list"),
        F.coalesce("n_cols", F.lit(0)).alias("n_cols"),
        names_num.alias("numeric_names"), names_cat.alias("categorical_names"),
        F.array_join(texts("corr"), "; ").alias("corr_list"),
        F.coalesce("n_flags", F.lit(0)).alias("n_flags"),
        F.array_join(F.transform(texts("fl", "message"), lambda m: F.concat(F.lit("• "), m)), "\n").alias("flag_lines"),
        F.array_join(F.transform(F.coalesce(F.col("rc"), F.array()),
                                 lambda x: F.concat(x["seq"].cast("string"), F.lit(". "), x["message"])), "\n")
        .alias("rec_lines"),
        F.size(F.coalesce("rc", F.array())).alias("n_recs"),
        F.array_join(F.transform(F.coalesce(F.col("dr"), F.array()),
                                 lambda d: F.concat(F.lit("• "), quoted(d["name"]), F.lit(": "), d["reason"])), "\n")
        .alias("dropped_lines"),
        F.size(F.coalesce("dr", F.array())).alias("n_dropped"))


def answer(intent_col: Column, name: Column) -> Column:
    """Q2 over a row that carries the answer context columns."""
    score, rows, cols = F.col("health_score"), F.col("total_rows"), F.col("total_columns")
    mp, dup, outl = F.col("missing_pct"), F.col("duplicate_rows"), F.col("outlier_count")
    verdict = F.when(score >= 80, "high").when(score >= 60, "moderate").otherwise("poor")
    num, cat = F.col("numeric_names"), F.col("categorical_names")
    # The answer templates, in intent order.
    health = F.concat(
        F.lit("The dataset '"), name, F.lit("' has a health score of "), score.cast("string"),
        F.lit("/100, indicating "), verdict, F.lit(" overall quality. It contains "), fmt_int(rows),
        F.lit(" rows and "), cols.cast("string"), F.lit(" columns. Missing data is "), fmt_fixed(mp, 1),
        F.lit("%, there are "), fmt_int(dup), F.lit(" duplicate rows, and "), fmt_int(outl),
        F.lit(" outlier values were detected across numeric columns."))
    missing = F.when(F.col("miss_list") != "", F.concat(
        F.lit("Overall, "), fmt_fixed(mp, 1), F.lit("% of cells are missing. The columns with the most missing data are: "),
        F.col("miss_list"), F.lit(". Consider median imputation for numeric columns and mode/unknown-category for "
                                  "categorical ones."))).otherwise(F.concat(
        F.lit("Overall missing data is "), fmt_fixed(mp, 1), F.lit("%, which is within acceptable limits.")))
    duplicate = F.when(dup == 0, F.lit("No duplicate rows were found in this dataset.")).otherwise(F.concat(
        fmt_int(dup), F.lit(" duplicate rows were detected ("),
        fmt_fixed(dup.cast("double") / rows.cast("double") * F.lit(100.0), 1),
        F.lit("% of total). Remove them before training to prevent data leakage and inflated accuracy metrics.")))
    outlier = F.when(outl == 0, F.lit("No significant outliers were detected in numeric columns.")).otherwise(
        F.concat(fmt_int(outl), F.lit(" outlier values were detected. Columns most affected: "),
                 F.col("outlier_list"), F.lit(". Use IQR capping (clip to 1st/99th percentile) or RobustScaler "
                                              "before training.")))
    bias = F.when(F.col("n_flags") == 0, F.lit(
        "No significant bias or class imbalance was detected in this dataset.")).otherwise(
        F.concat(F.lit("Bias flags detected:\n"), F.col("flag_lines")))
    recommend = F.when(F.col("n_recs") > 0, F.concat(
        F.lit("Here are the top recommendations for this dataset:\n"), F.col("rec_lines"))).otherwise(
        F.lit("No critical issues — the dataset appears ready for feature engineering."))
    column = F.concat(
        F.lit("The dataset has "), F.col("n_cols").cast("string"), F.lit(" columns after cleaning. Numeric columns ("),
        F.size(num).cast("string"), F.lit("): "), ellipsis_join(num, 8), F.lit(". Categorical columns ("),
        F.size(cat).cast("string"), F.lit("): "), ellipsis_join(cat, 8), F.lit("."))
    dropped = F.when(F.col("n_dropped") == 0, F.lit(
        "No columns were dropped. All columns had acceptable missing data rates.")).otherwise(
        F.concat(F.lit("Dropped columns and reasons:\n"), F.col("dropped_lines")))
    model = F.concat(
        F.lit("Based on the dataset profile ("), fmt_int(rows), F.lit(" rows, "), cols.cast("string"),
        F.lit(" columns, "), fmt_fixed(mp, 1), F.lit("% missing), I recommend switching to the 'Algo Advisor' tab "
                                                     "for a full ranked list of algorithms with explanations tailored "
                                                     "to this dataset."))
    correlation = F.when(F.col("corr_list") == "", F.lit(
        "No significant correlations were found between numeric columns.")).otherwise(F.concat(
        F.lit("Top correlations found: "), F.col("corr_list"), F.lit(
            ". Strong correlations (|r| > 0.85) may cause multicollinearity in linear models — consider dropping one "
            "column from each highly-correlated pair.")))
    default = F.concat(
        F.lit("The dataset '"), name, F.lit("' has "), fmt_int(rows), F.lit(" rows, "), cols.cast("string"),
        F.lit(" columns, and a health score of "), score.cast("string"), F.lit(
            "/100. You can ask me about: missing data, duplicates, outliers, correlations, bias flags, dropped "
            "columns, or recommendations."))
    by = {"health": health, "missing": missing, "duplicate": duplicate, "outlier": outlier, "bias": bias,
          "recommend": recommend, "column": column, "dropped": dropped, "model": model,
          "correlation": correlation}
    out = None
    for k, v in by.items():
        out = F.when(intent_col == k, v) if out is None else out.when(intent_col == k, v)
    return out.otherwise(default)


def answer_batch(questions: DataFrame, context: DataFrame) -> DataFrame:
    """Q5 minus the append: questions (..., dataset, question) joined to the
    answer context of their dataset (J3), then Q1 + Q2.  The context has one
    row per dataset, so AQE broadcasts it; nothing assumes its size."""
    j = questions.join(context, "dataset")
    j = j.withColumn("intent", intent(F.col("question")))
    return j.select(*questions.columns, "intent", answer(F.col("intent"), F.col("dataset")).alias("answer"))


# -- Q4 ------------------------------------------------------------------------
_FENCE = r"^```[a-zA-Z0-9_-]*\s*([\s\S]*?)\s*```$"
# what Python's str.strip takes for blanks
_BLANKS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
_TRIM = f"^{_BLANKS}|{_BLANKS}$"


def clean_text(text: Column) -> Column:
    """Q4: trim; unwrap one surrounding code fence; drop stray fences."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _TRIM, "")
    unwrapped = F.when(t.rlike(_FENCE), F.regexp_replace(F.regexp_extract(t, _FENCE, 1), _TRIM, "")).otherwise(t)
    return F.regexp_replace(F.replace(unwrapped, F.lit("```"), F.lit("")), _TRIM, "")


# -- P9 + Q3 -------------------------------------------------------------------
def compact_report(reports: DataFrame, max_chars: int = C.REPORT_CONTEXT_CHARS) -> DataFrame:
    """Q3: the largest truncated report JSON that fits ``max_chars``.

    P9 keeps 7 fields (+ name) and slices the lists to 20/20/20/10.  Then the
    reference drops the last element of the longer of columns/correlations
    (columns on ties) until it fits; that sequence is closed-form, so every
    step's JSON is built with ``transform(sequence(...))`` and the first that
    fits is taken; later tiers: 5+5 texts with ``truncated``, then four
    fields.  Sizes are Spark ``to_json`` lengths (D9)."""
    budget = max(C.REPORT_CONTEXT_FLOOR, max_chars)
    opts = {"ignoreNullFields": "false"}
    r = reports.select(
        "dataset", "health_score", "missing_pct", "duplicate_rows",
        F.slice("bias_flags", 1, 20).alias("bf"), F.slice("recommendations", 1, 20).alias("rc"),
        F.slice("columns", 1, 20).alias("cl"), F.slice("correlations", 1, 10).alias("cr"))
    nc, nk = F.size("cl"), F.size("cr")
    m, d = F.least(nc, nk), F.abs(nc - nk)

    def at(s: Column):
        t = s - d
        big_c = nc >= nk
        c_pre = F.when(big_c, nc - s).otherwise(nc)
        k_pre = F.when(big_c, nk).otherwise(nk - s)
        c_alt = m - F.ceil(t / 2).cast("int")
        k_alt = m - F.floor(t / 2).cast("int")
        return (F.when(s <= d, c_pre).otherwise(c_alt), F.when(s <= d, k_pre).otherwise(k_alt))

    def payload(c: Column, k: Column) -> Column:
        return F.to_json(F.struct(
            F.col("health_score"), F.col("missing_pct"), F.col("duplicate_rows"),
            F.col("bf").alias("bias_flags"), F.col("rc").alias("recommendations"),
            F.slice("cl", 1, c).alias("columns"), F.slice("cr", 1, k).alias("correlations"),
            F.col("dataset").alias("dataset_name")), opts)

    steps = F.transform(F.sequence(F.lit(0), nc + nk), lambda s: payload(*at(s)))
    fitting = F.filter(steps, lambda j: F.length(j) <= budget)
    tier1 = F.get(fitting, 0)
    tier2 = F.to_json(F.struct(
        F.col("health_score"), F.col("missing_pct"), F.col("duplicate_rows"),
        F.slice("bf", 1, 5).alias("bias_flags"), F.slice("rc", 1, 5).alias("recommendations"),
        F.array().cast("array<string>").alias("columns"), F.array().cast("array<string>").alias("correlations"),
        F.col("dataset").alias("dataset_name"), F.lit(True).alias("truncated")), opts)
    tier3 = F.to_json(F.struct(F.col("health_score"), F.col("missing_pct"), F.col("duplicate_rows"),
                               F.lit(True).alias("truncated")), opts)
    js = F.coalesce(tier1, F.when(F.length(tier2) <= budget, tier2), tier3)
    tier = (F.when(tier1.isNotNull(), F.lit(1)).when(F.length(tier2) <= budget, F.lit(2)).otherwise(F.lit(3)))
    return r.select("dataset", js.alias("json"), tier.alias("tier"), F.length(js).alias("chars"))
