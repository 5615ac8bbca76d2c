"""DuckDB restatements of the registered queries (the correctness oracle).

The SQL is generated per table from the static schemas of the driver tables
(FIXTURES.md section 1) and written independently of the Spark plans: plain
aggregates, ``quantile_cont``, ``covar_pop`` and window functions over the
pre-registered views.  Column drops (P1) are decided inside SQL, so no data
fact is baked into the text.
"""

from __future__ import annotations

# Fixed values, written out here on purpose: the oracle shares nothing with
# the package it checks.
MISSING_DROP_THRESH, MISSING_WARN_THRESH = 0.60, 0.05
HIGH_CARDINALITY_RATIO, CLASS_IMBALANCE_RATIO, CORR_HIGH_THRESH = 0.95, 4.0, 0.85
OUTLIER_IQR_FACTOR, MIN_IQR_VALUES, OUTLIER_FLAG_PCT, CV_LIMIT = 1.5, 4, 10.0, 3.0
TOP_CORRELATIONS, CLASSIFICATION_MAX_CLASSES, REGRESSION_MIN_NUMERIC, SCORE_FLOOR = 30, 20, 5, 10
# idx: name, complexity, min rows, max rows, missing, outliers, imbalance ok,
# scale-sensitive, problem types, base score
ALGORITHMS = [
    ("Random Forest", "medium", 100, None, True, True, True, False, "classification,regression", 80),
    ("Gradient Boosting (XGBoost / LightGBM)", "medium", 500, None, True, True, True, False, "classification,regression", 90),
    ("Logistic Regression", "low", 50, None, False, False, True, True, "classification", 70),
    ("Support Vector Machine (SVM)", "high", 50, 50000, False, False, False, True, "classification", 65),
    ("K-Nearest Neighbours (KNN)", "low", 10, 20000, False, False, False, True, "classification,regression", 55),
    ("Decision Tree", "low", 50, None, False, True, False, False, "classification,regression", 60),
    ("Linear Regression / Ridge / Lasso", "low", 30, None, False, False, False, True, "regression", 72),
    ("K-Means Clustering", "low", 100, None, False, False, False, True, "clustering", 65),
    ("Neural Network (MLP)", "high", 5000, None, False, False, True, True, "classification,regression", 75),
    ("Naive Bayes", "low", 20, None, False, True, False, False, "classification", 58),
]
INTENT_WORDS = [
    ("health", ("health", "score", "quality", "overall")), ("missing", ("missing", "null", "empty", "nan")),
    ("duplicate", ("duplicate", "repeat")), ("outlier", ("outlier", "anomal")), ("bias", ("bias", "imbalance", "fair")),
    ("recommend", ("recommend", "suggest", "action", "fix", "improve", "next step")), ("column", ("column", "feature", "field")),
    ("dropped", ("drop", "remov", "exclud")), ("model", ("classif", "regression", "algorithm", "model", "ml")), ("correlation", ("correlat",)),
]
DIRTY_BODY = """
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
         l_extendedprice * 1.1 + l_quantity AS gross,
         CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_discount END AS l_discount,
         CASE WHEN l_orderkey % 10 < 7 THEN NULL ELSE l_tax END AS l_tax,
         CASE WHEN l_orderkey % 97 = 0 THEN l_quantity * 1000 ELSE l_quantity END AS spiky,
         CASE WHEN l_orderkey % 8 = 0 THEN l_quantity + 500 ELSE l_quantity END AS noisy,
         CASE WHEN l_suppkey % 100 = 1 THEN 'rare' ELSE 'common' END AS klass,
         CAST(1 AS DOUBLE) AS konst,
         l_returnflag
  FROM lineitem"""

N, S, O = "numeric", "categorical", "other"

# The driver tables' column names and kinds (FIXTURES.md §1).
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", N), ("r_name", S)],
    "nation": [("n_nationkey", N), ("n_name", S), ("n_regionkey", N)],
    "customer": [("c_custkey", N), ("c_name", S), ("c_nationkey", N), ("c_acctbal", N), ("c_mktsegment", S)],
    "supplier": [("s_suppkey", N), ("s_name", S), ("s_nationkey", N), ("s_acctbal", N)],
    "part": [("p_partkey", N), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", N),
             ("p_retailprice", N)],
    "orders": [("o_orderkey", N), ("o_custkey", N), ("o_orderstatus", S), ("o_totalprice", N),
               ("o_orderdate", O), ("o_orderpriority", S)],
    "lineitem": [("l_orderkey", N), ("l_partkey", N), ("l_suppkey", N), ("l_linenumber", N),
                 ("l_quantity", N), ("l_extendedprice", N), ("l_discount", N), ("l_tax", N),
                 ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", O)],
    "events": [("event_id", N), ("ts", O), ("user_id", N), ("event_type", S), ("value", N), ("props", S)],
    "documents": [("doc_id", N), ("text", S), ("lang", S), ("source", S), ("n_chars", N)],
    "embeddings": [("vec_id", N), ("embedding", O), ("label", N)],
    "pages": [("page_id", N), ("url", S), ("html", S)],
    "benchmark": [("item_id", N), ("text", S)],
    "labels": [("doc_id", N), ("quality", N), ("toxic", N)],
    "conversations": [("conv_id", N), ("turn", N), ("role", S), ("text", S)],
    "dirty": [("l_orderkey", N), ("l_linenumber", N), ("l_quantity", N), ("l_extendedprice", N),
              ("gross", N), ("l_discount", N), ("l_tax", N), ("spiky", N), ("noisy", N),
              ("klass", S), ("konst", N), ("l_returnflag", S)],
}
DRIVER_TABLES = [t for t in SCHEMAS if t != "dirty"]

# Nested columns: their text form differs between engines (float formatting),
# so top-value listings skip them on both sides.
NESTED = {("embeddings", "embedding")}

DIRTY_CTE = (f"dirty_b AS ({DIRTY_BODY}),\n"
             "dirty AS (SELECT * FROM dirty_b UNION ALL SELECT * FROM dirty_b WHERE l_orderkey % 50 = 0)")


def D(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def R(x: str, k: int) -> str:
    """Python ``round(x, k)`` on a double in DuckDB (same method as the
    Spark helper: exact product error decides ties).  ``x`` must be a plain
    column reference or a cheap expression."""
    if k == 0:
        return f"round_even({x}, 0)"
    p = D(float(10 ** k))
    s = D(134217729.0)
    y = f"({x} * {p})"
    hi = f"(({x} * {s}) - (({x} * {s}) - {x}))"
    err = f"((({hi} * {p}) - {y}) + (({x} - {hi}) * {p}))"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN abs({y}) >= 9007199254740992 THEN {x} "
            f"WHEN {y} - floor({y}) <> 0.5 THEN round_even({y}, 0) / {p} "
            f"WHEN {err} > 0 THEN (floor({y}) + 1) / {p} "
            f"WHEN {err} < 0 THEN floor({y}) / {p} "
            f"ELSE round_even({y}, 0) / {p} END)")


def q(name: str) -> str:
    return f'"{name}"'


# ---------------------------------------------------------------------------
# per-table CTEs
# ---------------------------------------------------------------------------
def cols_cte(t: str) -> str:
    """{t}_cols: (pos, name, kind, total_rows, nulls, uniq, mean_raw, std_raw,
    min_raw, max_raw, ratio, dropped, missing_pct)."""
    parts = []
    for i, (c, k) in enumerate(SCHEMAS[t]):
        col = q(c)
        num = k == N
        v = f"CAST({col} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS pos, '{c}' AS name, '{k}' AS kind, count(*) AS total_rows, "
            f"count(*) - count({col}) AS nulls, "
            f"count(DISTINCT {col}) + max(CASE WHEN {col} IS NULL THEN 1 ELSE 0 END) AS uniq, "
            f"{'avg(' + v + ')' if num else 'CAST(NULL AS DOUBLE)'} AS mean_raw, "
            f"{'stddev_pop(' + v + ')' if num else 'CAST(NULL AS DOUBLE)'} AS std_raw, "
            f"{'min(' + v + ')' if num else 'CAST(NULL AS DOUBLE)'} AS min_raw, "
            f"{'max(' + v + ')' if num else 'CAST(NULL AS DOUBLE)'} AS max_raw "
            f"FROM {t}")
    body = " UNION ALL ".join(parts)
    return (f"{t}_c0 AS ({body}),\n"
            f"{t}_c1 AS (SELECT *, CASE WHEN total_rows > 0 THEN CAST(nulls AS DOUBLE) / CAST(total_rows AS DOUBLE) "
            f"ELSE 0.0 END AS ratio, CASE WHEN total_rows > 0 THEN CAST(nulls AS DOUBLE) / CAST(total_rows AS DOUBLE) "
            f"* {D(100.0)} ELSE 0.0 END AS mp_raw FROM {t}_c0),\n"
            f"{t}_cols AS (SELECT *, ratio > {D(MISSING_DROP_THRESH)} AS dropped, {R('mp_raw', 2)} AS missing_pct, "
            f"{R('mean_raw', 6)} AS mean6, {R('std_raw', 6)} AS std6 FROM {t}_c1)")


def _dropped(t: str, c: str) -> str:
    return f"(SELECT dropped FROM {t}_cols WHERE name = '{c}')"


def out_cte(t: str) -> str:
    """{t}_out: (pos, n, q1, q3, outlier_count, outlier_pct) per numeric column."""
    parts = []
    for i, (c, k) in enumerate(SCHEMAS[t]):
        if k != N:
            continue
        v = f"CAST({q(c)} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS pos, count(*) AS n, list_sort(list(x)) AS xs "
            f"FROM (SELECT {v} AS x FROM {t} WHERE {q(c)} IS NOT NULL AND NOT isnan({v}))")
    if not parts:
        return f"{t}_out AS (SELECT 0 AS pos, 0 AS n, 0.0 AS q1, 0.0 AS q3, 0 AS outlier_count, 0.0 AS outlier_pct WHERE false)"
    hits = []
    for i, (c, k) in enumerate(SCHEMAS[t]):
        if k != N:
            continue
        v = f"CAST({q(c)} AS DOUBLE)"
        hits.append(
            f"SELECT {i} AS pos, count(*) FILTER (WHERE {v} < f.lo OR {v} > f.hi) AS hits "
            f"FROM {t}, (SELECT lo, hi FROM {t}_f WHERE pos = {i}) f WHERE NOT isnan({v})")
    # numpy.percentile (linear): order statistics at floor(h) and floor(h)+1,
    # h = (n-1)p, combined with numpy's two-sided lerp.
    def qs(p):
        h = f"(CAST(n - 1 AS DOUBLE) * {D(p)})"
        a = f"xs[CAST(floor({h}) AS BIGINT) + 1]"
        b = f"xs[CAST(least(floor({h}) + 1, n - 1) AS BIGINT) + 1]"
        fr = f"({h} - floor({h}))"
        return (f"CASE WHEN n = 0 THEN NULL WHEN {fr} >= 0.5 THEN {b} - ({b} - {a}) * (1.0 - {fr}) "
                f"ELSE {a} + ({b} - {a}) * {fr} END")
    return (f"{t}_q0 AS ({' UNION ALL '.join(parts)}),\n"
            f"{t}_q AS (SELECT pos, n, {qs(0.25)} AS q1, {qs(0.75)} AS q3 FROM {t}_q0),\n"
            f"{t}_f AS (SELECT pos, n, q1, q3, q1 - {D(OUTLIER_IQR_FACTOR)} * (q3 - q1) AS lo, "
            f"q3 + {D(OUTLIER_IQR_FACTOR)} * (q3 - q1) AS hi, "
            f"(n >= {MIN_IQR_VALUES} AND q3 - q1 <> 0) AS usable FROM {t}_q),\n"
            f"{t}_h AS ({' UNION ALL '.join(hits)}),\n"
            f"{t}_o0 AS (SELECT f.pos, f.n, f.q1, f.q3, CASE WHEN f.usable THEN h.hits ELSE 0 END AS outlier_count, "
            f"CASE WHEN f.usable THEN CAST(h.hits AS DOUBLE) / CAST(f.n AS DOUBLE) * {D(100.0)} ELSE 0.0 END AS op_raw "
            f"FROM {t}_f f JOIN {t}_h h USING (pos)),\n"
            f"{t}_out AS (SELECT pos, n, q1, q3, outlier_count, {R('op_raw', 2)} AS outlier_pct FROM {t}_o0 "
            f"WHERE NOT {_dropped_pos(t)})")


def _dropped_pos(t: str) -> str:
    return f"(SELECT dropped FROM {t}_cols c WHERE c.pos = {t}_o0.pos)"


def imb_cte(t: str) -> str:
    """{t}_imb: (pos, column, n_classes, max_count, min_count, ratio, majority_pct)."""
    parts = []
    for i, (c, k) in enumerate(SCHEMAS[t]):
        if k != S:
            continue
        parts.append(
            f"SELECT {i} AS pos, '{c}' AS \"column\", count(*) AS n_classes, max(cnt) AS max_count, min(cnt) AS min_count "
            f"FROM (SELECT {q(c)} AS v, count(*) AS cnt FROM {t} WHERE {q(c)} IS NOT NULL GROUP BY 1)")
    if not parts:
        return (f"{t}_imb AS (SELECT 0 AS pos, '' AS \"column\", 0 AS n_classes, 0 AS max_count, 0 AS min_count, "
                f"0.0 AS ratio, 0.0 AS majority_pct WHERE false)")
    return (f"{t}_i0 AS ({' UNION ALL '.join(parts)}),\n"
            f"{t}_i1 AS (SELECT i.*, CAST(max_count AS DOUBLE) / CAST(min_count AS DOUBLE) AS ratio, "
            f"CAST(max_count AS DOUBLE) / CAST((SELECT max(total_rows) FROM {t}_cols) AS DOUBLE) * {D(100.0)} AS mj_raw "
            f"FROM {t}_i0 i WHERE n_classes >= 2 AND NOT (SELECT dropped FROM {t}_cols c WHERE c.pos = i.pos)),\n"
            f"{t}_imb AS (SELECT pos, \"column\", n_classes, max_count, min_count, ratio, {R('mj_raw', 1)} AS majority_pct "
            f"FROM {t}_i1)")


def corr_cte(t: str) -> str:
    """{t}_corr: (rank, i, j, col1, col2, value) - top 30 by |value|."""
    num = [(i, c) for i, (c, k) in enumerate(SCHEMAS[t]) if k == N]
    if len(num) < 2:
        return (f"{t}_corr AS (SELECT 0 AS rank, 0 AS i, 0 AS j, '' AS col1, '' AS col2, 0.0 AS value "
                f"WHERE false)")
    keep = " AND ".join(
        f"({_dropped(t, c)} OR ({q(c)} IS NOT NULL AND NOT isnan(CAST({q(c)} AS DOUBLE))))" for _, c in num)
    sel = ", ".join(f"CAST({q(c)} AS DOUBLE) AS v{i}" for i, c in num)
    pairs = []
    for a in range(len(num)):
        for b in range(a + 1, len(num)):
            (i, ci), (j, cj) = num[a], num[b]
            pairs.append(
                f"SELECT {i} AS i, {j} AS j, '{ci}' AS col1, '{cj}' AS col2, "
                f"CASE WHEN min(v{i}) < max(v{i}) AND min(v{j}) < max(v{j}) "
                f"THEN covar_pop(v{i}, v{j}) / (stddev_pop(v{i}) * stddev_pop(v{j})) END AS r "
                f"FROM {t}_cc WHERE NOT {_dropped(t, ci)} AND NOT {_dropped(t, cj)}")
    return (f"{t}_cc AS (SELECT {sel} FROM {t} WHERE {keep}),\n"
            f"{t}_p AS ({' UNION ALL '.join(pairs)}),\n"
            f"{t}_p1 AS (SELECT i, j, col1, col2, {R('r', 4)} AS value FROM {t}_p WHERE r IS NOT NULL AND NOT isnan(r)),\n"
            f"{t}_corr AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY abs(value) DESC, i, j) AS rank, * "
            f"FROM {t}_p1) WHERE rank <= {TOP_CORRELATIONS})")


def dup_cte(t: str) -> str:
    """{t}_dup: duplicate rows after the drop (a dropped column is replaced
    by NULL, which removes it from the comparison)."""
    sel = ", ".join(f"CASE WHEN {_dropped(t, c)} THEN NULL ELSE {q(c)} END" for c, _ in SCHEMAS[t])
    return (f"{t}_dup AS (SELECT (SELECT count(*) FROM {t}) - "
            f"(SELECT count(*) FROM (SELECT DISTINCT {sel} FROM {t})) AS duplicate_rows)")


def flags_cte(t: str) -> str:
    """{t}_flags: (seq, rule_id, column, value)."""
    col = lambda name: f"'Column ''' || {name} || ''''"
    return f"""{t}_fl0 AS (
  SELECT 0 AS grp, pos, 0 AS sub, 'F1' AS rule_id, name AS "column", CAST(uniq AS DOUBLE) AS value,
    {col('name')} || ' has very high cardinality (' || format('{{:,}}', uniq) || ' unique values out of ' || format('{{:,}}', total_rows)
      || ' rows). This looks like an ID or key column — exclude it from model features.' AS message
    FROM {t}_cols WHERE NOT dropped AND total_rows > 0
     AND CAST(uniq AS DOUBLE) / CAST(total_rows AS DOUBLE) > {D(HIGH_CARDINALITY_RATIO)}
  UNION ALL
  SELECT 0, pos, 1, 'F2', name, missing_pct, {col('name')} || ' is ' || printf('%.1f', missing_pct)
      || '% missing. Consider imputation (median for numeric, mode or ''Unknown'' for categorical) before modeling.'
    FROM {t}_cols WHERE NOT dropped
     AND missing_pct > {D(MISSING_WARN_THRESH * 100)} AND missing_pct < {D(MISSING_DROP_THRESH * 100)}
  UNION ALL
  SELECT 0, pos, 2, 'F3', name, std6 / abs(mean6), {col('name')} || ' has very high coefficient of variation (' || printf('%.1f', std6 / abs(mean6))
      || '). The distribution is highly spread — consider log or box-cox transform.'
    FROM {t}_cols WHERE NOT dropped AND kind = 'numeric'
     AND std6 IS NOT NULL AND std6 > 0 AND abs(mean6) > 0 AND std6 / abs(mean6) > {D(CV_LIMIT)}
  UNION ALL
  SELECT 0, o.pos, 3, 'F4', c.name, o.outlier_pct, {col('c.name')} || ' has ' || printf('%.1f', o.outlier_pct)
      || '% outliers (IQR method). Inspect these rows — they may be data entry errors or genuine anomalies.'
    FROM {t}_out o JOIN {t}_cols c USING (pos)
   WHERE o.outlier_pct > {D(OUTLIER_FLAG_PCT)}
  UNION ALL
  SELECT 1, rank, 0, 'F5', col1 || '~' || col2, value, 'Columns ''' || col1 || ''' and ''' || col2 || ''' are highly correlated (r = ' || printf('%.3f', value)
      || '). Consider removing one to reduce multicollinearity in linear models.'
    FROM {t}_corr WHERE abs(value) >= {D(CORR_HIGH_THRESH)}
  UNION ALL
  SELECT 2, pos, 0, 'F6', "column", ratio, {col('"column"')} || ' has severe class imbalance: the dominant class represents ' || printf('%.1f', majority_pct)
      || '% of rows (imbalance ratio ' || printf('%.1f', ratio) || '×). Consider oversampling (SMOTE) or class weighting before classification.'
    FROM {t}_imb WHERE ratio >= {D(CLASS_IMBALANCE_RATIO)}),
{t}_flags AS (SELECT row_number() OVER (ORDER BY grp, pos, sub) AS seq, rule_id, "column", value, message FROM {t}_fl0)"""


def facts_cte(t: str) -> str:
    """{t}_facts: one row of report facts, scores and advisor inputs."""
    return f"""{t}_s0 AS (
  SELECT '{t}' AS dataset,
         (SELECT max(total_rows) FROM {t}_cols) AS total_rows,
         (SELECT count(*) FROM {t}_cols WHERE NOT dropped) AS total_columns,
         (SELECT CAST(floor(coalesce(sum(missing_pct / {D(100.0)} * CAST(total_rows AS DOUBLE)), 0)) AS BIGINT)
            FROM {t}_cols WHERE NOT dropped) AS missing_cells,
         (SELECT coalesce(sum(nulls), 0) FROM {t}_cols WHERE NOT dropped) AS missing_cells_exact,
         (SELECT duplicate_rows FROM {t}_dup) AS duplicate_rows,
         (SELECT coalesce(sum(outlier_count), 0) FROM {t}_out) AS outlier_count,
         (SELECT count(*) FROM {t}_cols WHERE dropped) AS dropped_count,
         (SELECT count(*) FROM {t}_flags) AS flag_count,
         (SELECT count(*) FROM {t}_cols WHERE NOT dropped AND kind = 'numeric' AND mean_raw IS NOT NULL) AS n_numeric,
         (SELECT count(*) FROM {t}_cols WHERE NOT dropped AND kind <> 'numeric' AND uniq <= {CLASSIFICATION_MAX_CLASSES}) AS n_target,
         (SELECT count(*) FROM {t}_flags WHERE rule_id = 'F6') > 0 AS has_imbalance,
         (SELECT count(*) FROM {t}_corr WHERE abs(value) >= {D(CORR_HIGH_THRESH)}) > 0 AS has_high_corr),
{t}_s1 AS (
  SELECT *, CASE WHEN total_rows * total_columns > 0
                 THEN CAST(missing_cells AS DOUBLE) / CAST(total_rows * total_columns AS DOUBLE) * {D(100.0)}
                 ELSE 0.0 END AS mpct_raw FROM {t}_s0),
{t}_s2 AS (SELECT *, {R('mpct_raw', 2)} AS missing_pct FROM {t}_s1),
{t}_s3 AS (
  SELECT *,
    CASE WHEN total_rows > 0 THEN CAST(duplicate_rows AS DOUBLE) / CAST(total_rows AS DOUBLE) ELSE 0.0 END * {D(100.0)} AS dup_pct,
    CASE WHEN total_rows > 0 THEN CAST(outlier_count AS DOUBLE) / CAST(total_rows AS DOUBLE) ELSE 0.0 END * {D(100.0)} AS out_pct
  FROM {t}_s2),
{t}_s4 AS (
  SELECT *,
    {D(100.0)} - least({D(25.0)}, missing_pct * {D(2.0)}) - least({D(20.0)}, dup_pct * {D(4.0)})
      - least({D(15.0)}, out_pct * {D(1.5)}) - least({D(20.0)}, CAST(dropped_count AS DOUBLE) * {D(5.0)})
      - least({D(20.0)}, CAST(flag_count AS DOUBLE) * {D(4.0)}) AS raw_health,
    greatest({D(0.0)}, {D(100.0)} - missing_pct * {D(2.0)}) AS cs_raw,
    greatest({D(0.0)}, {D(100.0)} - CAST(duplicate_rows AS DOUBLE) / CAST(greatest(total_rows, 1) AS DOUBLE) * {D(100.0)} * {D(4.0)}) AS ks_raw,
    greatest({D(0.0)}, {D(100.0)} - CAST(outlier_count AS DOUBLE) / CAST(greatest(total_rows, 1) AS DOUBLE) * {D(100.0)} * {D(1.5)}) AS ns_raw
  FROM {t}_s3),
{t}_facts AS (
  SELECT *, CAST(greatest({SCORE_FLOOR}, round_even(raw_health, 0)) AS INTEGER) AS health_score,
    {R('cs_raw', 1)} AS completeness_score,
    CASE WHEN total_rows > 0 THEN {R('ks_raw', 1)} ELSE 100.0 END AS consistency_score,
    CASE WHEN total_rows > 0 THEN {R('ns_raw', 1)} ELSE 100.0 END AS noise_score,
    CASE WHEN n_target > 0 THEN 'classification' WHEN n_numeric = 0 THEN 'clustering'
         WHEN n_numeric >= {REGRESSION_MIN_NUMERIC} THEN 'regression' ELSE 'clustering' END AS problem_type
  FROM {t}_s4)"""


def table_ctes(t: str, parts=("cols", "out", "imb", "corr", "dup", "flags", "facts")) -> list[str]:
    gen = {"cols": cols_cte, "out": out_cte, "imb": imb_cte, "corr": corr_cte, "dup": dup_cte,
           "flags": flags_cte, "facts": facts_cte}
    out = [gen[p](t) for p in parts]
    return out


def with_ctes(ctes: list[str], tables: list[str], body: str) -> str:
    pre = [DIRTY_CTE] if "dirty" in tables else []
    return "WITH " + ",\n".join(pre + ctes) + "\n" + body
