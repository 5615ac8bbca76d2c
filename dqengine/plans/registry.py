"""Registered queries: Spark callables and their DuckDB oracle SQL.

Every query reads the driver tables (or the ``dirty`` view Spark derives from
lineitem) in full.  Output columns are cast explicitly on both sides so that
schemas match: counts BIGINT, scores INT, measures DOUBLE rounded to 4
places with the same exact Python-style rounding, text STRING/VARCHAR.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import py_round
from ..operators.advisor import advisor_inputs, recommend_algorithms
from ..operators.answers import (answer_batch, answer_context,
                                 clean_text, compact_report, intent)
from ..operators.catalog import (admission, chat_violations, dataset_rows,
                                 delete_cascade, list_datasets, orphans, owned,
                                 summaries)
from ..operators.sketches import DISTINCT_ERROR, add_batch, approximate, merged, state_of, stored_states
from ..operators.views import (column_cards, corr_top15, kpis, missing_top12, no_missing,
                               score_cards, search)
from ..session import stage_dir
from ..sources.files import read_any
from ..sources.tables import TABLES, read_table
from . import oracle as O
from . import stored
from .dirty import dirty
from .oracle_answers import answers
from .report import Profile, at_once, profile_many

ALL = list(TABLES) + ["dirty"]

def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dirty(spark, sf_dir) if name == "dirty" else read_table(spark, sf_dir, name)


def profiles(spark: SparkSession, sf_dir: str, names: list[str]) -> Profile:
    """Profile of ``names``; every query runs its own."""
    return profile_many({n: frame(spark, sf_dir, n) for n in names})


def all_profiles(spark: SparkSession, sf_dir: str) -> Profile:
    return profiles(spark, sf_dir, ALL)


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------
def q_profile(table: str) -> Callable[[SparkSession, str], DataFrame]:
    """Per-column profile of one table."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = profiles(spark, sf_dir, [table]).columns
        return c.select(
            F.col("name").alias("column"), F.col("kind"),
            F.col("null_count").cast("long").alias("null_count"),
            F.col("missing_pct").cast("double").alias("missing_pct"),
            F.col("unique_count").cast("long").alias("unique_count"),
            py_round(F.col("mean_raw"), 4).alias("mean"), py_round(F.col("std_raw"), 4).alias("std"),
            py_round(F.col("min_raw"), 4).alias("min"), py_round(F.col("max_raw"), 4).alias("max"),
            F.col("outlier_count").cast("long").alias("outlier_count"),
            F.col("outlier_pct").cast("double").alias("outlier_pct"))
    return run


def q_dropped_columns(spark, sf_dir):
    """P1 over every table."""
    p = all_profiles(spark, sf_dir)
    return p.dropped.select("dataset", F.col("name").alias("column"),
                            py_round(F.col("missing_ratio"), 4).alias("missing_ratio"))


def q_duplicate_rows(spark, sf_dir):
    """A8 over every table."""
    p = all_profiles(spark, sf_dir)
    return p.base.join(p.duplicates, "dataset").select(
        "dataset", F.col("total_rows").cast("long").alias("total_rows"),
        F.col("duplicate_rows").cast("long").alias("duplicate_rows"))


def q_iqr_outliers(spark, sf_dir):
    """A5, A6, P5, J6 over every numeric column of every table."""
    c = all_profiles(spark, sf_dir).columns.where(F.col("kind") == "numeric")
    return c.select("dataset", F.col("name").alias("column"),
                    F.col("n_valid").cast("long").alias("n"),
                    py_round(F.col("q1"), 4).alias("q1"), py_round(F.col("q3"), 4).alias("q3"),
                    F.col("outlier_count").cast("long").alias("outlier_count"),
                    F.col("outlier_pct").cast("double").alias("outlier_pct"))


def q_top_values(spark, sf_dir):
    """A7, K1 over every non-numeric column of every table."""
    c = all_profiles(spark, sf_dir).columns.where(
        (F.col("kind") != "numeric") & ~F.col("dtype").startswith("array"))
    e = c.select("dataset", F.col("name").alias("column"), F.posexplode("top_values").alias("i", "tv"))
    return e.select("dataset", "column", (F.col("i") + 1).cast("long").alias("rank"),
                    F.col("tv.value").alias("value"), F.col("tv.count").cast("long").alias("count"))


def q_top_correlations(spark, sf_dir):
    """P4, A11, K2, J1 over every table."""
    k = all_profiles(spark, sf_dir).correlations
    return k.select("dataset", F.col("rank").cast("long").alias("rank"), "col1", "col2",
                    F.col("value").cast("double").alias("value"))


def q_class_imbalance(spark, sf_dir):
    """A12 over every string column of every table."""
    i = all_profiles(spark, sf_dir).imbalance
    return i.select("dataset", "column", F.col("n_classes").cast("long").alias("n_classes"),
                    F.col("max_count").cast("long").alias("max_count"),
                    F.col("min_count").cast("long").alias("min_count"),
                    py_round(F.col("ratio"), 4).alias("ratio"),
                    F.col("majority_pct").cast("double").alias("majority_pct"))


def q_bias_flags(spark, sf_dir):
    """F1-F7 over every table."""
    f = all_profiles(spark, sf_dir).flags
    return f.select("dataset", F.col("seq").cast("long").alias("seq"), "rule_id", "column",
                    py_round(F.col("value"), 4).alias("value"), "message")


def q_recommendation_rules(spark, sf_dir):
    """R1-R8 over every table."""
    r = all_profiles(spark, sf_dir).recommendations
    return r.select("dataset", F.col("seq").cast("long").alias("seq"), "rule_id", "message")


def q_health_report(spark, sf_dir):
    """A9, A10, H1, H2 over every table."""
    s = all_profiles(spark, sf_dir).summary
    return s.select(
        "dataset", F.col("total_rows").cast("long").alias("total_rows"),
        F.col("total_columns").cast("long").alias("total_columns"),
        F.col("missing_cells").cast("long").alias("missing_cells"),
        F.col("missing_cells_exact").cast("long").alias("missing_cells_exact"),
        F.col("missing_pct").cast("double").alias("missing_pct"),
        F.col("duplicate_rows").cast("long").alias("duplicate_rows"),
        F.col("outlier_count").cast("long").alias("outlier_count"),
        F.col("flag_count").cast("long").alias("flag_count"),
        F.col("health_score").cast("int").alias("health_score"),
        F.col("completeness_score").cast("double").alias("completeness_score"),
        F.col("consistency_score").cast("double").alias("consistency_score"),
        F.col("noise_score").cast("double").alias("noise_score"))


def _reports(spark, sf_dir) -> DataFrame:
    return all_profiles(spark, sf_dir).reports()


def _catalogue(spark, sf_dir) -> DataFrame:
    """One catalogue row per profiled table, owner 'u1'; ids derived from
    the name so repeated runs agree."""
    rep = _reports(spark, sf_dir)
    return dataset_rows(rep, "u1", ids=F.substring(F.sha2(F.col("dataset"), 256), 1, 32))


def q_algo_recommendations(spark, sf_dir):
    """V1-V6, J2, K5 over the reports of every table."""
    p = all_profiles(spark, sf_dir)
    inp = advisor_inputs(p.summary, p.columns, p.flags, p.correlations)
    r = recommend_algorithms(inp)
    return r.select("dataset", F.col("rank").cast("long").alias("rank"), F.col("name").alias("algorithm"),
                    F.col("score").cast("int").alias("score"), "reason")


def q_catalog_list(spark, sf_dir):
    """S4 + S5 + S15: the owner's catalogue, newest first."""
    lst = list_datasets(_catalogue(spark, sf_dir), "u1")
    return lst.select("name", "status", F.col("rows").cast("long").alias("rows"),
                      F.col("columns").cast("long").alias("columns"),
                      F.col("health_score").cast("int").alias("health_score"))


def q_catalog_kpis(spark, sf_dir):
    """A13 over the catalogue."""
    k = kpis(owned(_catalogue(spark, sf_dir), "u1"))
    return k.select(*[F.col(c).cast("long").alias(c) for c in k.columns])


def q_catalog_search(spark, sf_dir):
    """Names containing 'ER' in any case."""
    return search(owned(_catalogue(spark, sf_dir), "u1"), "ER").select("name")


def q_report_summary(spark, sf_dir):
    """S7 + S17 + X9/X10: stored report JSON read back leniently."""
    sm = summaries(_catalogue(spark, sf_dir))
    return sm.select("name", "status", F.col("health_score").cast("long").alias("health_score"),
                     F.col("missing_pct").cast("double").alias("missing_pct"),
                     F.col("duplicate_rows").cast("long").alias("duplicate_rows"),
                     F.col("outlier_count").cast("long").alias("outlier_count"),
                     F.col("total_rows").cast("long").alias("total_rows"),
                     F.col("total_columns").cast("long").alias("total_columns"),
                     F.size("bias_flags").cast("long").alias("n_flags"),
                     F.size("recommendations").cast("long").alias("n_recs"))


def q_missing_top12(spark, sf_dir):
    """P6, K9, H5."""
    m = missing_top12(all_profiles(spark, sf_dir).columns)
    return m.select("dataset", F.col("rank").cast("long").alias("rank"), "column",
                    F.col("missing_pct").cast("double").alias("missing_pct"), "band")


def q_corr_top15(spark, sf_dir):
    """K10, H6."""
    c = corr_top15(all_profiles(spark, sf_dir).correlations)
    return c.select("dataset", F.col("rank").cast("long").alias("rank"), "pair",
                    F.col("value").cast("double").alias("value"),
                    F.col("abs_value").cast("double").alias("abs_value"), "band")


def q_score_cards(spark, sf_dir):
    """H3, H4, H7 + P7."""
    p = all_profiles(spark, sf_dir)
    sc = score_cards(p.summary).join(no_missing(p.columns), "dataset")
    return sc.select("dataset", F.col("health_score").cast("int").alias("health_score"), "band",
                     F.col("completeness_shown").cast("long").alias("completeness_shown"),
                     F.col("consistency_shown").cast("long").alias("consistency_shown"),
                     F.col("noise_shown").cast("long").alias("noise_shown"),
                     "missing_alert", "no_missing")


def _turns(spark, sf_dir, role: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").where(F.col("role") == role)


def q_answer_routing(spark, sf_dir):
    """Q1 over every user turn."""
    t = _turns(spark, sf_dir, "user")
    return t.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    intent(F.col("text")).alias("intent"))


#: A question for each intent, the default among them; every report is asked all.
TOPICS = ("overall health", "any nulls?", "repeated rows", "anomalies", "is it fair", "next step", "which fields", "what was removed", "which algorithm", "do they correlate", "hello")


def q_batch_answers(spark, sf_dir):
    """Every user turn answered from the report of one of the tables
    (dealt by conversation), and every report asked about every topic."""
    p = all_profiles(spark, sf_dir)
    ctx = answer_context(p.summary, p.columns, p.correlations, p.flags, p.recommendations, p.dropped)
    report = F.element_at(F.array(*[F.lit(t) for t in ALL]), (F.pmod("conv_id", F.lit(len(ALL))) + 1).cast("int"))
    turns = _turns(spark, sf_dir, "user").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), report.alias("dataset"), F.col("text").alias("question"))
    topics = p.summary.select(F.lit(-1).cast("long").alias("conv_id"), "dataset", F.posexplode(F.array(*[F.lit(t) for t in TOPICS])).alias("turn", "question"))
    a = answer_batch(turns.unionByName(topics.withColumn("turn", F.col("turn").cast("long"))), ctx)
    return a.select("conv_id", "turn", "dataset", "intent", "answer")


def q_clean_text(spark, sf_dir):
    """Q4 over every assistant turn (whole texts)."""
    t = _turns(spark, sf_dir, "assistant")
    return t.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    clean_text(F.col("text")).alias("cleaned"))


def q_compact_report(spark, sf_dir):
    """P9 + Q3: compact report JSON of every table."""
    c = compact_report(_reports(spark, sf_dir))
    return c.select("dataset", F.col("tier").cast("int").alias("tier"), F.col("chars").cast("long").alias("chars"))


def _stand_ins(spark, sf_dir):
    """FIXTURES section 8: documents as datasets (owner = source), conversations
    as chats (dataset = conv_id)."""
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("user_id"))
    chats = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("dataset_id"), "conv_id", "turn", "role")
    return docs, chats


def q_cascade_delete(spark, sf_dir):
    """S8 + J5: delete every dataset owned by 'src0'; chats cascade."""
    docs, chats = _stand_ins(spark, sf_dir)
    doomed = owned(docs, "src0")
    _, kept_chats, _ = delete_cascade(docs, chats, chats.limit(0), doomed)
    return kept_chats.select(F.col("conv_id").cast("long").alias("conv_id"),
                             F.col("turn").cast("long").alias("turn"), "role")


def q_orphan_check(spark, sf_dir):
    """Chats whose dataset does not exist."""
    docs, chats = _stand_ins(spark, sf_dir)
    return orphans(chats, docs).select(F.col("conv_id").cast("long").alias("conv_id"),
                                       F.col("turn").cast("long").alias("turn"))


def q_constraint_check(spark, sf_dir):
    """Chat rows violating the role check."""
    _, chats = _stand_ins(spark, sf_dir)
    return chat_violations(chats).select(F.col("conv_id").cast("long").alias("conv_id"),
                                         F.col("turn").cast("long").alias("turn"), "role", "violation")


def q_chat_history(spark, sf_dir):
    """S10 + K12: each conversation in order, question before answer."""
    _, chats = _stand_ins(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn", F.when(F.col("role") == "user", 0).otherwise(1))
    return chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        "role", F.row_number().over(w).cast("long").alias("seq"))


#: Documents as uploads: where they would lie and how long they would be.
UPLOADS = """SELECT concat('v1.2/', source, '/', CAST(doc_id AS STRING), CASE doc_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.xls' WHEN 3 THEN '.tar.gz' WHEN 4 THEN '.Csv' ELSE '' END) AS path,
  n_chars * 9000 AS length FROM documents"""


def q_file_admission(spark, sf_dir):
    """Documents as uploads of many types and sizes, admitted or refused."""
    read_table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return admission(spark.sql(UPLOADS)).withColumn("length", F.col("length").cast("long"))


def q_score_fallbacks(spark, sf_dir):
    """H3: the cards of reports whose sub-scores were not stored."""
    s = all_profiles(spark, sf_dir).summary
    bare = s.select(*[F.lit(None).cast("double").alias(c) if c in ("completeness_score", "consistency_score", "noise_score") else F.col(c) for c in s.columns])
    return score_cards(bare).select("dataset", "completeness_shown", "consistency_shown", "noise_shown")


def q_csv_profile_lineitem(spark, sf_dir):
    """S1 + S2: lineitem written as CSV (derived by Spark), read back with types
    inferred over all rows, then profiled."""
    path = f"{stage_dir(spark)}/lineitem.csv"
    read_table(spark, sf_dir, "lineitem").write.option("header", True).csv(path)
    df = read_any(spark, path)
    p = profile_many({"lineitem_csv": df})
    c = p.columns
    return c.select(
        F.col("name").alias("column"), F.col("kind"),
        F.col("null_count").cast("long").alias("null_count"),
        F.col("unique_count").cast("long").alias("unique_count"),
        py_round(F.col("mean_raw"), 4).alias("mean"), py_round(F.col("std_raw"), 4).alias("std"),
        py_round(F.col("min_raw"), 4).alias("min"), py_round(F.col("max_raw"), 4).alias("max"),
        F.col("outlier_count").cast("long").alias("outlier_count"))


#: Columns whose text a careless reader changes; the same SQL in both engines.
CSV_CASES = {
    "flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END", "tf": "CASE WHEN o_orderkey % 3 = 0 THEN 'T' ELSE 'F' END",
    "truth": "CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END", "size": "CAST(o_orderkey % 40 AS VARCHAR(20)) || CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'F' END",
    "wide": "CAST(CAST(12345678901234567000 AS DECIMAL(38,0)) + o_orderkey AS VARCHAR(40))", "zip": "lpad(CAST(o_custkey AS VARCHAR(20)), 6, '0')",
    "huge": "CASE WHEN o_orderkey % 7 = 0 THEN '1e400' ELSE '1e4' END", "half": "CAST(o_custkey AS VARCHAR(20)) || '.50'",
    "note": "'line ' || CAST(o_custkey AS VARCHAR(20)) || chr(10) || 'says \"' || o_orderpriority || '\", and more'",
    "gap": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END",
}
CSV_CASE_TYPES = {"truth": "boolean", "wide": "decimal(38,0)", "half": "double", "gap": "bigint"}


def q_csv_types(spark, sf_dir):
    """Columns derived from orders, written as CSV (one of them with line
    ends inside quotes) and read back: types and cells stay what they were."""
    path = f"{stage_dir(spark)}/cases.csv"
    read_table(spark, sf_dir, "orders").selectExpr(*[f"{sql} AS `{n}`" for n, sql in CSV_CASES.items()]) \
        .write.option("header", True).option("escape", '"').csv(path)
    df = read_any(spark, path)
    parts = []
    for n, t in df.dtypes:
        # counted by value, column by column: no row stands for all columns at once
        values = df.select(F.col(n).alias("v")).groupBy("v").agg(F.count("v").alias("n"))
        c = (F.col("v").cast("decimal(18,2)") if t == "double" else F.col("v")).cast("string")
        parts.append(values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.count("v").alias("distinct_cells"), F.min(c).alias("first"), F.max(c).alias("last"))
                     .select(F.lit(n).alias("column"), F.lit(t).alias("type"), "cells", "distinct_cells", "first", "last"))
    return reduce(DataFrame.unionByName, parts)


def q_sketch_profile(spark, sf_dir):
    """A1-A6 in fast mode: every table arrives in two batches, whose states are
    stored and merged without reading rows again; the estimates are held against
    the exact profile."""
    root = stage_dir(spark)
    tables = {t: frame(spark, sf_dir, t) for t in ALL}

    def add(t: str, i: int) -> None:
        half = F.pmod(F.xxhash64(*tables[t].columns), F.lit(2))
        add_batch(state_of(tables[t].where(half == i), t), root, f"{t} {i}")

    at_once([partial(add, t, i) for t in ALL for i in (0, 1)])
    a = approximate(merged(stored_states(spark, root))).alias("a")
    exact = profile_many(tables).columns.select("dataset", "pos", F.col("unique_count").alias("u"), F.col("q1").alias("e1"), F.col("q3").alias("e3"))
    near = F.abs(F.col("distinct_estimate") - F.col("u")) <= F.col("u") * DISTINCT_ERROR
    return a.join(exact, ["dataset", "pos"]).select(
        "dataset", F.col("name").alias("column"), "rows", F.col("nulls").alias("null_count"), "missing_pct",
        *[py_round(F.col(c), 4).alias(c) for c in ("mean", "std", "min", "max")], near.alias("distinct_within"),
        (F.col("e1").between(F.col("q1_bounds.low"), F.col("q1_bounds.high")) & F.col("e3").between(F.col("q3_bounds.low"), F.col("q3_bounds.high"))).alias("quartiles_within"))


def q_column_cards(spark, sf_dir):
    """The card of every column of every table, its first five values joined."""
    c = column_cards(all_profiles(spark, sf_dir).columns.where(~F.col("dtype").startswith("array")))
    shown = F.array_join(F.transform("top5", lambda x: F.concat(x["value"], F.lit(" = "), x["count"].cast("string"))), "\n")
    return c.select("dataset", F.col("pos").cast("int").alias("pos"), F.col("name").alias("column"), "missing_alert", "outlier_band", shown.alias("top5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"profile_{t}": q_profile(t) for t in ALL},
    "dropped_columns": q_dropped_columns,
    "duplicate_rows": q_duplicate_rows,
    "iqr_outliers": q_iqr_outliers,
    "top_values": q_top_values,
    "top_correlations": q_top_correlations,
    "class_imbalance": q_class_imbalance,
    "bias_flags": q_bias_flags,
    "recommendation_rules": q_recommendation_rules,
    "health_report": q_health_report,
    "algo_recommendations": q_algo_recommendations,
    "catalog_list": q_catalog_list,
    "catalog_kpis": q_catalog_kpis,
    "catalog_search": q_catalog_search,
    "report_summary": q_report_summary,
    "missing_top12": q_missing_top12,
    "corr_top15": q_corr_top15,
    "score_cards": q_score_cards,
    "answer_routing": q_answer_routing,
    "batch_answers": q_batch_answers,
    "clean_text": q_clean_text,
    "compact_report": q_compact_report,
    "cascade_delete": q_cascade_delete,
    "orphan_check": q_orphan_check,
    "constraint_check": q_constraint_check,
    "chat_history": q_chat_history,
    "file_admission": q_file_admission,
    "csv_profile_lineitem": q_csv_profile_lineitem,
    "csv_types": q_csv_types,
    "sketch_profile": q_sketch_profile,
    "column_cards": q_column_cards,
    "score_fallbacks": q_score_fallbacks,
    **stored.QUERIES,
}


# ---------------------------------------------------------------------------
# DuckDB side
# ---------------------------------------------------------------------------
def _all(parts, tables=ALL) -> list[str]:
    out = []
    for t in tables:
        out += O.table_ctes(t, parts)
    return out


def _union_sql(tables, select: Callable[[str], str]) -> str:
    return "\nUNION ALL\n".join(select(t) for t in tables)


def s_profile(t: str) -> str:
    body = (f"SELECT c.name AS \"column\", c.kind AS kind, CAST(c.nulls AS BIGINT) AS null_count, "
            f"CAST(c.missing_pct AS DOUBLE) AS missing_pct, CAST(c.uniq AS BIGINT) AS unique_count, "
            f"{O.R('c.mean_raw', 4)} AS mean, {O.R('c.std_raw', 4)} AS std, "
            f"{O.R('c.min_raw', 4)} AS min, {O.R('c.max_raw', 4)} AS max, "
            f"CAST(CASE WHEN c.kind = 'numeric' AND c.mean_raw IS NOT NULL THEN coalesce(o.outlier_count, 0) END AS BIGINT) AS outlier_count, "
            f"CAST(CASE WHEN c.kind = 'numeric' AND c.mean_raw IS NOT NULL THEN coalesce(o.outlier_pct, 0.0) END AS DOUBLE) AS outlier_pct "
            f"FROM {t}_cols c LEFT JOIN {t}_out o USING (pos) WHERE NOT c.dropped")
    return O.with_ctes(O.table_ctes(t, ("cols", "out")), [t], body)


def s_dropped_columns() -> str:
    body = _union_sql(ALL, lambda t: (
        f"SELECT '{t}' AS dataset, name AS \"column\", {O.R('ratio', 4)} AS missing_ratio "
        f"FROM {t}_cols WHERE dropped"))
    return O.with_ctes(_all(("cols",)), ALL, body)


def s_duplicate_rows() -> str:
    body = _union_sql(ALL, lambda t: (
        f"SELECT '{t}' AS dataset, CAST((SELECT max(total_rows) FROM {t}_cols) AS BIGINT) AS total_rows, "
        f"CAST(duplicate_rows AS BIGINT) AS duplicate_rows FROM {t}_dup"))
    return O.with_ctes(_all(("cols", "dup")), ALL, body)


def s_iqr_outliers() -> str:
    body = _union_sql(ALL, lambda t: (
        f"SELECT '{t}' AS dataset, c.name AS \"column\", CAST(o.n AS BIGINT) AS n, "
        f"{O.R('o.q1', 4)} AS q1, {O.R('o.q3', 4)} AS q3, CAST(o.outlier_count AS BIGINT) AS outlier_count, "
        f"CAST(o.outlier_pct AS DOUBLE) AS outlier_pct FROM {t}_out o JOIN {t}_cols c USING (pos)"))
    return O.with_ctes(_all(("cols", "out")), ALL, body)


def s_top_values() -> str:
    parts = []
    for t in ALL:
        for i, (c, k) in enumerate(O.SCHEMAS[t]):
            if k == O.N or (t, c) in O.NESTED:
                continue
            v = f"CAST({O.q(c)} AS VARCHAR)"
            parts.append(
                f"SELECT '{t}' AS dataset, '{c}' AS \"column\", CAST(rank AS BIGINT) AS rank, value, "
                f"CAST(cnt AS BIGINT) AS count FROM (SELECT value, cnt, row_number() OVER "
                f"(ORDER BY cnt DESC, value) AS rank FROM (SELECT {v} AS value, count(*) AS cnt "
                f"FROM {t} WHERE {O.q(c)} IS NOT NULL GROUP BY 1)) WHERE rank <= 10 "
                f"AND NOT (SELECT dropped FROM {t}_cols WHERE pos = {i})")
    return O.with_ctes(_all(("cols",)), ALL, "\nUNION ALL\n".join(parts))


def s_top_correlations() -> str:
    body = _union_sql(ALL, lambda t: (
        f"SELECT '{t}' AS dataset, CAST(rank AS BIGINT) AS rank, col1, col2, CAST(value AS DOUBLE) AS value "
        f"FROM {t}_corr"))
    return O.with_ctes(_all(("cols", "corr")), ALL, body)


def s_class_imbalance() -> str:
    body = _union_sql(ALL, lambda t: (
        f"SELECT '{t}' AS dataset, \"column\", CAST(n_classes AS BIGINT) AS n_classes, "
        f"CAST(max_count AS BIGINT) AS max_count, CAST(min_count AS BIGINT) AS min_count, "
        f"{O.R('ratio', 4)} AS ratio, CAST(majority_pct AS DOUBLE) AS majority_pct FROM {t}_imb"))
    return O.with_ctes(_all(("cols", "imb")), ALL, body)


_FLAG_PARTS = ("cols", "out", "imb", "corr", "flags")


def s_bias_flags() -> str:
    body = _union_sql(ALL, lambda t: (
        f"SELECT '{t}' AS dataset, CAST(seq AS BIGINT) AS seq, rule_id, \"column\", {O.R('value', 4)} AS value, message "
        f"FROM {t}_flags"))
    return O.with_ctes(_all(_FLAG_PARTS), ALL, body)


_FACT_PARTS = ("cols", "out", "imb", "corr", "dup", "flags", "facts")


def _recs(t: str) -> str:
    quote = "''''"  # one quote in SQL
    named = lambda where, limit="": f"(SELECT string_agg({quote} || name || {quote}, ', ' ORDER BY pos) FROM (SELECT pos, name FROM {where} ORDER BY pos {limit}))"
    outlying = f"{t}_cols c JOIN {t}_out o USING (pos) WHERE o.outlier_pct > 5"
    return f"""SELECT '{t}' AS dataset, CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS seq, rule_id, message FROM (
  SELECT 1 AS k, 'R1' AS rule_id, 'Remove ' || format('{{:,}}', duplicate_rows) || ' duplicate rows before modeling — they can artificially inflate accuracy metrics.' AS message
    FROM {t}_facts WHERE duplicate_rows > 0
  UNION ALL SELECT 2, 'R2', 'Overall missing data is ' || printf('%.1f', missing_pct) || '%. For numeric columns use median imputation; for categorical columns use mode or a dedicated ''Missing'' category.'
    FROM {t}_facts WHERE missing_pct > 2
  UNION ALL SELECT 3, 'R3', 'Columns ' || {named(f"{t}_cols WHERE dropped")} || ' were automatically excluded due to excessive missing data (>60%). Review whether these can be recovered from another data source.'
    FROM {t}_facts WHERE dropped_count > 0
  UNION ALL SELECT 4, 'R4', 'Highly correlated feature pairs detected: ' || (SELECT string_agg(col1 || ' ↔ ' || col2 || ' (' || printf('%.2f', value) || ')', '; ' ORDER BY rank)
      FROM (SELECT * FROM {t}_corr WHERE abs(value) >= 0.85 ORDER BY rank LIMIT 3)) || '. Drop one from each pair or apply PCA to reduce redundancy.'
    FROM {t}_facts WHERE has_high_corr
  UNION ALL SELECT 5, 'R5', 'Columns ' || {named(outlying, "LIMIT 4")} || ' contain more than 5% outliers. Use RobustScaler instead of StandardScaler, or cap values at the 1st/99th percentile.'
    FROM {t}_facts WHERE (SELECT count(*) FROM {t}_out WHERE outlier_pct > 5) > 0
  UNION ALL SELECT 6, 'R6', CASE WHEN total_rows < 1000
      THEN 'The dataset has only ' || format('{{:,}}', total_rows) || ' rows. Models may overfit — prefer simpler algorithms (Logistic Regression, Decision Tree) and use cross-validation.'
      ELSE 'Large dataset (' || format('{{:,}}', total_rows) || ' rows). Consider mini-batch training or tree-based methods like XGBoost / LightGBM that handle large data efficiently.' END
    FROM {t}_facts WHERE total_rows < 1000 OR total_rows > 500000
  UNION ALL SELECT 7, 'R7', 'No critical issues found. The dataset appears ready for feature engineering and modeling.' FROM {t}_facts WHERE NOT (duplicate_rows > 0 OR missing_pct > 2 OR dropped_count > 0
      OR has_high_corr OR (SELECT count(*) FROM {t}_out WHERE outlier_pct > 5) > 0
      OR total_rows < 1000 OR total_rows > 500000))"""


def s_recommendation_rules() -> str:
    return O.with_ctes(_all(_FACT_PARTS), ALL, "\nUNION ALL\n".join(_recs(t) for t in ALL))


def s_health_report() -> str:
    body = _union_sql(ALL, lambda t: (
        f"SELECT dataset, CAST(total_rows AS BIGINT) AS total_rows, CAST(total_columns AS BIGINT) AS total_columns, "
        f"CAST(missing_cells AS BIGINT) AS missing_cells, CAST(missing_cells_exact AS BIGINT) AS missing_cells_exact, "
        f"CAST(missing_pct AS DOUBLE) AS missing_pct, CAST(duplicate_rows AS BIGINT) AS duplicate_rows, "
        f"CAST(outlier_count AS BIGINT) AS outlier_count, CAST(flag_count AS BIGINT) AS flag_count, "
        f"CAST(health_score AS INTEGER) AS health_score, CAST(completeness_score AS DOUBLE) AS completeness_score, "
        f"CAST(consistency_score AS DOUBLE) AS consistency_score, CAST(noise_score AS DOUBLE) AS noise_score "
        f"FROM {t}_facts"))
    return O.with_ctes(_all(_FACT_PARTS), ALL, body)


def _facts_union() -> str:
    return _union_sql(ALL, lambda t: f"SELECT * FROM {t}_facts")


def _cat_values() -> str:
    rows = []
    for i, (name, cx, mn, mx, hm, ho, hi, ss, types, base) in enumerate(O.ALGORITHMS):
        nm = name.replace("'", "''")
        rows.append(f"({i}, '{nm}', '{cx}', {mn}, {'NULL' if mx is None else mx}, {str(hm).lower()}, "
                    f"{str(ho).lower()}, {str(hi).lower()}, {str(ss).lower()}, '{types}', {base})")
    return ("cat AS (SELECT * FROM (VALUES " + ", ".join(rows) +
            ") v(idx, name, complexity, min_rows, max_rows, hm, ho, hi, ss, types, base))")


def s_algo_recommendations() -> str:
    ctes = f"""allf AS ({_facts_union()}),
{_cat_values()},
adv0 AS (
  SELECT f.dataset, f.problem_type, f.total_rows, f.missing_pct, c.idx, c.name, c.hm, c.ss, c.base
    + CASE WHEN f.missing_pct > 5 AND NOT c.hm THEN -15 ELSE 0 END
    + CASE WHEN f.out_pct > 5 AND NOT c.ho THEN -10 ELSE 0 END
    + CASE WHEN f.has_imbalance AND NOT c.hi THEN -12 ELSE 0 END
    + CASE WHEN c.ss AND f.out_pct > 3 THEN -8 ELSE 0 END
    + CASE WHEN f.has_high_corr AND starts_with(c.name, 'Logistic') THEN -10 ELSE 0 END
    + CASE WHEN f.total_rows > 100000 AND contains(c.name, 'Gradient') THEN 8 ELSE 0 END
    + CASE WHEN f.total_rows < 1000 AND c.complexity = 'low' THEN 5 ELSE 0 END
    + CASE WHEN f.total_rows > 500000 AND c.complexity = 'high' THEN -10 ELSE 0 END
    + CASE WHEN f.dup_pct > 5 THEN -5 ELSE 0 END AS raw
  FROM allf f JOIN cat c ON list_contains(string_split(c.types, ','), f.problem_type)
  WHERE f.total_rows >= c.min_rows AND (c.max_rows IS NULL OR f.total_rows <= c.max_rows)),
adv AS (SELECT *, greatest(0, least(100, raw)) AS score FROM adv0)"""
    select = """SELECT dataset, CAST(rank AS BIGINT) AS rank, name AS algorithm, CAST(score AS INTEGER) AS score,
  concat_ws(' ', 'Recommended for a ' || problem_type || ' task with ' || format('{:,}', CAST(total_rows AS BIGINT)) || ' rows.',
    CASE WHEN hm AND missing_pct > 5 THEN 'Handles the ' || printf('%.1f', missing_pct) || '% missing data natively.' END, CASE WHEN NOT ss THEN 'Does not require feature scaling.' END,
    CASE WHEN score >= 85 THEN 'Strong fit for this dataset''s profile.' WHEN score >= 70 THEN 'Good fit with minor preprocessing recommended.'
         ELSE 'Usable but consider addressing data quality issues first.' END) AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, idx) AS rank FROM adv) WHERE rank <= 5"""
    return _with_body(ctes, select)


def _with_body(extra_ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([O.DIRTY_CTE] + _all(_FACT_PARTS)) + ",\n" + extra_ctes + "\n" + select


def s_catalog_list() -> str:
    return _with_body(f"allf AS ({_facts_union()})",
                      "SELECT dataset AS name, 'ready' AS status, CAST(total_rows AS BIGINT) AS rows, "
                      "CAST(total_columns AS BIGINT) AS columns, CAST(health_score AS INTEGER) AS health_score FROM allf")


def s_catalog_kpis() -> str:
    return _with_body(f"allf AS ({_facts_union()})",
                      "SELECT CAST(count(*) AS BIGINT) AS total_datasets, CAST(count(*) AS BIGINT) AS ready, "
                      "CAST(0 AS BIGINT) AS processing, CAST(coalesce(floor(avg(health_score) + 0.5), 0) AS BIGINT) "
                      "AS avg_score FROM allf")


def s_catalog_search() -> str:
    return _with_body(f"allf AS ({_facts_union()})",
                      "SELECT dataset AS name FROM allf WHERE contains(lower(dataset), 'er')")


def s_report_summary() -> str:
    recs = "\nUNION ALL\n".join(_recs(t) for t in ALL)
    return _with_body(f"allf AS ({_facts_union()}),\nallr AS ({recs})",
                      "SELECT f.dataset AS name, 'ok' AS status, CAST(health_score AS BIGINT) AS health_score, "
                      "CAST(missing_pct AS DOUBLE) AS missing_pct, CAST(duplicate_rows AS BIGINT) AS duplicate_rows, "
                      "CAST(outlier_count AS BIGINT) AS outlier_count, CAST(total_rows AS BIGINT) AS total_rows, "
                      "CAST(total_columns AS BIGINT) AS total_columns, CAST(flag_count AS BIGINT) AS n_flags, "
                      "CAST((SELECT count(*) FROM allr r WHERE r.dataset = f.dataset) AS BIGINT) AS n_recs FROM allf f")


def s_missing_top12() -> str:
    body = _union_sql(ALL, lambda t: f"SELECT '{t}' AS dataset, pos, name, missing_pct FROM {t}_cols "
                                     f"WHERE NOT dropped AND missing_pct > 0")
    return O.with_ctes(_all(("cols",)), ALL, f"""SELECT dataset, CAST(rank AS BIGINT) AS rank, name AS "column",
  {O.R('missing_pct', 1)} AS missing_pct,
  CASE WHEN missing_pct > 20 THEN 'high' WHEN missing_pct > 10 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY missing_pct DESC, pos) AS rank FROM ({body}))
WHERE rank <= 12""")


def s_corr_top15() -> str:
    body = _union_sql(ALL, lambda t: f"SELECT '{t}' AS dataset, rank, col1, col2, value FROM {t}_corr")
    return O.with_ctes(_all(("cols", "corr")), ALL, f"""SELECT dataset, CAST(rank AS BIGINT) AS rank,
  col1 || ' × ' || col2 AS pair, {O.R('value', 3)} AS value, {O.R('abs(value)', 3)} AS abs_value,
  CASE WHEN abs(value) > 0.7 THEN 'strong' WHEN abs(value) > 0.4 THEN 'moderate' ELSE 'weak' END AS band
FROM ({body}) WHERE rank <= 15""")


def s_score_cards() -> str:
    nm = _union_sql(ALL, lambda t: f"SELECT '{t}' AS dataset, bool_and(coalesce(missing_pct, 0) = 0) AS no_missing "
                                   f"FROM {t}_cols WHERE NOT dropped")
    return _with_body(f"allf AS ({_facts_union()}),\nnm AS ({nm})", """SELECT f.dataset,
  CAST(health_score AS INTEGER) AS health_score,
  CASE WHEN health_score >= 80 THEN 'High' WHEN health_score >= 60 THEN 'Moderate' ELSE 'Poor' END AS band,
  CAST(floor(completeness_score + 0.5) AS BIGINT) AS completeness_shown,
  CAST(floor(consistency_score + 0.5) AS BIGINT) AS consistency_shown,
  CAST(floor(noise_score + 0.5) AS BIGINT) AS noise_shown,
  missing_pct > 10 AS missing_alert, nm.no_missing
FROM allf f JOIN nm USING (dataset)""")


def _intent_sql(col: str) -> str:
    parts = []
    for name, words in O.INTENT_WORDS:
        cond = " OR ".join(f"contains(lower({col}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(parts) + " ELSE 'default' END"


def s_answer_routing() -> str:
    return (f"SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, "
            f"{_intent_sql('coalesce(text, \'\')')} AS intent FROM conversations WHERE role = 'user'")


def s_batch_answers() -> str:
    asked = _union_sql(ALL, lambda t: "\nUNION ALL\n".join(f"SELECT -1, {i}, '{t}', '{q}'" for i, q in enumerate(TOPICS)))
    tables = "[" + ", ".join(f"'{t}'" for t in ALL) + "]"
    return _with_body(f"""answers AS MATERIALIZED ({_union_sql(ALL, lambda t: answers(t, _recs))}),
asked AS (SELECT conv_id, turn, {tables}[CAST(conv_id % {len(ALL)} AS INTEGER) + 1] AS dataset, text AS question FROM conversations WHERE role = 'user' UNION ALL {asked}),
routed AS (SELECT *, {_intent_sql("coalesce(question, '')")} AS intent FROM asked)""",
                      "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, dataset, intent, answer FROM routed JOIN answers USING (dataset, intent)")


def s_file_admission() -> str:
    return f"""WITH u AS ({UPLOADS}), s AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix FROM u)
SELECT path, CAST(length AS BIGINT) AS length, suffix, suffix IN ('.csv', '.xlsx', '.xls') AND length <= 52428800 AS admitted,
  CASE WHEN suffix NOT IN ('.csv', '.xlsx', '.xls') THEN 'Unsupported file type ''' || suffix || '''. Use CSV or Excel.' WHEN length > 52428800 THEN 'File exceeds the 50 MB limit.' END AS reason FROM s"""


def s_score_fallbacks() -> str:
    return _with_body(f"allf AS ({_facts_union()})", """SELECT dataset, CAST(floor(100.0 - missing_pct + 0.5) AS BIGINT) AS completeness_shown,
  CAST(floor(greatest(0.0, 100.0 - CAST(duplicate_rows AS DOUBLE)) + 0.5) AS BIGINT) AS consistency_shown,
  CAST(floor(greatest(0.0, 100.0 - CAST(outlier_count AS DOUBLE) / CAST(greatest(total_rows, 1) AS DOUBLE) * 100.0) + 0.5) AS BIGINT) AS noise_shown FROM allf""")


def s_clean_text() -> str:
    trim = r"'^[\s\x0B]+|[\s\x0B]+$'"
    fence = r"'^```[a-zA-Z0-9_-]*\s*([\s\S]*?)\s*```$'"
    t = f"regexp_replace(coalesce(text, ''), {trim}, '', 'g')"
    return f"""SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
  regexp_replace(replace(CASE WHEN regexp_matches(t, {fence}) THEN regexp_replace(regexp_extract(t, {fence}, 1), {trim}, '', 'g')
                              ELSE t END, '```', ''), {trim}, '', 'g') AS cleaned
FROM (SELECT conv_id, turn, {t} AS t FROM conversations WHERE role = 'assistant')"""


def s_cascade_delete() -> str:
    return ("SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role FROM conversations c "
            "WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = 'src0' AND d.doc_id = c.conv_id)")


def s_orphan_check() -> str:
    return ("SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn FROM conversations c "
            "WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.conv_id)")


def s_constraint_check() -> str:
    return ("SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, 'role' AS violation "
            "FROM conversations WHERE role NOT IN ('user', 'assistant')")


def s_chat_history() -> str:
    return ("SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, "
            "CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END) "
            "AS BIGINT) AS seq FROM conversations")


def s_csv_profile_lineitem() -> str:
    body = (f"SELECT c.name AS \"column\", CASE WHEN c.name = 'l_shipdate' THEN 'categorical' ELSE c.kind END AS kind, "
            f"CAST(c.nulls AS BIGINT) AS null_count, CAST(c.uniq AS BIGINT) AS unique_count, "
            f"{O.R('c.mean_raw', 4)} AS mean, {O.R('c.std_raw', 4)} AS std, "
            f"{O.R('c.min_raw', 4)} AS min, {O.R('c.max_raw', 4)} AS max, "
            f"CAST(CASE WHEN c.kind = 'numeric' THEN coalesce(o.outlier_count, 0) END AS BIGINT) AS outlier_count "
            f"FROM lineitem_cols c LEFT JOIN lineitem_out o USING (pos) WHERE NOT c.dropped")
    return O.with_ctes(O.table_ctes("lineitem", ("cols", "out")), ["lineitem"], body)


def s_csv_types() -> str:
    def one(n: str) -> str:
        c = f"CAST(CAST({n} AS DECIMAL(18,2)) AS VARCHAR)" if n == "half" else f"CAST({n} AS VARCHAR)"
        return (f"SELECT '{n}' AS \"column\", '{CSV_CASE_TYPES.get(n, 'string')}' AS type, CAST(count({n}) AS BIGINT) AS cells, "
                f"CAST(count(DISTINCT {n}) AS BIGINT) AS distinct_cells, min({c}) AS first, max({c}) AS last FROM cases")
    return ("WITH cases AS (SELECT " + ", ".join(f"{sql} AS {n}" for n, sql in CSV_CASES.items()) + " FROM orders)\n"
            + "\nUNION ALL\n".join(one(n) for n in CSV_CASES))


def s_sketch_profile() -> str:
    body = _union_sql(ALL, lambda t: (
        f"SELECT '{t}' AS dataset, name AS \"column\", CAST(total_rows AS BIGINT) AS rows, CAST(nulls AS BIGINT) AS null_count, CAST(missing_pct AS DOUBLE) AS missing_pct, "
        f"{O.R('mean_raw', 4)} AS mean, {O.R('std_raw', 4)} AS std, {O.R('min_raw', 4)} AS min, {O.R('max_raw', 4)} AS max, "
        f"true AS distinct_within, CASE WHEN mean_raw IS NOT NULL THEN true END AS quartiles_within FROM {t}_cols WHERE NOT dropped"))
    return O.with_ctes(_all(("cols",)), ALL, body)


def s_column_cards() -> str:
    parts = []
    for t in ALL:
        for i, (c, k) in enumerate(O.SCHEMAS[t]):
            if (t, c) in O.NESTED:
                continue
            top = "CAST(NULL AS VARCHAR)" if k == O.N else (
                f"(SELECT string_agg(value || ' = ' || CAST(cnt AS VARCHAR), chr(10) ORDER BY cnt DESC, value) FROM (SELECT CAST({O.q(c)} AS VARCHAR) AS value, count(*) AS cnt "
                f"FROM {t} WHERE {O.q(c)} IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, value LIMIT 5))")
            parts.append(f"SELECT '{t}' AS dataset, CAST({i} AS INTEGER) AS pos, '{c}' AS \"column\", c.missing_pct > 10 AS missing_alert, "
                         f"CASE WHEN c.mean_raw IS NOT NULL THEN CASE WHEN o.outlier_pct > 5 THEN 'red' WHEN o.outlier_pct > 0 THEN 'shown' ELSE 'hidden' END END AS outlier_band, "
                         f"{top} AS top5 FROM {t}_cols c LEFT JOIN {t}_out o USING (pos) WHERE c.pos = {i} AND NOT c.dropped")
    return O.with_ctes(_all(("cols", "out")), ALL, "\nUNION ALL\n".join(parts))


def oracle_sql() -> dict[str, str]:
    out = {f"profile_{t}": s_profile(t) for t in ALL}
    out.update({
        "dropped_columns": s_dropped_columns(),
        "duplicate_rows": s_duplicate_rows(),
        "iqr_outliers": s_iqr_outliers(),
        "top_values": s_top_values(),
        "top_correlations": s_top_correlations(),
        "class_imbalance": s_class_imbalance(),
        "bias_flags": s_bias_flags(),
        "recommendation_rules": s_recommendation_rules(),
        "health_report": s_health_report(),
        "algo_recommendations": s_algo_recommendations(),
        "catalog_list": s_catalog_list(),
        "catalog_kpis": s_catalog_kpis(),
        "catalog_search": s_catalog_search(),
        "report_summary": s_report_summary(),
        "missing_top12": s_missing_top12(),
        "corr_top15": s_corr_top15(),
        "score_cards": s_score_cards(),
        "answer_routing": s_answer_routing(),
        "clean_text": s_clean_text(),
        "cascade_delete": s_cascade_delete(),
        "orphan_check": s_orphan_check(),
        "constraint_check": s_constraint_check(),
        "chat_history": s_chat_history(),
        "csv_profile_lineitem": s_csv_profile_lineitem(),
        "csv_types": s_csv_types(),
        "sketch_profile": s_sketch_profile(),
        "column_cards": s_column_cards(),
        "batch_answers": s_batch_answers(),
        "file_admission": s_file_admission(),
        "score_fallbacks": s_score_fallbacks(),
        **stored.ORACLES,
    })
    return out
