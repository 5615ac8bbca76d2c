"""Queries over a catalogue that is really written: datasets (from documents,
owner = source, every status, reports that are missing, broken or fine), chats
(from conversations, some of datasets that do not exist) and exports are
appended to the shared folder, read back, looked up, answered and deleted.

``SOURCES`` says what the tables hold in SQL that Spark and DuckDB both run;
the oracle side restates every operation on it in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.catalog import (CHATS_SCHEMA, DATASETS_SCHEMA, EXPORTS_SCHEMA, chat_pairs, chat_violations,
                                 dataset_violations, delete_stored, export_lookup, get_report, list_datasets, load,
                                 orphans, owned, store, summaries, vacuum)
from ..operators.views import hits, kpi_columns
from ..session import materialize, stage_dir
from ..sources.tables import read_table

OWNERS = ("src0", "src1")

SOURCES = {
    "datasets": """SELECT CAST(doc_id AS STRING) AS id, source AS user_id, concat(lang, ' report ', CAST(doc_id AS STRING)) AS name,
  CASE WHEN doc_id % 7 = 3 THEN 'failed' WHEN doc_id % 7 = 5 THEN 'processing' ELSE 'ready' END AS status,
  n_chars AS rows, CAST(5 AS INT) AS columns, CAST(doc_id % 101 AS INT) AS health_score,
  CASE WHEN doc_id % 11 = 4 THEN NULL WHEN doc_id % 11 = 6 THEN '{bad' WHEN doc_id % 11 = 8 THEN '{"health_score":"3.7","missing_pct":"abc","bias_flags":"x"}'
    ELSE concat('{"health_score":', CAST(doc_id % 101 AS STRING), ',"missing_pct":', CAST(doc_id % 8 AS STRING), '.5,"bias_flags":["a",null,"b"]}') END AS report,
  concat(source, '/', CAST(doc_id AS STRING), '.csv') AS file_path, 1704067200 + doc_id * 60 AS created FROM documents""",
    "chats": """SELECT concat('c', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id, CAST(CASE WHEN conv_id % 9 = 2 THEN conv_id + 100000000 ELSE conv_id END AS STRING) AS dataset_id,
  concat('src', CAST(conv_id % 20 AS STRING)) AS user_id, role, text AS content, 1704067200 + conv_id * 3600 + turn AS created FROM conversations""",
    "exports": """SELECT concat('e', CAST(doc_id AS STRING)) AS id, CASE WHEN doc_id % 15 = 0 THEN 'src1' ELSE source END AS user_id, CAST(doc_id AS STRING) AS dataset_id,
  concat('exports/', CAST(doc_id AS STRING), '.pdf') AS storage_path, 1704067200 + doc_id AS created FROM documents""",
}


def _catalogue(spark: SparkSession, sf_dir: str) -> str:
    """Append the three tables, each owner group in an append of its own."""
    root = stage_dir(spark)
    for t in ("documents", "conversations"):
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    stamp = F.timestamp_seconds("created").alias("created_at")
    tables = {
        "datasets": spark.sql(SOURCES["datasets"]).select("*", stamp).select(DATASETS_SCHEMA.fieldNames()),
        "chats": spark.sql(SOURCES["chats"]).select("*", stamp, F.lit(None).cast("array<string>").alias("sources")).select(CHATS_SCHEMA.fieldNames()),
        "exports": spark.sql(SOURCES["exports"]).select("*", stamp).select(EXPORTS_SCHEMA.fieldNames()),
    }
    first = F.col("user_id") == OWNERS[0]
    for batch, part in (("first", first), ("others", ~first), ("first", first)):  # the first comes twice and stands once
        store(root, batch, **{n: df.where(part) for n, df in tables.items()})
    return root


def _created():
    return F.unix_timestamp("created_at").alias("created")


def q_list(spark, sf_dir):
    """Each owner's list; the rank shows its order."""
    datasets = load(spark, _catalogue(spark, sf_dir), 0, "datasets")
    out = None
    for owner in OWNERS:
        rows = list_datasets(datasets, owner).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(owner)).orderBy(F.desc("created_at"), "id")).cast("long"))
        rows = rows.select(F.lit(owner).alias("owner"), "rank", "id", "name", "status", F.col("rows").cast("long"), F.col("columns").cast("int"), "health_score", _created())
        out = rows if out is None else out.unionByName(rows)
    return out


def q_kpis(spark, sf_dir):
    """A13 with datasets of every status; P8 with its hit count."""
    datasets = load(spark, _catalogue(spark, sf_dir), 0, "datasets")
    out = None
    for owner in OWNERS:
        mine = owned(datasets, owner)
        rows = mine.agg(*kpi_columns(), hits("FR Rep")).select(F.lit(owner).alias("owner"), *[F.col(c).cast("long") for c in ("total_datasets", "ready", "processing", "avg_score", "hits")])
        out = rows if out is None else out.unionByName(rows)
    return out


def q_summaries(spark, sf_dir):
    """Missing, broken and lenient reports read back."""
    s = summaries(load(spark, _catalogue(spark, sf_dir), 0, "datasets"))
    return s.select("id", "status", F.col("health_score").cast("long"), F.col("missing_pct").cast("double"), F.array_join("bias_flags", ",").alias("flags"))


def q_report(spark, sf_dir):
    """One report of each owner; another owner's id gives none."""
    datasets = load(spark, _catalogue(spark, sf_dir), 0, "datasets")
    found = [get_report(datasets, i, owner) for owner in OWNERS for i in ("0", "1", "20", "21", "41")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def q_exports(spark, sf_dir):
    """Exports of datasets that their owner has."""
    root = _catalogue(spark, sf_dir)
    datasets, exports = load(spark, root, 0, "datasets"), load(spark, root, 0, "exports")
    return export_lookup(exports, datasets, "src0").unionByName(export_lookup(exports, datasets, "src1")).select("id", "dataset_id", "user_id", "storage_path", _created())


def q_checks(spark, sf_dir):
    """Violations and orphans, none of them empty."""
    root = _catalogue(spark, sf_dir)
    datasets, chats = load(spark, root, 0, "datasets"), load(spark, root, 0, "chats")
    broken = datasets.withColumn("status", F.when(F.col("status") == "failed", "lost").otherwise(F.col("status"))).withColumn("health_score", F.col("health_score") + 5)
    parts = [orphans(chats, datasets).select("id", F.lit("orphan").alias("violation")), chat_violations(chats).select("id", "violation"), dataset_violations(broken).select("id", "violation")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_chat_append(spark, sf_dir):
    """Question and answer pairs appended to the stored chats and
    read back in order."""
    root = _catalogue(spark, sf_dir)
    asked = load(spark, root, 0, "chats").where("role = 'user' and user_id = 'src1'")
    answered = asked.select("dataset_id", F.col("content").alias("question"), F.concat(F.lit("noted: "), F.length("content").cast("string")).alias("answer"))
    store(root, chats=chat_pairs(answered, F.lit("assistant-log")).select(CHATS_SCHEMA.fieldNames()))
    log = owned(load(spark, root, 0, "chats"), "assistant-log")
    pairs = log.groupBy("dataset_id", "role", "content", F.array_join("sources", ",").alias("sources")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("created_at").alias("stamps"))
    return pairs.select("dataset_id", "role", "content", "sources", "n", "stamps")


def q_delete(spark, sf_dir):
    """A stored delete with an owner mismatch, read back from the new version."""
    root = _catalogue(spark, sf_dir)
    datasets = load(spark, root, 0, "datasets")
    doomed = owned(datasets, "src0").select("id", "user_id").unionByName(owned(datasets, "src1").select("id", F.lit("intruder").alias("user_id")))
    now = delete_stored(spark, root, 0, doomed)
    out = None
    for t in ("datasets", "chats", "exports"):
        rows = load(spark, root, now, t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "user_id", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def _files(spark, root, t):
    """The files of a table, by owner, as they lie in the folder."""
    df = spark.read.parquet(f"{root}/{t}").select(F.col("user_id").cast("string"), F.col("_metadata.file_path").alias("file"))
    return df.groupBy("user_id", "file").agg(F.count(F.lit(1)).alias("n"))


def q_vacuum(spark, sf_dir):
    """Deleted rows leave the files; files of owners that lost nothing stay."""
    root = _catalogue(spark, sf_dir)
    now = delete_stored(spark, root, 0, owned(load(spark, root, 0, "datasets"), "src0").select("id", "user_id"))
    now = delete_stored(spark, root, now, load(spark, root, now, "datasets").where("status = 'failed' and user_id = 'src1'").select("id", "user_id"))
    before = {t: materialize(_files(spark, root, t), f"{stage_dir(spark)}/files") for t in ("datasets", "chats", "exports")}
    vacuum(spark, root, now)
    out = None
    for t, old in before.items():
        new = _files(spark, root, t).withColumnRenamed("n", "m")
        rows = old.join(new, ["user_id", "file"], "full").groupBy("user_id").agg(
            F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("n"), (F.count_if(F.col("m").isNull() | F.col("n").isNull()) > 0).alias("rewritten"))
        rows = rows.select(F.lit(t).alias("table_name"), "user_id", "n", "rewritten")
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stored_list": q_list,
    "stored_kpis": q_kpis,
    "stored_summaries": q_summaries,
    "stored_report": q_report,
    "stored_exports": q_exports,
    "stored_checks": q_checks,
    "stored_chat_append": q_chat_append,
    "stored_delete": q_delete,
    "stored_vacuum": q_vacuum,
}

_CTE = "WITH datasets AS ({datasets}), chats AS ({chats}), exports AS ({exports}) ".format(**SOURCES)

ORACLES = {
    "stored_list": _CTE + """SELECT user_id AS owner, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, id) AS rank, id, name, status, CAST(rows AS BIGINT) AS rows,
  columns, health_score, created FROM datasets WHERE user_id IN ('src0', 'src1')""",
    "stored_kpis": _CTE + """SELECT user_id AS owner, count(*) AS total_datasets, CAST(sum(CASE WHEN status = 'ready' THEN 1 ELSE 0 END) AS BIGINT) AS ready,
  CAST(sum(CASE WHEN status = 'processing' THEN 1 ELSE 0 END) AS BIGINT) AS processing, CAST(floor(avg(health_score) + 0.5) AS BIGINT) AS avg_score,
  CAST(sum(CASE WHEN name LIKE '%fr rep%' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM datasets WHERE user_id IN ('src0', 'src1') GROUP BY user_id""",
    "stored_summaries": _CTE + """SELECT id, CASE WHEN report IS NULL THEN 'report_not_found' WHEN report = '{bad' THEN 'invalid_json' ELSE 'ok' END AS status,
  CASE WHEN report IS NULL OR report = '{bad' THEN NULL WHEN CAST(id AS BIGINT) % 11 = 8 THEN 0 ELSE CAST(id AS BIGINT) % 101 END AS health_score,
  CASE WHEN report IS NULL OR report = '{bad' THEN NULL WHEN CAST(id AS BIGINT) % 11 = 8 THEN 0.0 ELSE CAST(CAST(id AS BIGINT) % 8 AS DOUBLE) + 0.5 END AS missing_pct,
  CASE WHEN report IS NULL OR report = '{bad' THEN NULL WHEN CAST(id AS BIGINT) % 11 = 8 THEN '' ELSE 'a,b' END AS flags FROM datasets""",
    "stored_report": _CTE + """SELECT id AS dataset_id, name AS dataset_name, report FROM datasets WHERE id IN ('0', '1', '20', '21', '41') AND user_id IN ('src0', 'src1')""",
    "stored_exports": _CTE + """SELECT e.id, e.dataset_id, e.user_id, e.storage_path, e.created FROM exports e JOIN datasets d ON d.id = e.dataset_id AND d.user_id = e.user_id
  WHERE e.user_id IN ('src0', 'src1')""",
    "stored_checks": _CTE + """SELECT c.id, 'orphan' AS violation FROM chats c LEFT JOIN datasets d ON d.id = c.dataset_id WHERE d.id IS NULL
  UNION ALL SELECT id, 'role' FROM chats WHERE role NOT IN ('user', 'assistant')
  UNION ALL SELECT id, CASE WHEN status = 'failed' THEN 'status' ELSE 'health_score' END FROM datasets WHERE status = 'failed' OR health_score + 5 > 100""",
    "stored_chat_append": _CTE + """, asked AS (SELECT dataset_id, content, concat('noted: ', CAST(length(content) AS STRING)) AS answer FROM chats WHERE role = 'user' AND user_id = 'src1')
  SELECT dataset_id, 'user' AS role, content, CAST(NULL AS STRING) AS sources, count(*) AS n, 1 AS stamps FROM asked GROUP BY dataset_id, content
  UNION ALL SELECT dataset_id, 'assistant', answer, 'EDA Report', count(*), 1 FROM asked GROUP BY dataset_id, answer""",
    "stored_delete": _CTE + """, gone AS (SELECT id FROM datasets WHERE user_id = 'src0')
  SELECT 'datasets' AS table_name, user_id, count(*) AS n FROM datasets WHERE user_id <> 'src0' GROUP BY user_id
  UNION ALL SELECT 'chats', c.user_id, count(*) FROM chats c LEFT JOIN gone g ON g.id = c.dataset_id WHERE g.id IS NULL GROUP BY c.user_id
  UNION ALL SELECT 'exports', e.user_id, count(*) FROM exports e LEFT JOIN gone g ON g.id = e.dataset_id WHERE g.id IS NULL GROUP BY e.user_id""",
    "stored_vacuum": _CTE + """, gone AS (SELECT id FROM datasets WHERE user_id = 'src0' OR (user_id = 'src1' AND status = 'failed')),
  r AS (SELECT 'datasets' AS table_name, user_id, id AS ds FROM datasets UNION ALL SELECT 'chats', user_id, dataset_id FROM chats UNION ALL SELECT 'exports', user_id, dataset_id FROM exports)
  SELECT table_name, user_id, CAST(count(*) - count(g.id) AS BIGINT) AS n, count(g.id) > 0 AS rewritten FROM r LEFT JOIN gone g ON g.id = r.ds GROUP BY table_name, user_id""",
}
