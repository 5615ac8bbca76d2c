"""The report catalogue (S4-S17, J3-J5): datasets, chats and exports tables.

The reference keeps three Postgres tables; here they are Parquet tables
partitioned by ``user_id`` (owner filters prune partitions, S15/S16) and
every operation is a DataFrame query: appends, owner-scoped lookups, the
cascade delete as anti-joins, and the CHECK / foreign-key rules as
violation queries run before an append.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.scalar import path_suffix
from ..session import materialize, stage_dir

# Table schemas (report kept as a JSON string at the boundary).
DATASETS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("rows", T.LongType(), False),
    T.StructField("columns", T.IntegerType(), False),
    T.StructField("health_score", T.IntegerType(), False),
    T.StructField("report", T.StringType(), True),
    T.StructField("file_path", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])
CHATS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("sources", T.ArrayType(T.StringType()), True),
    T.StructField("created_at", T.TimestampType(), False),
])
EXPORTS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("storage_path", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])


def new_id() -> Column:
    return F.expr("uuid()")


def dataset_rows(reports: DataFrame, user_id: str, ids: Column | None = None,
                 created_at: Column | None = None) -> DataFrame:
    """S4 input: one catalogue row per report (the report stored as JSON, S17)."""
    rid = ids if ids is not None else new_id()
    ts = created_at if created_at is not None else F.current_timestamp()
    return reports.select(
        rid.alias("id"), F.lit(user_id).alias("user_id"), F.col("dataset").alias("name"),
        F.lit("ready").alias("status"), F.col("total_rows").cast("long").alias("rows"),
        F.col("total_columns").cast("int").alias("columns"),
        F.col("health_score").cast("int").alias("health_score"),
        F.to_json(F.struct(*[c for c in reports.columns if c != "dataset"])).alias("report"),
        F.concat(F.lit(user_id), F.lit("/"), rid, F.lit(".csv")).alias("file_path"),
        ts.cast("timestamp").alias("created_at"))


#: Rows of a catalogue file at most.
FILE_ROWS = 1_000_000


def append(df: DataFrame, path: str, batch: str | None = None, partitions: int | None = None) -> None:
    """S4/S9/S11 + S16: append one batch, partitioned by owner, by recency.

    A batch is a folder of its own that is written as a whole, so a batch that is
    appended again under the same id (a job retried after a lost driver) replaces
    itself and its rows stand once.  Without an id every call is a batch.  Rows
    are dealt by ranges of owner and time: an owner with half of all rows is
    written by many tasks, and each of its files holds a stretch of time."""
    by = [F.col("user_id"), F.desc("created_at")]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    (ranged.sortWithinPartitions(*by).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
           .partitionBy("user_id").parquet(f"{path}/batch={batch or uuid.uuid4().hex}"))


def owned(df: DataFrame, user_id: str) -> DataFrame:
    """The owner's rows only (partition pruning on user_id)."""
    return df.where(F.col("user_id") == user_id)


def list_datasets(datasets: DataFrame, user_id: str) -> DataFrame:
    """S5 + K12: seven columns, newest first (id breaks ties)."""
    return (owned(datasets, user_id)
            .select("id", "name", "status", "rows", "columns", "health_score", "created_at")
            .orderBy(F.desc("created_at"), "id"))


def get_report(datasets: DataFrame, dataset_id: str, user_id: str, report_schema=None) -> DataFrame:
    """S6 + J4: the report of one dataset with its id and name attached."""
    row = owned(datasets, user_id).where(F.col("id") == dataset_id)
    if report_schema is None:
        return row.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), "report")
    return row.select(F.from_json("report", report_schema).alias("r"), F.col("id").alias("dataset_id"),
                      F.col("name").alias("dataset_name")).select("r.*", "dataset_id", "dataset_name")


def summaries(datasets: DataFrame) -> DataFrame:
    """S7 + X9 + X10: the lenient summary projection of every stored report.

    status: ``report_not_found`` (null report), ``invalid_json``,
    ``unsupported`` (valid JSON that is not an object) or ``ok``."""
    v = F.try_parse_json(F.col("report"))

    def get(path: str, t: str) -> Column:
        return F.try_variant_get(v, f"$.{path}", t)

    def as_int(path: str) -> Column:
        # Python int(): ints, floats truncated, integer strings; anything else 0.
        # A variant -> bigint cast follows the same rules (3.7 -> 3, "3.7" -> null).
        return F.coalesce(get(path, "bigint"), F.lit(0)).cast("long")

    def as_float(path: str) -> Column:
        return F.coalesce(get(path, "double"), F.lit(0.0))

    def as_list(path: str) -> Column:
        arr = F.try_variant_get(v, f"$.{path}", "array<string>")
        return F.coalesce(F.filter(arr, lambda x: x.isNotNull()), F.array().cast("array<string>"))

    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    status = (F.when(F.col("report").isNull(), "report_not_found")
               .when(v.isNull(), "invalid_json")
               .when(~is_obj, "unsupported")
               .otherwise("ok"))
    ok = status == "ok"
    return datasets.select(
        "id", "name", status.alias("status"),
        F.when(ok, as_int("health_score")).alias("health_score"),
        F.when(ok, as_float("missing_pct")).alias("missing_pct"),
        F.when(ok, as_int("duplicate_rows")).alias("duplicate_rows"),
        F.when(ok, as_int("outlier_count")).alias("outlier_count"),
        F.when(ok, as_int("total_rows")).alias("total_rows"),
        F.when(ok, as_int("total_columns")).alias("total_columns"),
        F.when(ok, as_list("bias_flags")).alias("bias_flags"),
        F.when(ok, as_list("recommendations")).alias("recommendations"))


def delete_cascade(datasets: DataFrame, chats: DataFrame, exports: DataFrame,
                   doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S8 + J5: remove the ``doomed`` (id, user_id) datasets and, like the
    ON DELETE CASCADE foreign keys, their chats and exports.  The doomed set
    is joined as a regular (shuffled or broadcast by AQE) anti-join, so its
    size is not assumed."""
    real = datasets.select("id", "user_id").join(doomed.select("id", "user_id"), ["id", "user_id"], "left_semi")
    keep_ds = datasets.join(real, ["id", "user_id"], "left_anti")
    dk = real.select(F.col("id").alias("dataset_id")).distinct()
    return (keep_ds, chats.join(dk, "dataset_id", "left_anti"), exports.join(dk, "dataset_id", "left_anti"))


def store(root: str, batch: str | None = None, **tables: DataFrame) -> None:
    """Append tables, as one batch each, to a catalogue folder."""
    for name, df in tables.items():
        append(df, f"{root}/{name}", batch)


def _rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows that lie in a table's files; batch and owner stay text whatever
    they look like ("007" is not 7)."""
    path = f"{root}/{name}"
    fields = spark.read.parquet(path).schema.fields
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("batch", "user_id") else f.dataType) for f in fields])
    return spark.read.schema(schema).parquet(path)


def _file_system(spark: SparkSession, path: str, is_uri: bool = False):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if is_uri else path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions of a catalogue that may be read: 0 (nothing deleted) and one
    for each delete that was written to its end."""
    fs, marks = _file_system(spark, f"{root}/deleted/version=*/_SUCCESS")
    found = fs.globStatus(marks) or []
    return sorted({0, *(int(f.getPath().getParent().getName().split("=")[1]) for f in found)})


def _deleted(spark: SparkSession, root: str, version: int) -> DataFrame | None:
    """Datasets (id, owner) deleted up to a version; None if there are none."""
    done = [v for v in versions(spark, root) if 0 < v <= version]
    if not done:
        return None
    return spark.read.schema("gone_id STRING, gone_owner STRING").parquet(*[f"{root}/deleted/version={v}" for v in done])


def _is_gone(rows: DataFrame, name: str, gone: DataFrame):
    """Datasets go with their owner, chats and exports with their dataset."""
    if name == "datasets":
        return (rows["id"] == gone["gone_id"]) & (rows["user_id"] == gone["gone_owner"])
    return rows["dataset_id"] == gone["gone_id"]


def load(spark: SparkSession, root: str, version: int, name: str) -> DataFrame:
    """One table as of a version: its rows without what deletes up to it took."""
    rows, gone = _rows(spark, root, name).drop("batch"), _deleted(spark, root, version)
    return rows if gone is None else rows.join(gone, _is_gone(rows, name, gone), "left_anti")


def delete_stored(spark: SparkSession, root: str, version: int, doomed: DataFrame) -> int:
    """S8 + J5 persisted: the catalogue without ``doomed`` (id, user_id) becomes the
    next version; returns its number.

    A delete writes one list, of the datasets that it takes; readers of the new
    version leave out those and, like ON DELETE CASCADE, their chats and exports.
    So the three tables change at once, when the list is complete, no file of any
    table is touched, readers of the old version are not disturbed, and a delete
    that is retried writes the same list to the same place.  Ids of datasets are
    never used again (they are UUIDs).  Deletes follow one another: the number of a
    version belongs to the delete that took it.  ``vacuum`` removes the rows."""
    there = load(spark, root, version, "datasets").select("id", "user_id")
    taken = there.join(doomed.select("id", "user_id"), ["id", "user_id"], "left_semi")
    (taken.select(F.col("id").alias("gone_id"), F.col("user_id").alias("gone_owner")).distinct()
          .write.mode("overwrite").parquet(f"{root}/deleted/version={version + 1}"))
    return version + 1


def vacuum(spark: SparkSession, root: str, version: int) -> None:
    """Remove the rows that deletes up to ``version`` took from the files.

    Only folders (one batch of one owner) that hold such rows are written again, by
    dynamic partition overwrite; those that hold nothing else are removed; the files
    of all others stay as they are.  Readers of that and later versions see the same
    rows before, during and after it, older versions lose what was taken.  It may be
    broken off and run again at any time."""
    gone = _deleted(spark, root, version)
    if gone is None:
        return
    for name in ("chats", "exports", "datasets"):
        rows = _rows(spark, root, name)
        rows = rows.select(*rows.columns, F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("folder"))
        marks = gone.select("gone_id", "gone_owner", F.lit(True).alias("is_gone"))
        if name != "datasets":
            marks = marks.drop("gone_owner").distinct()
        marked = rows.join(marks, _is_gone(rows, name, marks), "left")
        alive = F.count_if(F.col("is_gone").isNull())
        touched = materialize(marked.groupBy("folder").agg(alive.alias("alive"), F.count("is_gone").alias("gone")).where("gone > 0"), f"{stage_dir(spark)}/touched")
        kept = rows.join(touched.where("alive > 0").select("folder"), "folder", "left_semi")
        kept = kept.join(gone, _is_gone(kept, name, gone), "left_anti").drop("folder")
        by = ["batch", F.col("user_id"), F.desc("created_at")]
        (kept.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .option("maxRecordsPerFile", FILE_ROWS).partitionBy("batch", "user_id").parquet(f"{root}/{name}"))
        for r in touched.where("alive = 0").select("folder").toLocalIterator():  # names of folders, no rows
            fs, folder = _file_system(spark, r.folder, is_uri=True)
            fs.delete(folder, True)


def export_lookup(exports: DataFrame, datasets: DataFrame, user_id: str) -> DataFrame:
    """S11 + J5: an owner's exports of datasets that the owner still has."""
    mine = owned(datasets, user_id).select(F.col("id").alias("dataset_id"))
    return owned(exports, user_id).join(mine, "dataset_id", "left_semi")


def orphans(children: DataFrame, datasets: DataFrame) -> DataFrame:
    """Child rows whose dataset does not exist."""
    return children.join(datasets.select(F.col("id").alias("dataset_id")), "dataset_id", "left_anti")


def dataset_violations(datasets: DataFrame) -> DataFrame:
    """S13 for datasets: status domain and score range."""
    bad_status = ~F.col("status").isin(*C.DATASET_STATUSES)
    bad_score = ~F.col("health_score").between(0, 100)
    return (datasets.where(bad_status | bad_score)
            .select("id", F.when(bad_status, "status").otherwise("health_score").alias("violation")))


def chat_violations(chats: DataFrame) -> DataFrame:
    """S13 for chats: role domain."""
    return chats.where(~F.col("role").isin(*C.CHAT_ROLES)).select("*", F.lit("role").alias("violation"))


def chat_pairs(answered: DataFrame, user_id: Column) -> DataFrame:
    """Two chat rows per exchange sharing one timestamp; only the
    assistant row carries ``sources``."""
    ts = F.current_timestamp()
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"),
                 F.lit(None).cast("array<string>").alias("sources")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"),
                 F.array(*[F.lit(s) for s in C.CHAT_SOURCES]).alias("sources")))
    return (answered.select(F.col("dataset_id"), user_id.alias("user_id"), ts.alias("created_at"),
                            F.explode(pair).alias("m"))
            .select(new_id().alias("id"), "dataset_id", "user_id", "m.role", "m.content", "m.sources",
                    "created_at"))


def chat_history(chats: DataFrame) -> DataFrame:
    """S10 + K12: oldest first; within one timestamp the question before the
    answer (the pair shares its timestamp)."""
    return chats.orderBy("dataset_id", "created_at", F.when(F.col("role") == "user", 0).otherwise(1))


def admission(listing: DataFrame, max_bytes: int | None = C.MAX_FILE_BYTES) -> DataFrame:
    """S3 over a listing (path, length) from any source: allowed suffix and at most
    ``max_bytes`` (by default the reference's 50 MiB; None admits any size)."""
    suf = path_suffix(F.col("path"))
    ok_type = suf.isin(*C.ALLOWED_SUFFIXES)
    ok_size = F.col("length") <= max_bytes if max_bytes is not None else F.lit(True)
    reason = (F.when(~ok_type, F.concat(F.lit("Unsupported file type '"), suf, F.lit("'. Use CSV or Excel.")))
               .when(~ok_size, F.lit("File exceeds the 50 MB limit.")))
    return listing.select("path", "length", suf.alias("suffix"), (ok_type & ok_size).alias("admitted"),
                          reason.alias("reason"))


def admit_files(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """S3: the files of a folder (contents are not read); by default of any size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return admission(files.select("path", "length"), max_bytes)
