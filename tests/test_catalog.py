"""S7 lenient summaries (FIXTURES section 7), S8 cascade, S13/S14 checks."""

from dqengine.operators.catalog import chat_violations, delete_cascade, orphans, summaries


def test_summaries(spark):
    rows = [
        ("1", "a", '{"health_score":81,"missing_pct":1.5,"bias_flags":["x",null,"y"]}'),
        ("2", "b", '{"health_score":"3.7","missing_pct":"abc","bias_flags":"x"}'),
        ("3", "c", '{"health_score":3.7,"missing_pct":"2.5"}'),
        ("4", "d", "{bad"),
        ("5", "e", None),
    ]
    df = spark.createDataFrame(rows, "id STRING, name STRING, report STRING")
    got = {r.name: (r.status, r.health_score, r.missing_pct, r.bias_flags)
           for r in summaries(df).collect()}
    assert got["a"] == ("ok", 81, 1.5, ["x", "y"])
    assert got["b"] == ("ok", 0, 0.0, [])
    assert got["c"] == ("ok", 3, 2.5, [])
    assert got["d"][0] == "invalid_json"
    assert got["e"][0] == "report_not_found"


def test_cascade_and_checks(spark):
    ds = spark.createDataFrame([("d1", "u1"), ("d2", "u1"), ("d3", "u2")], "id STRING, user_id STRING")
    chats = spark.createDataFrame(
        [("c1", "d1", "user"), ("c2", "d2", "assistant"), ("c3", "d9", "user"), ("c4", "d3", "system")],
        "id STRING, dataset_id STRING, role STRING")
    exports = spark.createDataFrame([("e1", "d1"), ("e2", "d3")], "id STRING, dataset_id STRING")
    doomed = ds.where("id = 'd1'")
    kept_ds, kept_chats, kept_exports = delete_cascade(ds, chats, exports, doomed)
    assert sorted(r.id for r in kept_ds.collect()) == ["d2", "d3"]
    assert sorted(r.id for r in kept_chats.collect()) == ["c2", "c3", "c4"]
    assert sorted(r.id for r in kept_exports.collect()) == ["e2"]
    assert [r.id for r in orphans(chats, ds).collect()] == ["c3"]
    assert [r.id for r in chat_violations(chats).collect()] == ["c4"]


def test_cascade_needs_the_owner(spark):
    ds = spark.createDataFrame([("d1", "u1"), ("d2", "u2")], "id STRING, user_id STRING")
    chats = spark.createDataFrame([("c1", "d1"), ("c2", "d2")], "id STRING, dataset_id STRING")
    doomed = spark.createDataFrame([("d1", "intruder"), ("d2", "u2")], "id STRING, user_id STRING")
    kept = delete_cascade(ds, chats, chats, doomed)
    assert [[r.id for r in k.collect()] for k in kept] == [["d1"], ["c1"], ["c1"]]


def test_batches_stand_once_and_hot_owners_are_dealt_out(spark, tmp_path):
    from pyspark.sql import functions as F
    from dqengine.operators.catalog import append, load
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 40)).alias("user_id"),
                                    F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("created_at"))
    path = f"{tmp_path}/t"
    for batch in ("a", "b", "a"):
        append(rows.where(F.col("id").cast("long") < 2000) if batch == "a" else rows.where(F.col("id").cast("long") >= 2000), path, batch, partitions=8)
    got = load(spark, str(tmp_path), 0, "t")
    assert got.columns == ["id", "created_at", "user_id"] and sorted(r.id for r in got.collect()) == sorted(str(i) for i in range(4000))
    hot = got.where("user_id = 'hot'")
    assert len(hot.select(F.input_file_name().alias("f")).distinct().collect()) >= 6  # of 16 tasks, half of the rows
    assert all("user_id=u1/" in f for f in (r.f for r in got.where("user_id = 'u1'").select(F.input_file_name().alias("f")).distinct().collect()))
    append(rows.limit(3), path)
    append(rows.limit(3), path)
    assert load(spark, str(tmp_path), 0, "t").count() == 4006
