"""The written catalogue: versions, owners, lookups (the registered queries
check the rest against their oracles)."""

from dqengine.operators.catalog import delete_stored, export_lookup, load, store, vacuum, versions
from dqengine.session import stage_dir


def test_versions(spark):
    root = stage_dir(spark)
    ds = spark.createDataFrame([("1", "7", 1), ("2", "7", 2), ("3", "u", 3)], "id STRING, user_id STRING, created_at INT")
    ch = spark.createDataFrame([("a", "1", "7", 1), ("b", "3", "u", 1)], "id STRING, dataset_id STRING, user_id STRING, created_at INT")
    store(root, datasets=ds, chats=ch, exports=ch)
    doomed = spark.createDataFrame([("1", "7"), ("3", "other")], "id STRING, user_id STRING")
    now = delete_stored(spark, root, 0, doomed)
    assert now == 1
    assert sorted(r.id for r in load(spark, root, 1, "datasets").collect()) == ["2", "3"]
    assert [r.id for r in load(spark, root, 1, "chats").collect()] == ["b"]
    assert load(spark, root, 0, "datasets").count() == 3
    assert [r.id for r in export_lookup(ch, ds, "7").collect()] == ["a"]


def files(spark, root, table):
    import glob
    return {f: open(f, "rb").read() for f in glob.glob(f"{root}/{table}/**/*.parquet", recursive=True)}


def test_delete_writes_a_list_and_vacuum_the_touched_owners_only(spark, tmp_path):
    import os
    root = f"{tmp_path}/cat"
    owners = ["007", "7", "a b%/é", "1e3", "u"]
    ds = [(f"d{i}", owners[i % 5], i) for i in range(40)]
    ch = [(f"c{i}", f"d{i % 50}", owners[(i // 5) % 5], i) for i in range(200)]  # ten datasets that do not exist
    tables = {"datasets": spark.createDataFrame(ds, "id STRING, user_id STRING, created_at INT"),
              "chats": spark.createDataFrame(ch, "id STRING, dataset_id STRING, user_id STRING, created_at INT"),
              "exports": spark.createDataFrame(ch, "id STRING, dataset_id STRING, user_id STRING, created_at INT")}
    for batch in ("0123", "1e5"):
        half = 0 if batch == "0123" else 1
        store(root, batch, **{n: t.where(f"created_at % 2 = {half}") for n, t in tables.items()})
    assert sorted({r.user_id for r in load(spark, root, 0, "datasets").collect()}) == sorted(owners)
    before = {t: files(spark, root, t) for t in tables}
    doomed = [d for d in ds if d[1] == "a b%/é"] + [ds[0]]
    want = spark.createDataFrame([d[:2] for d in doomed] + [("d1", "u"), ("d99", "u")], "id STRING, user_id STRING")  # not theirs, not there

    assert [delete_stored(spark, root, 0, want) for _ in range(2)] == [1, 1] and versions(spark, root) == [0, 1]  # retried
    gone = {d[0] for d in doomed}
    left = {"datasets": {d[0] for d in ds} - gone, "chats": {c[0] for c in ch if c[1] not in gone}}
    left["exports"] = left["chats"]

    def seen(version):
        return {t: {r.id for r in load(spark, root, version, t).collect()} for t in tables}
    assert seen(1) == left and len(seen(0)["datasets"]) == 40 and before == {t: files(spark, root, t) for t in tables}
    os.makedirs(f"{root}/deleted/version=2/_temporary")  # a list that is not complete is no version
    assert versions(spark, root) == [0, 1] and seen(2) == left

    for _ in range(2):
        vacuum(spark, root, 1)
        assert seen(1) == left and seen(0) == left
    after = files(spark, root, "datasets")
    same = {f for f in after if before["datasets"].get(f) == after[f]}
    assert {o for o in ("007", "7", "1e3", "u") if any(f"user_id={o}/" in f for f in same)} == {"007", "7", "1e3", "u"}
    assert not [f for f in same if "batch=0123/user_id=007/" in f] and [f for f in same if "batch=1e5/user_id=007/" in f]
    assert len({os.path.dirname(f) for f in after}) == 8  # the emptied owner's folders are gone

    empty = spark.createDataFrame([], "id STRING, user_id STRING")
    assert delete_stored(spark, root, 1, empty) == 2 and seen(2) == left
    vacuum(spark, root, 2)
    assert seen(2) == left
