import glob
import os

import pytest
from pyspark.sql import functions as F

from quillon.sources import snapshots
from quillon.sources.buckets import Buckets


def rows(spark, n, add=0):
    return spark.range(n).select("id", F.concat(F.lit("v"), (F.col("id") + add).cast("string")).alias("value"), F.lit(None).cast("int").alias("_none"))


def state(t, snapshot=None):
    return {r["id"]: r["value"] for r in t.read(snapshot).collect()}


def test_one_change_writes_one_bucket(spark, tmp_path):
    t = Buckets(spark, str(tmp_path), "id")
    assert t.write(rows(spark, 1000), "a", per_bucket=50) == 20
    folders = lambda s: {r["bucket"]: r["folder"] for r in t.manifest(s).collect()}
    none = rows(spark, 0).select("id")
    assert t.apply(rows(spark, 1, 7), none, "b", per_bucket=50) == 1
    assert len(set(folders("a").items()) ^ set(folders("b").items())) == 2
    assert state(t, "a")[0] == "v0" and state(t) == {**state(t, "a"), 0: "v7"}
    new = spark.createDataFrame([(None, "null", 1), (5000, "new", None)], "id long, value string, _none int")
    assert t.apply(new, spark.createDataFrame([(1,), (2,), (None,), (9999,)], "id long"), "c", per_bucket=50) <= 6
    want = {k: v for k, v in state(t, "b").items() if k not in (1, 2)} | {None: "null", 5000: "new"}
    assert state(t) == want and t.meta()["n"] == len(want)
    got = {r["id"]: r["state"] for r in t.differences("a", "c", ["value"]).collect()}
    assert got == {0: "changed", 1: "removed", 2: "removed", None: "added", 5000: "added"}
    assert t.differences("b", "b", ["value"]).count() == 0
    assert t.apply(rows(spark, 0), none, "d") == 0 and t.current() == "c"
    with pytest.raises(RuntimeError):
        t.apply(rows(spark, 1), none, "e", expected="a", per_bucket=50)
    with pytest.raises(ValueError):
        t.apply(rows(spark, 1).union(rows(spark, 1)), none, "f")
    # Beyond so many rows a bucket the table is dealt out anew.
    assert t.apply(rows(spark, 5000, 1), none, "g", per_bucket=50) > 20
    assert len(state(t)) == 5002 and {r["id"]: r["state"] for r in t.differences("c", "g", ["value"]).where("id < 4").collect()} == {0: "changed", 1: "added", 2: "added", 3: "changed"}
    before = len(glob.glob(f"{tmp_path}/data/*/_bucket=*"))
    assert t.collect(keep=1) > 0 and len(glob.glob(f"{tmp_path}/data/*/_bucket=*")) < before
    assert len(state(t)) == 5002 and t.violations().count() == 0 and snapshots.current(spark, str(tmp_path)) == "g"
    with pytest.raises(Exception, match="a"):
        state(t, "a")


def test_an_empty_table(spark, tmp_path):
    t = Buckets(spark, str(tmp_path), "id")
    t.write(rows(spark, 0), "a")
    assert state(t) == {} and t.violations().count() == 0
    t.apply(rows(spark, 3), rows(spark, 0).select("id"), "b")
    assert state(t) == {0: "v0", 1: "v1", 2: "v2"}
    t.apply(rows(spark, 0), rows(spark, 3).select("id"), "c")
    assert state(t) == {} and t.violations().count() == 0


def damaged(t):
    return sorted(tuple(r) for r in t.violations().collect())


def test_damage_is_found(spark, tmp_path):
    def fresh(name):
        t = Buckets(spark, str(tmp_path / name), "id")
        t.write(rows(spark, 300), "a", per_bucket=100)
        assert damaged(t) == []
        return t, sorted(glob.glob(f"{tmp_path / name}/data/*/_bucket=1/*.parquet"))[0]

    t, part = fresh("flipped")
    data = bytearray(open(part, "rb").read())
    data[len(data) // 2] ^= 0x40
    open(part, "wb").write(bytes(data))
    assert damaged(t) == [("digest", "1")]
    t, part = fresh("lost")
    os.remove(part)
    assert damaged(t) == [("digest", "1")]
    t, part = fresh("gone")
    os.rename(os.path.dirname(part), str(tmp_path / "away"))
    assert [c for c, _ in damaged(t)] == ["digest", "missing_bucket"]
    t, part = fresh("more")
    there = spark.read.parquet(part)
    own = there.first()["id"]
    spark.createDataFrame([(own, "x", None)], there.schema).coalesce(1).write.mode("append").parquet(os.path.dirname(part))
    assert damaged(t) == [("digest", "1"), ("key_twice", str(own))]
    t, part = fresh("strange")
    other = spark.range(1000).where((F.pmod(F.xxhash64("id"), F.lit(3)) != 1) & (F.col("id") >= 300)).first()["id"]
    spark.createDataFrame([(other, "x", None)], there.schema).coalesce(1).write.mode("append").parquet(os.path.dirname(part))
    assert damaged(t) == [("digest", "1"), ("misplaced", str(other))]
    t, _ = fresh("version")
    at = f"{tmp_path}/version/snapshot=a/meta"
    meta = spark.createDataFrame(spark.read.parquet(at).collect(), spark.read.parquet(at).schema).withColumn("version", F.lit(9))
    meta.write.mode("overwrite").parquet(at)
    assert damaged(t) == [("version", "9")]
    with pytest.raises(ValueError):
        t.read()
    t, _ = fresh("root")
    at = f"{tmp_path}/root/snapshot=a/manifest"
    manifest = spark.createDataFrame(spark.read.parquet(at).collect(), spark.read.parquet(at).schema)
    manifest.withColumn("n", F.col("n") + (F.col("bucket") == 2).cast("int")).where("bucket != 0").write.mode("overwrite").parquet(at)
    assert [c for c, _ in damaged(t)] == ["root"]


def test_canonical_export(spark, tmp_path):
    t = Buckets(spark, str(tmp_path / "t"), "id")
    t.write(spark.createDataFrame([(2, "é\"/", None), (1, "b", 3)], "id long, `z` string, a int"), "a")
    t.export(str(tmp_path / "out"))
    lines = [x for p in sorted(glob.glob(f"{tmp_path}/out/part-*")) for x in open(p, encoding="utf-8").read().splitlines()]
    assert lines == ['{"a":3,"id":1,"z":"b"}', '{"a":null,"id":2,"z":"é\\"/"}']
