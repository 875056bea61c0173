import pytest
from pyspark.sql import functions as F

from quillon.sources import files, snapshots
from quillon.sources.buckets import Buckets
from quillon.streaming import watch


def test_scan_selects_and_decodes(spark, tmp_path):
    for name, data in {"a.md": b"# A\n", "src/b.rs": b"fn f() {}\n", "src/.git/c.rs": b"x", "target/d.rs": b"x", "e.bin": b"x", "out/pages/p.md": b"x", "bad.md": b"a\xff", "bom.md": b"\xef\xbb\xbfx", "nul.md": b"a\0b"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = files.decoded(files.scan(spark, str(tmp_path), output="out")).orderBy("path").collect()
    assert [(r["path"], r["error"], r["text"]) for r in got] == [("a.md", None, "# A\n"), ("bad.md", "invalid_utf8", None), ("bom.md", "byte_order_mark", None), ("nul.md", "nul", None), ("src/b.rs", None, "fn f() {}\n")]


def test_valid_paths(spark):
    cases = {"a/b.md": True, "../a": False, "a//b": False, "a/./b": False, "": False, "a\x01": False, "..a/b": True}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", files.valid_path(F.col("p")).alias("ok")).collect()
    assert {r["p"]: r["ok"] for r in got} == cases


def test_settings():
    got = files.settings('config_version = 1\n[inputs]\nexclude = ["x"]\n[plugins.p]\ncommand = ["c"]\ndirectives = ["d"]\n')
    assert got["plugins"]["p"]["timeout_ms"] == 30_000
    for bad in ("config_version = 2", "config_version = 1\nx = 1", 'config_version = 1\n[plugins.p]\ncommand = ["c"]\ndirectives = ["d"]\noverride = ["e"]'):
        with pytest.raises(ValueError):
            files.settings(bad)


def test_directives_of_settings():
    head = 'config_version = 1\n[plugins.p]\ncommand = ["c"]\n'
    two = '[plugins.q]\ncommand = ["c"]\n'
    for good in ('directives = ["a.b", "c-d"]\n', 'directives = ["link"]\noverride = ["link"]\n', f'directives = ["a"]\n{two}directives = ["b"]\n'):
        files.settings(head + good)
    for bad in ('directives = ["A"]\n', 'directives = ["a."]\n', 'directives = [1]\n', 'directives = ["a", "a"]\n', 'directives = ["include"]\n', f'directives = ["a"]\n{two}directives = ["a"]\n', f'directives = ["link"]\noverride = ["link"]\n{two}directives = ["link"]\noverride = ["link"]\n', 'directives = ["a"]\noverride = ["a"]\n', 'directives = ["link"]\noverride = ["link", "link"]\n'):
        with pytest.raises(ValueError):
            files.settings(head + bad)


def test_publication(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.current(spark, root) is None
    snapshots.publish(spark, root, {"rows": spark.range(3)}, "1")
    snapshots.publish(spark, root, {"rows": spark.range(5)}, "2", expected="1")
    assert snapshots.current(spark, root) == "2" and snapshots.table(spark, root, "rows").count() == 5
    with pytest.raises(RuntimeError):
        snapshots.publish(spark, root, {"rows": spark.range(7)}, "3", expected="1")
    assert snapshots.table(spark, root, "rows").count() == 5 and snapshots.table(spark, root, "rows", "1").count() == 3


def test_target_conflicts(spark):
    targets = spark.createDataFrame([("a/b",), ("a/b/c",), ("x",)], "path string")
    inputs = spark.createDataFrame([("x",)], "path string")
    assert sorted(tuple(r) for r in snapshots.target_conflicts(targets, inputs).collect()) == [("a/b", "parent_of_target"), ("x", "input")]


def test_stream_follows_files(spark, tmp_path):
    src, root, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    name = F.element_at(F.split("path", "/"), -1)
    build = lambda b: b.groupBy(name.alias("name")).agg(F.max_by(F.sha2("content", 256), "modificationTime").alias("hash"))

    def go():
        watch.follow(watch.file_changes(spark, str(src)), root, build, "name", ["hash"], ck).awaitTermination(60)

    (src / "a.md").write_text("one")
    go()
    assert snapshots.current(spark, root) == "000000000000"
    (src / "b.md").write_text("two")
    go()
    assert sorted(r["name"] for r in Buckets(spark, root, "name").read().collect()) == ["a.md", "b.md"]
    go()  # nothing new
    assert snapshots.current(spark, root) == "000000000001"


def test_stream_coalesces(spark, tmp_path):
    src = tmp_path / "in"
    ms = [0, 50, 90, 400, *range(1000, 2200, 90), 60_000]
    df = spark.createDataFrame([("p", m) for m in ms], "path string, ms long").select("path", F.timestamp_millis(F.col("ms") + 10_000).alias("ts"))
    df.coalesce(1).write.parquet(str(src))
    stream = watch.coalesced(spark.readStream.schema("path string, ts timestamp").parquet(str(src)), late="1 second")
    q = stream.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = sorted((r["first_ms"] - 10_000, r["last_ms"] - 10_000, r["n"]) for r in spark.table("bursts").collect())
    assert got[:4] == [(0, 90, 3), (400, 400, 1), (1000, 1990, 12), (2080, 2170, 2)]


def test_strongest(spark):
    df = spark.createDataFrame([("a", "content"), ("a", "removed"), ("a", "access"), ("b", "access")], "path string, kind string")
    assert [tuple(r) for r in watch.strongest(df).collect()] == [("a", "removed", 2)]
