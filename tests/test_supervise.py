import pytest
from pyspark.sql import functions as F

from quillon.streaming import supervise

SEQUENCES = {
    "plain": ([("begin",), ("fact", "a", "1"), ("ok",)], ["publish"]),
    "moved while it ran": ([("begin",), ("fact", "a", "1"), ("change", "a", "2"), ("ok",)], ["discard", "round"]),
    "same value": ([("begin",), ("fact", "a", "1"), ("change", "a", "1"), ("ok",), ("change", "a", "1")], ["publish"]),
    "asked for once": ([("begin",), ("fact", "a", "1"), ("fact", "b", "1"), ("ok",), ("change", "a", "2"), ("change", "b", "2"), ("begin",), ("fact", "a", "2"), ("fact", "b", "2"), ("ok",)], ["publish", "round a", "publish"]),
    "known fact repairs": ([("begin",), ("fact", "a", "1"), ("failed",), ("change", "a", "1"), ("change", "a", "2"), ("begin",), ("fact", "a", "2"), ("ok",)], ["retry a", "publish"]),
    "unknown repairs once": ([("begin",), ("fact", "a", "1"), ("failed",), ("change", "x", "1"), ("begin",), ("fact", "a", "1"), ("failed",), ("change", "x", "1"), ("change", "x", "2")], ["retry x", "retry x"]),
    "unknown without failure": ([("begin",), ("fact", "a", "1"), ("ok",), ("change", "x", "1")], ["publish"]),
    "fact of an older sample": ([("begin",), ("fact", "a", "1"), ("fact", "b", "1"), ("ok",), ("begin",), ("fact", "a", "1"), ("ok",), ("change", "b", "2")], ["publish", "publish"]),
    "moved then failed": ([("begin",), ("fact", "a", "1"), ("change", "a", "2"), ("failed",)], ["retry"]),
    "rescan while it ran": ([("begin",), ("fact", "a", "1"), ("rescan",), ("ok",), ("begin",), ("ok",)], ["discard", "round", "publish"]),
    "rescan when idle": ([("rescan",), ("rescan",), ("begin",), ("failed",), ("rescan",)], ["round", "retry"]),
}


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("cuts", [1, 4])
def test_sequences(spark, tmp_path, store, cuts):
    """The same actions whatever the batches; changes that come after the sample that holds them are absorbed."""
    rows = []
    for root, (events, _) in SEQUENCES.items():
        rows += [(root, 10 * i, *e, *[None] * (3 - len(e))) for i, e in enumerate(events)]
    rows.append(("plain", -5, "change", "a", "0"))  # from before the sample
    rows.sort(key=lambda r: r[1])
    schema = "root string, seq long, kind string, path string, value string"
    size = -(-len(rows) // cuts)
    for i in range(cuts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"actions{cuts}"
    query = supervise.supervised(events).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {}
    for r in sorted(spark.table(name).collect(), key=lambda r: (r["root"], r["seq"], r["action"])):
        got.setdefault(r["root"], []).append(r["action"] + (f" {r['path']}" if r["path"] else ""))
    assert got == {root: want for root, (_, want) in SEQUENCES.items()}


def test_reached_until_nothing_new(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "p string, q string")
    step = lambda now: edges.join(now.withColumnRenamed("folder", "p"), "p").select(F.col("q").alias("folder"))
    start = spark.createDataFrame([("a",), ("a",)], "folder string")
    assert sorted(map(tuple, supervise.until_nothing_new(start, step, "folder").collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert supervise.until_nothing_new(start.where("false"), step, "folder").count() == 0
