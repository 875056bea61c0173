"""Steps whose work must grow no faster than their input."""

import hashlib
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.functions import maps
from quillon.functions import text as t
from quillon.operators import delegation, integrity, plugins, references, structure
from quillon.operators import search as srch
from quillon.sources import buckets, resolver


def test_snapshot_identity_of_many(spark):
    """Ids are hashed in two levels whatever their number."""
    n = 300_000
    got = integrity.snapshot_identity(spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("record_id"))).collect()
    groups = {}
    for k in sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)):
        groups.setdefault(k[:2], hashlib.sha256()).update(k.encode())
    want = hashlib.sha256("".join(groups[p].hexdigest() for p in sorted(groups)).encode()).hexdigest()
    assert [tuple(r) for r in got] == [(want, n)]
    none = integrity.snapshot_identity(spark.createDataFrame([], "record_id string")).collect()
    assert [tuple(r) for r in none] == [(None, None)]


def test_plugin_by_request(spark):
    """Requests that are answered by themselves stay where they are, however many one page has."""
    calls = lambda pdf: pdf.assign(markdown=[None if a is None else a + "!" for a in pdf["arguments"]], error=None)
    registry = plugins.Registry()
    registry.add("one", ["a"], calls, contract="request")
    registry.add("two", ["b"], lambda pdf: pdf.assign(markdown="page of " + str(len(pdf)), error=None))
    asked = spark.range(900).select(F.col("id").alias("request_no"), F.when(F.col("id") % 3 == 0, "two").otherwise("one").alias("owner"), F.lit("p").alias("path"), F.lit("a").alias("name"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("arguments"))
    rows = {r["request_no"]: (r["owner"], r["markdown"]) for r in plugins.run_plugins(asked, registry).collect()}
    assert rows == {i: ("two", "page of 300") if i % 3 == 0 else ("one", f"{i}!" if i % 7 else None) for i in range(900)}
    alone = plugins.Registry()
    alone.add("one", ["a"], calls, contract="request")
    routed = references.routed(asked.drop("owner"), alone.table(spark)).drop("error")
    plan = plugins.run_plugins(routed, alone)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1


def test_hits_are_looked_for_once(spark):
    """The plan has two patterns for each term and field, however often places are used."""
    rows = spark.createDataFrame([(1, "xthe the_ THE", "the"), (2, "Theory aThe", "x"), (3, None, "a.the"), (4, "😀the", "")], "id int, body string, name string")
    found = srch.matched(rows, {"body": "body", "identifier": "name"}, "the").select("id", F.explode("matches").alias("m"))
    got = sorted((r["id"], r["m"]["field"], r["m"]["start"], r["m"]["end"]) for r in found.collect())
    assert got == [(1, "body", 10, 13), (1, "identifier", 0, 3), (2, "body", 8, 11), (3, "identifier", 2, 5), (4, "body", 1, 4)]
    plan = found.where("m.start >= 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 4


def test_places_in_many_lines(spark):
    """Each line is looked at once; 20,000 lines took minutes while the view was made again for each."""
    odd = ["", "a", "\r\n", "\r\r\n\n\r", "\0\r\n\0x\r\n", "é\r\n😀\r", "ab\r\ncd\r\n"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    for at in range(6):
        got = df.select("x", t.lf(F.col("x")).alias("v"), t.source_offset(F.col("x"), F.lit(at)).alias("s")).collect()
        for r in got:
            assert r["v"] == re.sub("\r\n?", "\n", r["x"])
            if at <= len(r["v"]):
                marked = r["x"].replace("\r\n", "\x01")
                assert r["s"] == at + marked[:at].count("\x01")
    long = spark.range(1).select(F.repeat(F.lit("a line of words\r\n"), 20_000).alias("x"))
    began = time.time()
    assert long.select(t.source_offset(F.col("x"), F.length(t.lf(F.col("x"))))).first()[0] == 20_000 * 17
    assert time.time() - began < 20


def test_entries_are_met_once(spark):
    """Facts come with the kinds that paths are checked by; what asks for the root meets all entries where they are."""
    entries = [("a", "directory", None), ("a/f", "file", None), ("a/l", "link", "../b"), ("b", "directory", None), ("b/g", "file", None), ("c", "link", "a/l/g")]
    table = spark.createDataFrame(entries, "path string, kind string, target string").withColumns({"identity": F.upper("path"), "n_bytes": F.lit(1), "sha256": F.lit("x")})
    asked = spark.createDataFrame([("a/f", "file"), ("c", "file"), ("c", "unlinked_file"), (".", "directory"), ("a/no", "metadata"), ("a/l/../a", "metadata"), ("a/f/x", "metadata")], "path string, ask string")
    got = resolver.facts(asked, table)
    rows = sorted((r["path"], r["ask"], r["resolved"], r["node"], r["identity"], r["sha256"]) for r in got.where("missing IS NULL").collect())
    assert rows == [(".", "directory", "", "directory", None, None), ("a/f", "file", "a/f", "file", "A/F", "x"), ("a/l/../a", "metadata", "a", "directory", "A", None), ("c", "file", "b/g", "file", "B/G", "x"), ("c", "unlinked_file", "b/g", "file", "B/G", None)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(got).count("Join") == plan(resolver.resolve(asked, table)).count("Join")
    found = resolver.members(spark.createDataFrame([("", False), (".", True), ("a", False), ("a/l", True)], "path string, recursive boolean"), table)
    listed = {}
    for r in found.collect():
        listed.setdefault(r["path"], set()).add(r["member"])
    assert listed == {"": {"a", "b", "c"}, ".": {e[0] for e in entries}, "a": {"a/f", "a/l"}, "a/l": {"b/g"}}
    assert "BroadcastNestedLoopJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_number_of_buckets_is_bounded(spark, tmp_path, monkeypatch):
    """Folders don't grow with the rows without end; a table at the bound isn't dealt anew by each round."""
    monkeypatch.setattr(buckets, "BUCKETS", 8)
    t = buckets.Buckets(spark, f"file://{tmp_path}", "id")
    rows = lambda a, b, v: spark.range(a, b).select("id", F.lit(v).alias("v"))
    none = spark.createDataFrame([], "id long")
    assert t.write(rows(0, 1000, 0), "a", per_bucket=10) == 8
    assert t.apply(rows(5, 6, 1), none, "b", per_bucket=10) == 1
    assert [(r["id"], r["state"]) for r in t.differences("a", "b", ["v"]).collect()] == [(5, "changed")]
    assert t.apply(none.selectExpr("id", "0 AS v"), rows(0, 1000, 0).select("id"), "c", per_bucket=10) == 8
    assert t.read("c").count() == 0 and t.violations("c").count() == 0


def test_texts_are_made_some_at_a_time(monkeypatch):
    """A batch of any length holds the objects of a few texts only."""
    lengths, whole = [], maps._made
    monkeypatch.setattr(maps, "_made", lambda pairs: lengths.append(len(pairs)) or whole(pairs))
    texts = [None if i % 9 == 0 else f"a{i}\r\nb" for i in range(1000)]
    got = maps._stepped(pa.array(texts), ("lf",)).to_pylist()
    assert [None if g["text"] is None else g["text"] for g in got] == [None if x is None else x.replace("\r\n", "\n") for x in texts]
    assert max(lengths) <= maps.TOGETHER and len(maps._stepped(pa.array([], pa.string()), ("lf",))) == 0


def test_contents_are_parsed_once(spark):
    """The plan parses a content's list once; a plain string is an argument at sight."""
    rows = spark.createDataFrame([(1, '[{"kind":"text","markdown":"m"}]'), (2, "[]"), (3, None)], "request int, content string")
    got = delegation.nodes(rows)
    assert sorted((r["request"], r["markdown"], r["error"]) for r in got.collect()) == [(1, "m", None), (2, None, "empty_content"), (3, None, "invalid_content")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    plain = spark.range(1).select(structure.arguments(F.lit('"a b"')).alias("a")).first()["a"]
    assert (plain["positional"], plain["named"], plain["error"]) == (['"a b"'], {}, None)
