"""Comparisons of snapshots and constraint checks; violations are rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.records import positions
from quillon.operators.stretches import Stretches


def compared(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: key and ``state``: added, removed, changed, same. Nulls equal nulls."""
    a = old.select(*key, *(F.col(v).alias(f"_a_{v}") for v in values), F.lit(True).alias("_old"))
    b = new.select(*key, *(F.col(v).alias(f"_b_{v}") for v in values), F.lit(True).alias("_new"))
    same = reduce(Column.__and__, (F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}")) for v in values), F.lit(True))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, state.alias("state"))


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """What only one of two sets has: key, side ('left' or 'right'). Empty if the sets are equal."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def members_after(members: DataFrame, removed: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """A folder's members after publication: what was there, less what went, with what came."""
    return members.select(key).join(removed.select(key), key, "left_anti").union(added.select(key)).distinct()


def position_gaps(rows: DataFrame, page: str, position: str) -> DataFrame:
    """Rows whose position is not their number, from 0, on their page."""
    out = positions(rows.withColumnRenamed(position, "_given"), page, "_given").withColumnRenamed("position", "expected")
    return out.where(F.col("expected") != F.col("_given")).withColumnRenamed("_given", position)


def unordered(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value is not above that of the row before, in a group, by a numeric order."""
    return Stretches(rows, group, F.col(order)).previous(F.col(value), "before").done().where(F.col("before") >= F.col(value))


def collisions(rows: DataFrame, handle: str, target: str) -> DataFrame:
    """Handles that stand for more than one target."""
    return rows.groupBy(handle).agg(F.count_distinct(target).alias("targets")).where("targets > 1")


def closure(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each id's place in a strict one-to-one pairing: key, status: ok, missing, unknown, duplicate."""
    left = requests.groupBy(key).agg(F.count("*").alias("_asked"))
    right = results.groupBy(key).agg(F.count("*").alias("_given"))
    status = F.when(F.col("_asked").isNull(), "unknown").when(F.col("_given").isNull(), "missing").when((F.col("_asked") > 1) | (F.col("_given") > 1), "duplicate").otherwise("ok")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def span_errors(spans: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Spans that don't fit their file, with ``error``: source_error, invalid_range, or wrong_lines.

    Spans are half-open byte ranges; start_line and end_line are 1-based and inclusive.
    """
    got = spans.join(files.select(path, F.encode("text", "UTF-8").alias("_bytes"), F.lit(True).alias("_there")), path, "left")
    head, body = F.substring(F.col("_bytes"), F.lit(1), F.col("start_byte")), F.substring(F.col("_bytes"), F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))
    # One character per byte: line feeds are counted without decoding.
    lines = lambda b: F.octet_length(b) - F.length(F.replace(F.decode(b, "ISO-8859-1"), F.lit("\n"), F.lit("")))
    legal = (F.col("start_byte") >= 0) & (F.col("start_byte") < F.col("end_byte")) & (F.col("end_byte") <= F.octet_length("_bytes")) & F.is_valid_utf8(body.cast("string"))
    first = lines(head) + 1
    last = first + lines(F.substring(body, F.lit(1), F.octet_length(body) - 1))
    error = F.when(F.col("_there").isNull(), "source_error").when(~legal, "invalid_range").when((F.col("start_line") != first) | (F.col("end_line") != last), "wrong_lines")
    return got.withColumn("error", error).where("error IS NOT NULL").drop("_bytes", "_there")


def index_violations(records: DataFrame, occurrences: DataFrame) -> DataFrame:
    """What is wrong with a snapshot: check, subject. Empty for a sound one.

    records: record_id, body, start_byte, end_byte; occurrences: record_id, page, position.
    """
    named = lambda df, check, subject: df.select(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"))
    return reduce(
        DataFrame.unionByName,
        [
            named(records.where(~F.col("record_id").rlike("^[0-9a-f]{64}$")), "id_form", "record_id"),
            named(records.groupBy("record_id").count().where("count > 1"), "id_twice", "record_id"),
            named(records.where("start_byte < 0 OR start_byte >= end_byte"), "span", "record_id"),
            named(occurrences.join(records.select("record_id"), "record_id", "left_anti"), "unknown_record", "record_id"),
            named(records.join(occurrences.select("record_id"), "record_id", "left_anti"), "no_occurrence", "record_id"),
            named(position_gaps(occurrences, "page", "position"), "position", "page"),
        ],
    )


def snapshot_identity(records: DataFrame, column: str = "record_id") -> DataFrame:
    """One hash over all records in the order of their ids: one row ``snapshot``, ``records``, both null without records.

    Ids with the same first two hex digits give a hash, and these hashes, in their order, the
    snapshot's, whatever the count. Ids are hashed as they come, sorted, so no group is held.
    """
    ids = records.select(F.left(F.col(column), F.lit(2)).alias("p"), F.col(column).alias("k"))
    level = ids.repartition("p").sortWithinPartitions("p", "k").mapInArrow(_hashed, "p string, h string, n long")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x.h), "")
    return level.agg(F.when(F.count("h") > 0, F.sha2(joined, 256)).alias("snapshot"), F.sum("n").alias("records"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of a prefix its ids' hash and count; null ids count, but aren't hashed."""
    prefix, sha, n, out = None, None, 0, []

    def end() -> None:
        if n:
            out.append({"p": prefix, "h": None if prefix is None else sha.hexdigest(), "n": n})

    for batch in batches:
        runs = pc.run_end_encode(batch["p"])
        at = 0
        for p, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if n == 0 or p != prefix:
                end()
                prefix, sha, n = p, hashlib.sha256(), 0
            sha.update("".join(k for k in batch["k"].slice(at, stop - at).to_pylist() if k is not None).encode())
            n, at = n + stop - at, stop
    end()
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("p", pa.string()), ("h", pa.string()), ("n", pa.int64())]))


def affected(changes: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that a change may touch: the same path, a folder above it, or, for folder facts, a member.

    changes: path; facts: fact, path, recursive. Each change is sent to itself and to the folders
    above, so all meets by equality.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("at"), (F.size(parts) - i).alias("above")))
    sent = changes.select(F.col("path").alias("changed"), F.explode(up).alias("u")).select("changed", F.col("u.at").alias("path"), F.col("u.above").alias("above"))
    down = facts.join(sent, "path").where("above = 0 OR (recursive IS NOT NULL AND (recursive OR above = 1))").select("fact", "changed")
    fparts = F.split("path", "/")
    fup = F.transform(F.sequence(F.lit(1), F.size(fparts)), lambda i: F.array_join(F.slice(fparts, 1, i), "/"))
    folders = facts.select("fact", F.explode(fup).alias("path"))
    gone = folders.join(changes.select("path", F.col("path").alias("changed")), "path").select("fact", "changed")
    return down.union(gone).distinct()
