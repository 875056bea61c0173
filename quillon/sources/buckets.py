"""Tables in buckets by key, copied on write: a snapshot is a manifest of bucket folders, most of which it shares with the one before.

A round reads and writes the buckets that its changes fall in and no others. Each bucket has a
digest of its rows, and the manifest one of all buckets, so two snapshots are compared by
digests first, and loading can be verified.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.integrity import compared
from quillon.operators.tables import written
from quillon.sources import snapshots

#: The layout's version; another one isn't read.
VERSION = 1
#: Rows of a bucket, about, when a table is made; with ``MOST`` times as many it is dealt out anew.
ROWS, MOST = 50_000, 4
#: Buckets of a table at most: beyond, they hold more rows, since each is a folder and a file of each write, and a path for the driver.
BUCKETS = 512
PIECES = 4


def canonical_json(columns: list[str]) -> Column:
    """A row as JSON: members sorted by name, nulls kept, nothing between."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def digests(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Count and digest of the rows of each group: ``by``, n, digest.

    Each row's SHA-256 is cut in pieces of 60 bits, which are added up, so that tasks add up their
    own rows first, in any order, and no group is gathered.
    """
    h = F.sha2(canonical_json(columns), 256)
    pieces = [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(PIECES)]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(p).alias(f"_p{i}") for i, p in enumerate(pieces)))
    return sums.select(*by, "n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *(F.col(f"_p{i}").cast("string") for i in range(PIECES))), 256).alias("digest"))


def count_for(n: int, per_bucket: int) -> int:
    """How many buckets a table of ``n`` rows is dealt into."""
    return min(max(1, -(-n // per_bucket)), BUCKETS)


class Buckets:
    """A table of rows with one key column, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def current(self) -> str | None:
        return snapshots.current(self.spark, self.root)

    def manifest(self, snapshot: str | None = None) -> DataFrame:
        """bucket, folder (null where it is empty), n, digest."""
        return snapshots.table(self.spark, self.root, "manifest", snapshot)

    def meta(self, snapshot: str | None = None):
        """version, key, buckets, n, root, schema; ValueError for another version or key."""
        got = snapshots.table(self.spark, self.root, "meta", snapshot).first()
        if got is None or got["version"] != VERSION or got["key"] != self.key:
            raise ValueError(f"{self.root} has no table of version {VERSION} by {self.key}")
        return got

    def _of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _paths(self, snapshot: str | None, buckets: list[int] | None) -> list[str]:
        rows = self.manifest(snapshot).where("folder IS NOT NULL")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return [f"{self.root}/{r['folder']}" for r in rows.select("folder").collect()]

    def read(self, snapshot: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A snapshot's rows, of some buckets or all. The driver sees one path for each bucket, not rows."""
        schema = self.meta(snapshot)["schema"]
        paths = self._paths(snapshot, buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _stored(self, rows: DataFrame, buckets: int) -> DataFrame:
        """Write rows, each bucket in a folder of its own; bucket, folder, n, digest of what was written."""
        folder = f"data/{uuid.uuid4().hex}"
        schema = rows.schema
        dealt = rows.withColumn("_bucket", self._of(buckets)).repartition("_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        # The column of folders comes last, whatever the table's own columns are.
        back = self.spark.read.option("basePath", f"{self.root}/{folder}").schema(T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(f"{self.root}/{folder}")
        found = digests(back, ["_bucket"], [c for c in rows.columns if c != "_bucket"])
        return found.select(F.col("_bucket").alias("bucket"), F.concat(F.lit(f"{folder}/_bucket="), F.col("_bucket").cast("string")).alias("folder"), "n", "digest")

    def _publish(self, manifest: DataFrame, buckets: int, schema: str, snapshot: str, expected: str | None) -> None:
        manifest = written(manifest, "manifest")
        meta = self._root(manifest).select(F.lit(VERSION).alias("version"), F.lit(self.key).alias("key"), F.lit(buckets).alias("buckets"), "n", "root", F.lit(schema).alias("schema"))
        snapshots.publish(self.spark, self.root, {"manifest": manifest.coalesce(1), "meta": meta.coalesce(1)}, snapshot, expected)

    def _root(self, manifest: DataFrame) -> DataFrame:
        """n and one digest of a manifest's digests: a row for each bucket goes into it."""
        each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: F.concat_ws(":", x.bucket.cast("string"), x.digest)), ",")
        return manifest.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), F.sha2(each, 256).alias("root"))

    def write(self, rows: DataFrame, snapshot: str, expected: str | None = None, per_bucket: int = ROWS) -> int:
        """Publish rows as a whole new table. Returns the number of buckets. ValueError if a key comes twice."""
        rows = written(rows, "rows")
        if rows.groupBy(self.key).count().where("count > 1").head(1):
            raise ValueError(f"{self.key} isn't a key")
        buckets = count_for(rows.count(), per_bucket)
        self._publish(self._stored(rows, buckets), buckets, _ddl(rows), snapshot, expected)
        return buckets

    def apply(self, upserts: DataFrame, removed: DataFrame, snapshot: str, expected: str | None = None, per_bucket: int = ROWS) -> int:
        """Publish the current table with some rows put in or replaced, and some keys removed; returns how many buckets were written.

        ``upserts`` have the table's columns, ``removed`` the key; a key in both is put in. Keys
        may be null. Nothing is published if no bucket is touched. RuntimeError if another
        publisher was first, or ``expected`` isn't current any more.
        """
        last = self.current()
        meta = self.meta(last)
        n = meta["buckets"]
        upserts, removed = written(upserts, "upserts"), written(removed.select(self.key).distinct(), "removed")
        if upserts.groupBy(self.key).count().where("count > 1").head(1):
            raise ValueError(f"{self.key} isn't a key")
        keys = upserts.select(self.key).union(removed).distinct()
        touched = sorted(r[0] for r in keys.select(self._of(n)).distinct().collect())
        if not touched:
            return 0
        old = self.read(last, touched)
        moved = keys.select(F.col(self.key).alias("_moved"))
        kept = old.join(moved, F.col(self.key).eqNullSafe(F.col("_moved")), "left_anti")
        new = kept.unionByName(upserts.select(*old.columns))
        most = meta["n"] + upserts.count()
        if most > MOST * per_bucket * n and count_for(most, per_bucket) > n:
            rest = self.read(last, [b for b in range(n) if b not in set(touched)])
            return self.write(rest.unionByName(new), snapshot, expected or last, per_bucket)
        stored = self._stored(new, n)
        others = self.manifest(last).where(~F.col("bucket").isin(touched))
        self._publish(others.unionByName(stored), n, meta["schema"], snapshot, expected or last)
        return len(touched)

    def differences(self, a: str, b: str, values: list[str]) -> DataFrame:
        """Keys whose rows differ between two snapshots: key, state (added, removed, changed).

        Buckets with equal digests aren't read; nor is any if both snapshots have one root. Tables
        dealt out by different numbers of buckets are compared whole.
        """
        ma, mb = self.meta(a), self.meta(b)
        some: list[int] | None = None
        if ma["buckets"] == mb["buckets"]:
            left, right = self.manifest(a).select("bucket", "digest"), self.manifest(b).select("bucket", F.col("digest").alias("_digest"))
            met = left.join(right, "bucket", "full_outer").where(~F.col("digest").eqNullSafe(F.col("_digest")))
            some = [] if ma["root"] == mb["root"] else [r["bucket"] for r in met.select("bucket").collect()]
        return compared(self.read(a, some), self.read(b, some), [self.key], values).where("state != 'same'")

    def violations(self, snapshot: str | None = None) -> DataFrame:
        """What is wrong with a stored snapshot: check, subject; empty for a sound one.

        version: the layout's isn't this one's, and nothing else is looked at. root: the manifest isn't
        the one that was published. missing_bucket: a folder is gone. digest: a bucket's bytes
        can't be read, or its rows aren't those that were written. misplaced: a key in a
        bucket that isn't its own. key_twice: a key with several rows.
        """
        meta = snapshots.table(self.spark, self.root, "meta", snapshot)
        row = meta.first()
        if row is None or row["version"] != VERSION:
            return meta.select(F.lit("version").alias("check"), F.col("version").cast("string").alias("subject"))
        manifest = self.manifest(snapshot)
        fs, _ = snapshots._fs(self.spark, self.root)
        there = [r["folder"] for r in manifest.where("folder IS NOT NULL").select("folder").collect()]
        gone = [f for f in there if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{f}"))]
        read = self.spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").schema(row["schema"])
        paths = [f"{self.root}/{f}" for f in there if f not in set(gone)]
        columns = self.spark.createDataFrame([], row["schema"]).columns
        if paths:
            rows = read.parquet(*paths).withColumn("_bucket", F.regexp_extract(F.col("_metadata.file_path"), r"/_bucket=(\d+)/", 1).cast("int"))
        else:
            rows = self.spark.createDataFrame([], row["schema"]).withColumn("_bucket", F.lit(0))
        now = digests(rows, ["_bucket"], columns).select("_bucket", F.col("digest").alias("_digest"))
        text = lambda c: F.col(c).cast("string").alias("subject")
        named = lambda df, check, subject: df.select(F.lit(check).alias("check"), text(subject))
        missing = self.spark.createDataFrame([(f,) for f in gone], "folder string")
        met = manifest.where("n > 0").join(now, F.col("bucket") == F.col("_bucket"), "left")
        return reduce(
            DataFrame.unionByName,
            [
                named(self._root(manifest).where(F.col("root") != row["root"]), "root", "root"), named(missing, "missing_bucket", "folder"),
                named(met.where(~F.col("digest").eqNullSafe(F.col("_digest"))), "digest", "bucket"),
                named(rows.where(F.col("_bucket") != self._of(row["buckets"])), "misplaced", self.key), named(rows.groupBy(self.key).count().where("count > 1"), "key_twice", self.key),
            ],
        )

    def export(self, path: str, snapshot: str | None = None) -> None:
        """A snapshot as canonical JSON, one row a line, in the order of the key."""
        rows = self.read(snapshot)
        rows.orderBy(self.key).select(canonical_json(rows.columns).alias("value")).write.text(path)

    def collect(self, keep: int = 2) -> int:
        """Delete what only older snapshots than the last ``keep`` have; returns how many folders went. Readers of these must be done."""
        fs, at = snapshots._fs(self.spark, f"{self.root}/{snapshots.POINTERS}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = sorted((f.getPath().getName() for f in fs.listStatus(at)), reverse=True)
        ids = [i for i in (snapshots.pointed(self.spark, self.root, n) for n in names) if i is not None]
        held = list(dict.fromkeys(ids))[:keep]
        used = {f"{r['folder']}" for i in held for r in self.manifest(i).where("folder IS NOT NULL").select("folder").collect()}
        n = 0
        for i in dict.fromkeys(ids):
            if i not in held:
                fs.delete(path(f"{self.root}/snapshot={i}"), True)
        for old in names[keep:]:
            fs.delete(path(f"{self.root}/{snapshots.POINTERS}/{old}"), False)
        for written_ in fs.listStatus(path(f"{self.root}/data")):
            own = written_.getPath().getName()
            parts = [p.getPath().getName() for p in fs.listStatus(written_.getPath()) if p.isDirectory()]
            left = [p for p in parts if f"data/{own}/{p}" not in used]
            for p in left:
                fs.delete(path(f"{self.root}/data/{own}/{p}"), True)
            n += len(left)
            if len(left) == len(parts):
                fs.delete(written_.getPath(), True)
        return n


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
