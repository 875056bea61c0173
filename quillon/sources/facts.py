"""File facts: what lies below a root, its links, and fingerprints of bytes that are only read when something moved.

`FileEntries` is a Spark data source over a mounted file system, which all executors see: a
listing in batch, or as a stream what changed since the last one. It lists and never opens a file. Stores without
inodes and links go through `files.scan`, which Spark lists itself.
"""

from __future__ import annotations

import hashlib
import os
import stat
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, parent string, kind string, n_bytes long, modified long, changed long, identity string, target string, touched boolean"
ARROW = pa.schema(
    [("path", pa.string()), ("parent", pa.string()), ("kind", pa.string()), ("n_bytes", pa.int64()), ("modified", pa.int64()), ("changed", pa.int64()), ("identity", pa.string()), ("target", pa.string()), ("touched", pa.bool_())]
)
#: What tells a file that moved from one that didn't.
FACTS = ("kind", "n_bytes", "modified", "changed", "identity", "target")
#: Folders that a listing is dealt out by, at least, if there are as many; rows of a batch; bytes read at once.
FOLDERS, ROWS, READ = 64, 8192, 1 << 20
#: A stream leaves the last of time alone, in ns: what changes then may still get the same time.
SETTLED = 50_000_000
KINDS = ((stat.S_ISLNK, "link"), (stat.S_ISREG, "file"), (stat.S_ISDIR, "directory"))


class Folder(InputPartition):
    """A folder below the root, all below it or its own members alone, and the times between which changes count."""

    def __init__(self, path: str, deep: bool, since: int | None = None, until: int | None = None):
        self.path, self.deep, self.since, self.until = path, deep, since, until


def _entry(root: str, path: str, touched: bool) -> tuple:
    s = os.lstat(os.path.join(root, path))
    kind = next((k for test, k in KINDS if test(s.st_mode)), "other")
    target = os.readlink(os.path.join(root, path)) if kind == "link" else None
    return path, os.path.dirname(path), kind, s.st_size if kind == "file" else None, s.st_mtime_ns, s.st_ctime_ns, f"{s.st_dev}:{s.st_ino}", target, touched


def _folders(root: str, skip: frozenset, most: int) -> list[tuple[str, bool]]:
    """Folders by which a listing is dealt out: opened level by level until there are enough."""
    level, done = [""], []
    while level and len(level) + len(done) < most:
        done += [(p, False) for p in level]
        level = [os.path.join(p, e.name) for p in level for e in _members(root, p) if e.name not in skip and e.is_dir(follow_symlinks=False)]
    return done + [(p, True) for p in level]


def _members(root: str, path: str) -> list[os.DirEntry]:
    try:
        with os.scandir(os.path.join(root, path)) as found:
            return list(found)
    except (FileNotFoundError, NotADirectoryError):  # gone since its parent was listed
        return []


def _walk(root: str, skip: frozenset, folder: Folder) -> Iterator[tuple]:
    """Entries of a folder. Between two times: what changed, and who is left in a folder whose members changed.

    A folder that changed below one that changed may have been moved there, and all that it holds
    with it, whose times a move leaves alone: all of it counts as listed.
    """
    within = lambda t: folder.since is None or folder.since < t <= folder.until

    def changed(path: str) -> bool:
        try:
            s = os.lstat(os.path.join(root, path))
        except OSError:
            return True
        return within(s.st_mtime_ns) or within(s.st_ctime_ns)

    parts = folder.path.split("/") if folder.path else []
    above = ["/".join(parts[:i]) for i in range(len(parts) + 1)]
    moved = folder.since is None or any(changed(a) and changed(b) for a, b in zip(above, above[1:], strict=False))
    stack = [(folder.path, moved)]
    while stack:
        path, all_of_it = stack.pop()
        opened = changed(path)
        if path == "" and (opened or all_of_it):
            yield _entry(root, path, True)
        for e in _members(root, path):
            if e.name in skip:
                continue
            try:
                row = _entry(root, os.path.join(path, e.name), True)
            except FileNotFoundError:
                continue
            fresh = within(row[4]) or within(row[5])
            if fresh or opened or all_of_it:
                yield (*row[:-1], fresh or all_of_it)
            if row[2] == "directory" and folder.deep:
                stack.append((row[0], all_of_it or (opened and fresh)))


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, x, strict=True)) for x in held], ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, x, strict=True)) for x in held], ARROW)


class _Reader:
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.skip = frozenset(x for x in options.get("skip", "").split(",") if x)
        self.most = int(options.get("folders", FOLDERS))

    def folders(self, since: int | None = None, until: int | None = None) -> list[Folder]:
        return [Folder(p, deep, since, until) for p, deep in _folders(self.root, self.skip, self.most)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        return _batches(_walk(self.root, self.skip, partition))


class _Listing(_Reader, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return self.folders()


class _Changes(_Reader, DataSourceStreamReader):
    """Offsets are times of change, so a batch that runs again lists what changed between the same two."""

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": time.time_ns() - SETTLED}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.folders(start["changed"], end["changed"])


class FileEntries(DataSource):
    """``spark.read.format("file_entries").option("path", root)``, or ``readStream``.

    Columns: path (below the root, which is the empty path itself), parent, kind (file, directory, link, other), n_bytes,
    modified and changed (ns), identity (volume:inode), target of a link, touched. Links aren't
    followed. Options: ``skip``, names that are passed over wherever they are; ``folders``, the
    number of partitions that the driver opens folders for.

    The stream's first batch lists all; later ones what changed. ``touched`` is false for members
    that are only listed because something came to or left their folder.
    """

    @classmethod
    def name(cls) -> str:
        return "file_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options)


def entries(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """What lies below a root, links not followed."""
    spark.dataSource.register(FileEntries)
    return spark.read.format("file_entries").option("path", root).option("skip", ",".join(skip)).load()


def entry_changes(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """The same as a stream of changes."""
    spark.dataSource.register(FileEntries)
    return spark.readStream.format("file_entries").option("path", root).option("skip", ",".join(skip)).load()


def hashed(files: DataFrame, root: str) -> DataFrame:
    """Rows of files with ``sha256``, ``n_read`` and ``error``: their bytes are read where the task runs, piece by piece.

    A file that is gone, or that moved while it was read, has an error and no hash.
    """
    base = root.removeprefix("file://")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, modified in zip(batch["path"].to_pylist(), batch["modified"].to_pylist(), strict=True):
                digest, n, error = hashlib.sha256(), 0, None
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        while piece := f.read(READ):
                            digest.update(piece)
                            n += len(piece)
                        if os.fstat(f.fileno()).st_mtime_ns != modified:
                            error = "moved"
                except FileNotFoundError:
                    error = "not_found"
                except OSError as e:
                    error = f"unreadable: {e.strerror}"
                out.append((None if error else digest.hexdigest(), n, error))
            new = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "sha256", "n_read", "error"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(add, f"{columns}, sha256 string, n_read long, error string")


def fingerprints(listed: DataFrame, known: DataFrame | None, root: str) -> DataFrame:
    """Listed entries with ``sha256`` and ``n_read``: the bytes of a file are read only if its facts moved.

    ``known`` are the fingerprints of the last time: a file of the same kind, length, times and
    identity keeps its hash. Metadata alone meets in the join, and hashing follows it, spread over all tasks.
    """
    is_file = F.col("kind") == "file"
    if known is None:
        moved, same = listed, None
    else:
        old = known.select(F.col("path").alias("_path"), *(F.col(c).alias(f"_{c}") for c in FACTS), F.col("sha256").alias("_sha256"), F.col("error").alias("_error"))
        met = listed.join(old, F.col("path") == F.col("_path"), "left")
        kept = F.col("_path").isNotNull() & F.col("_error").isNull()
        for c in FACTS:
            kept = kept & F.col(c).eqNullSafe(F.col(f"_{c}"))
        met = met.withColumn("_kept", F.coalesce(kept, F.lit(False)))
        same = met.where("_kept").select(*listed.columns, F.col("_sha256").alias("sha256"), F.lit(0).cast("long").alias("n_read"), F.lit(None).cast("string").alias("error"))
        moved = met.where("NOT _kept").select(*listed.columns)
    none = [F.lit(None).cast("string").alias("sha256"), F.lit(0).cast("long").alias("n_read"), F.lit(None).cast("string").alias("error")]
    out = hashed(moved.where(is_file).repartition("path"), root).unionByName(moved.where(~is_file).select("*", *none))
    return out if same is None else out.unionByName(same)


def changed_entries(known: DataFrame, batch: DataFrame) -> DataFrame:
    """What a batch of changes does to known entries: the batch's columns and ``state`` (removed, present).

    A known entry is removed if its folder is listed in the batch and it isn't, or if a folder
    above it is. Folders above meet by equality, one row for each level.
    """
    listed = batch.select(F.col("path").alias("_path")).distinct()
    opened = batch.where("touched AND kind = 'directory'").select(F.col("path").alias("_folder")).distinct()
    columns = [c for c in batch.columns if c in known.columns]
    gone = known.where("path != ''").join(opened, F.col("parent") == F.col("_folder"), "left_semi").join(listed, F.col("path") == F.col("_path"), "left_anti")
    folders = gone.where("kind = 'directory'").select(F.col("path").alias("_above"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = known.select("*", F.explode(above).alias("_up")).where("_up != path").join(folders, F.col("_up") == F.col("_above"), "left_semi").drop("_up")
    removed = gone.unionByName(below).dropDuplicates(["path"]).join(listed, F.col("path") == F.col("_path"), "left_anti")
    present = batch.groupBy("path").agg(F.max_by(F.struct(*(c for c in columns if c != "path")), "changed").alias("e")).select("path", "e.*")
    return removed.select(*columns).withColumn("state", F.lit("removed")).unionByName(present.select(*columns).withColumn("state", F.lit("present")))

