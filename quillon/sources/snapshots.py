"""Published snapshots: immutable folders of Parquet tables and numbered pointers, the newest of which holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "pointers"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], snapshot: str, expected: str | None = None) -> str:
    """Write all tables under ``snapshot=<id>``, then point to it, which makes them visible together.

    A snapshot that is there already is left as it is. The pointer is a new file with the next
    number, which only one publisher can create; none is ever replaced, and the last ones aren't
    removed, so there is always one published. RuntimeError if another publisher took that number, or, with
    ``expected``, if that snapshot isn't the current one any more. A lost executor or driver
    before the end leaves the old snapshot published.
    """
    number, last = _newest(spark, root)
    if expected is not None and last != expected:
        raise RuntimeError(f"{root} no longer has snapshot {expected}")
    folder = f"{root}/snapshot={snapshot}"
    fs, at = _fs(spark, f"{folder}/_DONE")
    if not fs.exists(at):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        fs.create(at, True).close()
    if last == snapshot:
        return folder
    fs, at = _fs(spark, f"{root}/{POINTERS}/{number + 1:020d}")
    try:
        out = fs.create(at, False)
    except Exception as e:
        raise RuntimeError(f"another publisher was first in {root}") from e
    out.write(bytearray(f"{snapshot}\n".encode()))
    out.close()
    return folder


def pointed(spark: SparkSession, root: str, name: str) -> str | None:
    """The snapshot that a pointer names, None if its publisher is still writing it, or was lost."""
    fs, at = _fs(spark, f"{root}/{POINTERS}/{name}")
    stream = fs.open(at)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text[:-1] if text.endswith("\n") else None


def _newest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Highest number of a pointer, and the snapshot that the last complete one names."""
    fs, at = _fs(spark, f"{root}/{POINTERS}")
    names = sorted((f.getPath().getName() for f in fs.listStatus(at)), reverse=True) if fs.exists(at) else []
    names = [n for n in names if n.isdigit()]
    for n in names:
        if (found := pointed(spark, root, n)) is not None:
            return int(names[0]), found
    return int(names[0]) if names else 0, None


def current(spark: SparkSession, root: str) -> str | None:
    """The published snapshot's id, None before the first."""
    return _newest(spark, root)[1]


def table(spark: SparkSession, root: str, name: str, snapshot: str | None = None) -> DataFrame:
    snapshot = snapshot or current(spark, root)
    if snapshot is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/snapshot={snapshot}/{name}")


def target_conflicts(targets: DataFrame, inputs: DataFrame) -> DataFrame:
    """Targets that must not be written: path, reason (input, parent_of_target).

    Each target gives one row per folder above it; these meet other targets by equality.
    """
    parts = F.split("path", "/")
    above = targets.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path"), F.col("path").alias("_below")).where("path != _below")
    parents = targets.join(above.select("path"), "path", "left_semi").withColumn("reason", F.lit("parent_of_target"))
    return targets.join(inputs.select("path"), "path", "left_semi").withColumn("reason", F.lit("input")).unionByName(parents)
