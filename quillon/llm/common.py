"""What several operators share: written intermediate tables, components, words."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.tables import shared_dir, written

__all__ = ["connected_components", "free_names", "ranked", "release", "shared_dir", "tokenizer_path", "word_count", "written"]

#: A word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


def release() -> None:
    """Give a worker's free memory back: it goes on to other stages, beside the executor's heap."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` hasn't, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    return [next(x for k in range(len(taken) + 1) if (x := f"_{n}_{k}") not in taken) for n in names]


#: Nodes with more edges than this, and than a thousandth of all, are joined in parts.
HUB = 20_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node of ``edges``: columns ``node``, ``root``.

    Alternating large-star and small-star rounds; each is two aggregations and two joins over
    rows in proportion to the edges, written out, until a round changes nothing. No step gathers
    a node's neighbours in one row, and the edges of a hub are joined in several parts. Self-loops
    keep a node; nulls are not allowed.
    """
    loops = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).distinct()
    loops = written(loops, "cc-nodes")
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = written(e, "cc-edges")
    last = _digest(e)
    while last[0]:
        # A node has fewer edges than there are: no hubs below that.
        most = max(HUB, last[0] // 500) if last[0] > HUB else None
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_low(both, low, most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tops = low.where("m < u").select("u", F.col("m").alias("v"))
        large = large.where("u != v").union(tops).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_low(large, low, most)
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v")
        e = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        now = _digest(e)
        if now == last:
            break
        last = now
    return loops.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def _with_low(edges: DataFrame, low: DataFrame, most: int | None) -> DataFrame:
    """Edges with their u's ``m``. The edges of a u that has more than ``most`` are dealt to parts.

    Such hubs are few, at most the ends of all edges / ``most``, which is below 2,000 rows.
    """
    if most is None:
        return edges.join(low, "u")
    hubs = F.broadcast(low.where(F.col("n") > most).select(F.col("u").alias("_u"), F.ceil(F.col("n") / most).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = edges.join(hubs, edges["u"] == F.col("_u"), "left").select("u", "v", F.pmod(F.xxhash64("v"), parts).alias("part"))
    every = low.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > most, F.ceil(F.col("n") / most) - 1).otherwise(F.lit(0)).cast("long"))).alias("part"))
    return dealt.join(every, ["u", "part"])


def _digest(e: DataFrame) -> tuple:
    got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return tuple(got)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tokenizer_path(name: str) -> str:
    """A vocabulary file: a path as it is, or the name of one in the installed package of public ones."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def ranked(df: DataFrame, group: str, order: list[str], spread: list[str], name: str) -> DataFrame:
    """``df`` with ``rank`` (from 0, gapless) within ``group`` by ``order``, however large a group is.

    The rows are dealt out by ranges of (group, order, spread), so a hot group spans many
    partitions; the written table fixes which partition a row is in. A partition's rows of a
    group get a local row number, to which the counts of the earlier partitions are added: one
    row per partition and group, so the sums are small.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    keys = [F.col(group).asc_nulls_last(), *(F.col(c) for c in order), *(F.col(c) for c in spread)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, name)
    sums = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    sums = sums.withColumnsRenamed({group: "_g", "_part": "_p"})
    here = Window.partitionBy(group, "_part").orderBy(*order, *spread)
    out = dealt.withColumn("_row", F.row_number().over(here) - 1)
    out = out.join(sums, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("rank", (F.col("_row") + F.col("_before")).cast("long")).drop("_part", "_row", "_before", "_g", "_p")
