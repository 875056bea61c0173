"""Sharding of keyed rows by jump consistent hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import ranked

#: Fixed value: the multiplier of the published method's 64-bit generator.
MULTIPLIER = 2862933555777941757
_22, _20 = (1 << 22) - 1, (1 << 20) - 1


def jump_shards(key: Column, counts: list[int]) -> Column:
    """Struct with the shard ``s<n>`` of a 64-bit key for each shard count n.

    A key's jumps don't depend on the number of shards: its shard is the last jump below it. So
    one walk serves all counts. The generator's products are taken modulo 2^64 in limbs of 22,
    22 and 20 bits, which stay below 2^63. A null key counts as 0.
    """
    most = max(counts)
    a0, a1, a2 = MULTIPLIER & _22, MULTIPLIER >> 22 & _22, MULTIPLIER >> 44
    long = lambda x: F.lit(x).cast("long")
    k = F.coalesce(key.cast("long"), long(0))
    start = F.struct(
        k.bitwiseAND(long(_22)).alias("k0"),
        F.shiftrightunsigned(k, 22).bitwiseAND(long(_22)).alias("k1"),
        F.shiftrightunsigned(k, 44).alias("k2"),
        long(0).alias("j"),
        *(long(0).alias(f"s{n}") for n in counts),
    )

    def step(acc: Column, _: Column) -> Column:
        t0 = acc.k0 * a0 + 1
        t1 = F.shiftright(t0, 22) + acc.k0 * a1 + acc.k1 * a0
        t2 = F.shiftright(t1, 22) + acc.k0 * a2 + acc.k1 * a1 + acc.k2 * a0
        k0, k1, k2 = t0.bitwiseAND(long(_22)), t1.bitwiseAND(long(_22)), t2.bitwiseAND(long(_20))
        top = F.shiftleft(k2, 11).bitwiseOR(F.shiftright(k1, 11)) + 1
        jump = F.floor((acc.j + 1).cast("double") * (F.lit(float(1 << 31)) / top.cast("double"))).cast("long")
        return F.when(acc.j >= most, acc).otherwise(
            F.struct(
                k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), jump.alias("j"),
                *(F.when(jump < n, jump).otherwise(acc[f"s{n}"]).alias(f"s{n}") for n in counts),
            )
        )

    # Each step jumps ahead by one at least, so most steps are enough.
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda acc: F.struct(*(acc[f"s{n}"].cast("int").alias(f"s{n}") for n in counts)))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Put each document into one of ``shards`` by its doc_id, with its place there.

    Columns: doc_id, size (UTF-8 bytes of the text, null: none, plus 8), text_crc32 (of the UTF-8
    bytes, unsigned; null text: 0), law (``key``), shard, slot (gapless from 0 in each shard),
    grown_shard (with one shard more: the same, or the new one). A null doc_id counts as key 0.
    Rows that repeat take a slot each. Slots come from ranges of (shard, doc_id), so no task
    holds a whole shard.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
    )
    rows = rows.withColumn("_s", jump_shards(F.col("doc_id"), [shards, shards + 1]))
    rows = rows.select("*", F.col(f"_s.s{shards}").alias("shard"), F.col(f"_s.s{shards + 1}").alias("grown_shard")).drop("_s")
    rows = ranked(rows, "shard", ["doc_id"], ["text_crc32"], "sharded")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("rank").alias("slot"), "grown_shard")
