"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a value that one pass looks at; a group has at most 2^16 counts in a pass.
DIGIT = 16


def exact_quantiles(rows: DataFrame, key: str, value: str, at: dict[str, float], nearest: bool = False) -> DataFrame:
    """Quantiles, interpolated or, with ``nearest``, of the nearest rank: key and one column for each name in ``at``; null where a key has no values.

    The nearest rank of n values is the smallest that isn't below quantile * n, one at least: of
    five values the largest is the 0.95 quantile.

    A double's bits, as a number in the doubles' order, are read from the top, 16 at a time: each
    pass counts the next 16 bits of the values that begin as the wanted ranks' values do. A task
    holds counts, never a group's values. What goes from pass to pass, and is broadcast, is two
    ranks for each key and quantile. NaN counts as largest; nulls don't count.
    """
    names = list(at)
    v = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    keys = v.select("k").distinct()
    v = v.where("v IS NOT NULL").withColumn("v", F.when(F.col("v") == 0, 0.0).otherwise(F.col("v")))
    v = v.withColumn("bits", F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col("v")).cast("long"))
    v = v.withColumn("bits", F.when(F.col("bits") < 0, F.col("bits").bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(F.col("bits")))

    state = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftright("bits", shift).alias("prefix")
        if state is None:
            counts = v.select("k", "v", digit).groupBy("k", "prefix").agg(F.count("*").alias("n"), F.max("v").alias("v"))
            group = Window.partitionBy("k")
        else:
            begins = F.shiftright("bits", shift + DIGIT)
            counts = v.join(F.broadcast(state), v["k"].eqNullSafe(state["_k"]) & (begins == state["_prefix"]))
            counts = counts.select("k", "v", "_prefix", "ranks", digit).groupBy("k", "_prefix", "prefix").agg(F.count("*").alias("n"), F.max("v").alias("v"), F.first("ranks").alias("ranks"))
            group = Window.partitionBy("k", "_prefix")
        counts = counts.withColumn("upto", F.sum("n").over(group.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)))
        if state is None:
            last = F.sum("n").over(group) - 1
            places = [F.greatest(F.ceil(F.lit(q) * (last + 1)) - 1, F.lit(0)).cast("double") if nearest else F.lit(q) * last for q in at.values()]
            ranks = [F.struct(F.lit(n).alias("name"), F.lit(i).alias("side"), p.alias("place"), r(p).cast("long").alias("r")) for n, p in zip(names, places, strict=True) for i, r in enumerate((F.floor, F.ceil))]
            counts = counts.withColumn("ranks", F.array(*ranks))
        found = counts.select("k", "prefix", "v", F.explode("ranks").alias("x"), (F.col("upto") - F.col("n")).alias("before"), "upto").where("x.r >= before AND x.r < upto")
        found = found.withColumn("x", F.struct("x.name", "x.side", "x.place", (F.col("x.r") - F.col("before")).alias("r")))
        state = found.groupBy(F.col("k").alias("_k"), F.col("prefix").alias("_prefix")).agg(F.collect_list("x").alias("ranks"))

    # After the last pass a prefix is a value.
    def one(name: str):
        mine = lambda side, c: F.max(F.when((F.col("x.name") == name) & (F.col("x.side") == side), F.col(c)))
        low, high, place = mine(0, "v"), mine(1, "v"), mine(0, "x.place")
        part = place - F.floor(place)
        return F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name)

    got = found.groupBy(F.col("k").alias("_k")).agg(*map(one, names))
    return keys.join(got, keys["k"].eqNullSafe(got["_k"]), "left").select(F.col("k").alias(key), *names)
