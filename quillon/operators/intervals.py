"""Intervals: union, islands, containment joins, nearest earlier rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.stretches import Stretches
from quillon.operators.tables import written

#: Seconds.
DAY = 86_400

#: Stretches of time that the longest burst is cut into.
STRETCHES = 8


def union_of(rows: DataFrame, key: str, start: str, end: str, width: int = DAY) -> DataFrame:
    """Merged intervals of each key; those that touch are one: key, start, end, n. Starts are cut at multiples of ``width``."""
    along = Stretches(rows.select(key, start, end), key, F.col(start), (end,), width).most_before(F.col(end), "_reach")
    along.then().sum((F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("int"), "_island")
    return along.done().groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def islands(rows: DataFrame, key: str, at: Column, ties: tuple[str, ...], same: list[str], within: int | None = None, width: int = DAY) -> DataFrame:
    """Rows with ``island``, counted from 0 per key in the order of ``at``: a new one begins where ``same`` changes or ``at`` grows by more than ``within``."""
    now = F.struct(F.col("_at").alias("at"), *same)
    along = Stretches(rows, key, at, ties, width).previous(now, "_before")
    stays = F.lit(True) if within is None else F.col("_at") - F.col("_before.at") <= within
    for c in same:
        stays = stays & F.col(c).eqNullSafe(F.col(f"_before.{c}"))
    along.then().sum(F.when(F.col("_before").isNull(), 0).otherwise((~F.coalesce(stays, F.lit(False))).cast("int")), "island")
    return along.done().drop("_before")


def containing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the half-open spans of their key that hold them.

    Spans are cut at multiples of ``width`` and points know their stretch, so the join is on
    equality and both sides are shuffled by (key, stretch). Neither side is repeated otherwise:
    a span has a row for each stretch it touches.
    """
    cut = spans.withColumn("_stretch", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    cut = cut.withColumnRenamed(key, "_key")
    dealt = points.withColumn("_own", F.floor(F.col(at) / width))
    on = (dealt[key] == cut["_key"]) & (dealt["_own"] == cut["_stretch"]) & (dealt[at] >= cut[start]) & (dealt[at] < cut[end])
    return dealt.join(cut, on, how).drop("_key", "_stretch", "_own")


def latest_before(rows: DataFrame, key: str, order: list[str], value: Column) -> Column:
    """The last non-null ``value`` in the rows of a key up to this one, for keys that are files or the like."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def quiet_sessions(rows: DataFrame, key: str, time: str, gap_us: int) -> DataFrame:
    """Sessions of a key that end when nothing comes for longer than ``gap_us``: key, started, ended, n."""
    found = islands(rows.select(key, time), key, F.unix_micros(F.col(time).cast("timestamp")), (), [], gap_us, DAY * 1_000_000)
    return found.groupBy(key, "island").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n")).drop("island")


def capped_bursts(rows: DataFrame, key: str, time: str, quiet_us: int, most_us: int) -> DataFrame:
    """Bursts of each key: emitted ``quiet_us`` after the last event or ``most_us`` after the first, whatever is sooner.

    Columns key, first_us, last_us, n. Each event knows which one begins the next burst if it
    begins one: the first at or after its time + ``most_us``, unless a quiet gap comes before.
    The starts are what the events after quiet gaps reach by these steps, which are doubled over
    written tables. Events are dealt by (key, stretch of time), so a key with a third of all
    events is many tasks; through one task for a key go its stretches, one row each.
    """
    us = rows.select(F.col(key).alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("us")).where("us IS NOT NULL")
    width = max(1, most_us // STRETCHES)
    dealt = Window.partitionBy("k", "s")
    along = Window.partitionBy("_k").orderBy("_s")
    past, ahead = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    upto = dealt.orderBy("us").rowsBetween(Window.unboundedPreceding, 0)

    def stretches(rows: DataFrame, *values: Column) -> DataFrame:
        return rows.groupBy(F.col("k").alias("_k"), F.col("s").alias("_s")).agg(*values)

    def beside(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(table, rows["k"].eqNullSafe(table["_k"]) & (rows["s"] == table["_s"])).drop("_k", "_s")

    events = us.groupBy("k", "us").agg(F.count("*").alias("n")).withColumn("s", F.floor(F.col("us") / width))
    ends = stretches(events, F.max("us").alias("_end")).withColumn("_end", F.max("_end").over(past))
    events = beside(events.withColumn("_before", F.lag("us").over(dealt.orderBy("us"))), ends)
    quiet = F.coalesce(F.col("us") - F.coalesce("_before", "_end") >= quiet_us, F.lit(True))
    events = written(events.select("k", "s", "us", "n", F.when(quiet, F.col("us")).alias("start")), "burst-events")

    def latest(rows: DataFrame, start: str) -> DataFrame:
        """Rows with ``latest``: the last ``start`` of the key up to each."""
        earlier = stretches(rows, F.max(start).alias("_start")).withColumn("_start", F.max("_start").over(past))
        own = rows.withColumn("_own", F.max(start).over(upto))
        return beside(own, earlier).withColumn("latest", F.coalesce("_own", "_start")).drop("_own", "_start")

    # Events, and the times from which each one's successor is looked for, in one order.
    held = written(latest(events, "start").select("k", "s", "us", "latest"), "burst-islands")
    found = held.select("k", "s", "us", F.struct("us", "latest").alias("event"), F.lit(None).cast("long").alias("of"))
    sought = held.select("k", F.floor((F.col("us") + most_us) / width).alias("s"), (F.col("us") + most_us).alias("us"), F.lit(None).cast(found.schema["event"].dataType).alias("event"), F.col("us").alias("of"))
    both = found.unionByName(sought)
    after = stretches(both, F.min("event").alias("_next")).withColumn("_next", F.min("_next").over(ahead))
    # Of equal times, what is looked for comes with the events: a range takes both.
    here = F.min("event").over(dealt.orderBy("us").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    to = beside(both.withColumn("_here", here), after).where("of IS NOT NULL").select("k", F.col("of").alias("us"), F.coalesce("_here", "_next").alias("to"))
    step = written(to.where("to.latest <= us").select("k", "us", F.col("to.us").alias("to")), "burst-steps")

    starts = events.where("start IS NOT NULL").select("k", "us")
    while step.head(1):
        at = step.withColumnsRenamed({"k": "_k", "us": "_us", "to": "_to"})
        more = starts.join(at, starts["k"].eqNullSafe(at["_k"]) & (starts["us"] == at["_us"])).select("k", F.col("_to").alias("us"))
        starts = written(starts.union(more).distinct(), "burst-starts")
        step = written(step.join(at, step["k"].eqNullSafe(at["_k"]) & (step["to"] == at["_us"])).select("k", "us", F.col("_to").alias("to")), "burst-steps")

    named = starts.select(F.col("k").alias("_k"), F.col("us").alias("_us"))
    marked = events.select("k", "s", "us", "n").join(named, events["k"].eqNullSafe(named["_k"]) & (events["us"] == named["_us"]), "left")
    marked = latest(marked.select("k", "s", "us", "n", F.col("_us").alias("begun")), "begun")
    out = marked.groupBy("k", "latest").agg(F.max("us").alias("last_us"), F.sum("n").alias("n"))
    return out.select(F.col("k").alias(key), F.col("latest").alias("first_us"), "last_us", "n")
