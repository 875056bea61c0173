"""Keeping results current: change streams, coalescing, and publication of micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from quillon.operators.integrity import compared
from quillon.operators.tables import discard, written
from quillon.sources.buckets import Buckets

#: Quiet time, longest wait, poll interval, in ms.
QUIET_MS, LONGEST_MS, POLL_MS = 100, 1000, 1000
#: Kinds of change, weakest first; reads don't count.
KINDS = ("attributes", "content", "created", "removed")


def file_changes(spark: SparkSession, root: str) -> DataFrame:
    """A stream of files as they appear below a root."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)


def strongest(events: DataFrame, key: str = "path", kind: str = "kind") -> DataFrame:
    """The strongest change of each path, unknown kinds and reads left out: key, kind, n."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))
    best = events.where(rank > 0).groupBy(key).agg(F.max(rank).alias("_r"), F.count("*").alias("n"))
    return best.select(key, F.element_at(F.array(*map(F.lit, KINDS)), F.col("_r").cast("int")).alias("kind"), "n")


def coalesced(events: DataFrame, key: str = "path", time: str = "ts", quiet_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS, late: str = "10 seconds") -> DataFrame:
    """Bursts of each key: emitted when quiet for ``quiet_ms``, or ``longest_ms`` after the first event.

    ``events`` is a stream with an event time; what comes later than the watermark is dropped.
    State per key is three numbers, whatever a burst's size. Columns key, first_ms, last_ms, n.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        burst = list(state.get) if state.exists else None
        if state.hasTimedOut:
            out.append((k[0], *burst))
            state.remove()
        else:
            times = sorted(t for b in batches for t in b["_ms"].tolist())
            for t in times:
                if burst and (t - burst[1] >= quiet_ms or t - burst[0] >= longest_ms):
                    out.append((k[0], *burst))
                    burst = None
                burst = [burst[0], max(t, burst[1]), burst[2] + 1] if burst else [t, t, 1]
            if burst:
                state.update(tuple(burst))
                until = min(burst[1] + quiet_ms, burst[0] + longest_ms)
                state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "first_ms", "last_ms", "n"])

    timed = events.withWatermark(time, late).withColumn("_ms", F.unix_millis(time)).groupBy(key)
    kind = events.schema[key].dataType.simpleString()
    return timed.applyInPandasWithState(fold, f"{key} {kind}, first_ms long, last_ms long, n long", "first_ms long, last_ms long, n long", "append", "EventTimeTimeout")


def follow(changes: DataFrame, root: str, build: Callable[[DataFrame], DataFrame], key: str, values: list[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep ``build`` of all changes so far as a table in buckets under ``root``, batch by batch.

    Each micro-batch replaces its keys' rows, in the buckets that they fall in. It is published
    only if the snapshot before is still the current one and something changed. The snapshot's id
    is the batch number, so a batch that runs again after a failure is published once. What only
    older snapshots than the last two have is deleted.
    """
    spark = changes.sparkSession
    kept = Buckets(spark, root, key)

    def step(batch: DataFrame, number: int) -> None:
        last = kept.current()
        if last is not None and int(last) >= number:
            return
        fresh = written(build(batch), "batch")
        if last is None:
            kept.write(fresh, f"{number:012d}")
        else:
            moved = fresh.select(F.col(key).alias("_moved"))
            own = kept.read(last).join(moved, F.col(key).eqNullSafe(F.col("_moved")), "left_semi")
            if compared(own, fresh, [key], values).where("state != 'same'").head(1):
                kept.apply(fresh, fresh.select(key).where("false"), f"{number:012d}", last)
                kept.collect()
        discard(fresh)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=f"{POLL_MS} milliseconds").start()


def refresh(spark: SparkSession, root: str, listing: Callable[[], DataFrame], key: str, values: list[str], beside: tuple[str, ...] = ("n_read",)) -> DataFrame | None:
    """Keep a listing as a table in buckets under ``root``; only buckets in which a row moved are written.

    Returns what changed in ``values`` (key, state: added, removed, changed), None if nothing did.
    What is published was true before and after it was written: if the listing moved in between,
    nothing is published, and the next round sees it. Columns ``beside`` tell of the round, and count for nothing.
    """
    kept = Buckets(spark, root, key)
    last = kept.current()
    now = written(listing(), "listing")
    every = [c for c in now.columns if c != key and c not in beside]
    old = kept.read(last) if last is not None else now.where("false")
    moved = written(compared(old, now, [key], every).where("state != 'same'"), "moved")
    if last is not None and not moved.head(1):
        discard(now)
        return None
    if compared(now, listing(), [key], every).where("state != 'same'").head(1):
        return None
    changes = written(compared(old, now, [key], values).where("state != 'same'"), "changes")
    number = f"{int(last) + 1 if last else 0:012d}"
    if last is None:
        kept.write(now, number)
    else:
        which = moved.select(F.col(key).alias("_moved"), "state")
        upserts = now.join(which.where("state != 'removed'").drop("state"), F.col(key).eqNullSafe(F.col("_moved")), "left_semi")
        kept.apply(upserts, moved.where("state = 'removed'").select(key), number, last)
        kept.collect()
    discard(now)
    return changes if last is None or changes.head(1) else None


def follow_listing(spark: SparkSession, root: str, listing: Callable[[], DataFrame], key: str, values: list[str], every_ms: int = POLL_MS) -> StreamingQuery:
    """`refresh` again and again, by the clock: edits and removals count as well as what is new."""

    def step(_: DataFrame, __: int) -> None:
        refresh(spark, root, listing, key, values)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(step).trigger(processingTime=f"{every_ms} milliseconds").start()
