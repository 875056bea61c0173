"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quillon.llm.common import free_names, ranked, word_count, written

#: Levels of size: longer than 1/4, 1/16, 1/64, 1/256 of the source's target, and the rest.
LEVELS, STEP = 5, 4

def offset_of(source: Column, seed: str) -> Column:
    """A number in [0, 1) with 32 random bits for each source; the same in each run."""
    bits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s:"), source), F.lit("null"))).cast("binary")), 1, 8)
    return F.conv(bits, 16, 10).cast("double") / float(1 << 32)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Words that each source shall give: columns source, source_size, target, docs.

    ``sizes`` has source, source_size (words) and docs. Sources by code point, null last, weigh
    ``weights``, repeating, and share the sum of all sizes; none gets over ``most`` times its
    size. Sharing the excess by weight until none is above ends at the level L at which the sum
    of min(most * size, L * weight) is the sum of all sizes: sources are full in the order of
    size / weight. One row per source is sorted here, nothing that grows with the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("_cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    earlier, all_rows = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(all_rows)
    rest = total - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    heavy = F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(earlier), F.lit(0))
    s = s.withColumn("_level", rest.cast("double") / heavy)
    s = s.withColumn("_k", F.row_number().over(fill))
    # The first source that its cap doesn't hold back: the level there is the last one.
    level = F.min(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct("_k", "_level"))).over(all_rows).getField("_level")
    s = s.withColumn("_final", F.coalesce(level, F.lit(0.0)))
    return s.select("source", "source_size", "docs", F.least(F.col("_cap").cast("double"), F.col("_final") * F.col("_w")).alias("target"))


def _level(size: Column, target: Column) -> Column:
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(size * STEP ** (k + 1) > target, k).otherwise(out)
    return out


def _copies(at: Column, rate: Column, most: int) -> Column:
    """Integers that a row's part of the prefix sum crosses, from ``at`` to ``at`` + ``rate``."""
    return F.least(F.floor(at + rate) - F.floor(at), F.lit(most)).cast("long")


def _taken(docs: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """Rows of doc_id, source, size, key and whatever else, with source_size, target and copies."""
    docs = docs.withColumns({"at": F.left(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(16)), "less": -F.col("size")})
    rows = ranked(docs, "source", ["less", "at", "doc_id"], ["key"], "mix").drop("at", "less")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = written(source_targets(sizes, weights, most).withColumnRenamed("source", "_source").drop("docs"), "targets")
    # One row per source, here and below: broadcast only if Spark finds the table small enough.
    with_target = lambda df, t: df.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = with_target(rows, targets).withColumn("level", _level(F.col("size"), F.col("target")))
    of = lambda k, c: F.sum(F.when(F.col("level") == k, c).otherwise(0))
    per = rows.groupBy(F.col("source").alias("_source"), "target").agg(
        F.array(*(of(k, F.col("size")) for k in range(LEVELS))).alias("words"), F.array(*(of(k, F.lit(1)) for k in range(LEVELS))).alias("count")
    )
    # What is left of the target, and where the prefix sum and the ranks stand when a level begins.
    state = per.withColumns({"left": F.col("target"), "sum": offset_of(F.col("_source"), seed), "before": F.lit(0).cast("long"), "plan": F.array().cast("array<struct<rate:double,sum:double,before:bigint>>")}).drop("target")
    for k in range(LEVELS):
        words = F.aggregate(F.slice("words", k + 1, LEVELS - k), F.lit(0).cast("long"), lambda a, x: a + x)
        rate = F.when(words > 0, F.greatest(F.lit(0.0), F.least(F.col("left") / words, F.lit(float(most))))).otherwise(0.0)
        state = state.withColumn("rate", rate).withColumn("plan", F.concat("plan", F.array(F.struct("rate", "sum", "before"))))
        state = written(state, "level")
        if k + 1 < LEVELS:
            here = with_target(rows.where(F.col("level") == k), state.select("_source", "rate", "sum", "before"))
            copies = _copies(F.col("sum") + (F.col("rank") - F.col("before")) * F.col("rate"), F.col("rate"), most)
            got = here.groupBy(F.col("source").alias("_s")).agg(F.sum(copies * F.col("size")).alias("got"))
            n = F.col("count")[k]
            state = state.join(got, F.col("_source").eqNullSafe(F.col("_s")), "left").withColumns({"left": F.col("left") - F.coalesce("got", F.lit(0)), "sum": F.col("sum") + n * F.col("rate"), "before": F.col("before") + n}).drop("_s", "got", "rate")
    rows = with_target(rows, state.select("_source", "plan")).withColumn("plan", F.col("plan")[F.col("level")])
    copies = _copies(F.col("plan.sum") + (F.col("rank") - F.col("plan.before")) * F.col("plan.rate"), F.col("plan.rate"), most)
    return rows.withColumn("copies", copies).drop("plan", "level")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    A source's documents stand in one order, long ones first, then by a hash of their ids. Their
    expected copies are summed up from the source's one random offset; a document is emitted once
    for each integer that its part of the sum crosses. Expected copies are what is left of the
    target by what is left of the source when a level of sizes begins, so that shorter documents
    make up for what longer ones took too often or too rarely. So later levels depend on what
    earlier ones drew; a document's expectation is target / source_size only on the first level, and
    on others as far as no rate there had to be cut off at 0 or ``most``. The words taken miss the
    target by about one of the shorter documents, as far as there are any. Within a level all terms are equal, so a
    prefix sum needs the document's rank only, which `ranked` finds without gathering a source.

    Null text: size 0. Null source: a source of its own, last. A source without words: target 0,
    nothing taken. Null doc_ids come first among documents of one size. Rows that repeat are
    documents of their own. Empty table: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64("text").alias("key"))
    rows = _taken(rows, weights, most, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies, with all its columns.

    Copies are decided on doc_id, source, size and a hash of the text, which are narrow, and meet
    the whole rows again once, by all but the size. Rows alike in these share the sum of their
    copies evenly.
    """
    *others, copies_, rows_, on, on_taken, times_, time_ = free_names(docs, "doc_id", "source", "key", "copies", "rows", "on", "onto", "times", "time")
    alike = dict(zip(("doc_id", "source", "key"), others, strict=True))
    own = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "key": F.xxhash64("text")}
    rows = docs.select(*(c.alias(k) for k, c in own.items()), word_count(F.col("text").cast("string")).alias("size"))
    taken = _taken(rows, weights, most, seed).groupBy(*alike).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    taken = written(taken, "taken")
    repeated = bool(taken.where("rows > 1").head(1))
    taken = taken.withColumnsRenamed(alike | {"copies": copies_, "rows": rows_})
    copies, shared = F.col(copies_), F.col(rows_)
    # Hashed once, as a column, so that the join is on one key that is never null.
    whole = docs.withColumn(on, F.xxhash64(*own.values()))
    got = whole.join(taken.withColumn(on_taken, F.xxhash64(*alike.values())), F.col(on) == F.col(on_taken))
    for k, c in own.items():
        got = got.where(c.eqNullSafe(F.col(alike[k])))
    each = got.withColumn(times_, copies)
    if repeated:  # only such rows are numbered, a few alike ones at a time
        # By all that they hold, so that a task that runs again repeats the same ones.
        held = F.xxhash64(*(f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)))
        at = F.row_number().over(Window.partitionBy(*alike.values()).orderBy(held)) - 1
        each = each.where(shared == 1).unionByName(got.where(shared > 1).withColumn(times_, F.floor((at + 1) * copies / shared) - F.floor(at * copies / shared)))
    times = F.array_repeat(F.lit(0), F.col(times_).cast("int"))
    return each.withColumn(time_, F.explode(times)).select(*docs.columns)
