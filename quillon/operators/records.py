"""Records by content, their occurrences, searchable fields and source mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.hashing import content_id
from quillon.operators.stretches import Stretches

#: Order values that are numbered together.
STRETCH = 1 << 16


def with_record_id(rows: DataFrame, *parts: str) -> DataFrame:
    """Rows with ``record_id``: the hash of their content columns; bodies of white space alone are no records."""
    return rows.where(F.col(parts[-1]).rlike(r"[^\s\p{Z}\x0B\x85]")).withColumn("record_id", content_id(*map(F.col, parts)))


def records(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per record_id with its content; equal content is aggregated before the shuffle.

    Occurrences stay rows of their own table: content that a third of all pages share would make
    a list that no task could hold.
    """
    return rows.groupBy("record_id").agg(*(F.first(c).alias(c) for c in keep), F.count("*").alias("n_occurrences"))


def record_counts(rows: DataFrame, *first_of: str) -> DataFrame:
    """Occurrences of each record and the first of them, without listing them: safe for any group size."""
    return rows.groupBy("record_id").agg(F.count("*").alias("n_occurrences"), *(F.min(c).alias(f"first_{c}") for c in first_of))


def positions(rows: DataFrame, page: str, order: str, width: int = STRETCH) -> DataFrame:
    """Rows with ``position``: 0-based, gapless within a page, by a numeric ``order``.

    A page is cut into stretches of ``width`` order values. Rows are numbered within their
    stretch, and the counts of earlier stretches, one row per page and stretch, are added, so a
    page with a third of all rows is numbered by many tasks.
    """
    dealt = rows.withColumn("_stretch", F.floor(F.col(order) / width))
    before = Window.partitionBy("_page").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col(page).alias("_page"), F.col("_stretch").alias("_part")).agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(page, "_stretch").orderBy(order)) - 1
    out = dealt.withColumn("_own", own).join(starts, F.col(page).eqNullSafe(F.col("_page")) & F.col("_stretch").eqNullSafe(F.col("_part")))
    return out.withColumn("position", (F.col("_before") + F.col("_own")).cast("long")).drop("_stretch", "_page", "_part", "_own", "_before")


def occurrence_ids(rows: DataFrame, page: str, order: str, bucket: Column | None = None, prefix: str = "o", first: int = 0, name: str = "occurrence_id") -> DataFrame:
    """Rows with ``occurrence_id`` o0, o1, … in the order of (page, order); requests are numbered from d1 on.

    Counts are summed up in two levels: over the buckets, which alone pass through one task, and
    over the pages of a bucket. ``bucket`` must grow with the page; for numeric pages it is the
    stretch they are in, for others give a prefix or the like. Rows without a page come first.
    """
    counts = rows.groupBy(page).agg(F.count("*").alias("_n")).withColumn("_bucket", F.floor(F.col(page) / STRETCH) if bucket is None else bucket)
    totals = counts.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_bucket").orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumnRenamed("_bucket", "_of")
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(totals, F.col("_bucket").eqNullSafe(F.col("_of")))
    starts = starts.select(F.col(page).alias("_paged"), (F.col("_start") + F.col("_base")).alias("_start"))
    out = positions(rows, page, order).join(starts, F.col(page).eqNullSafe(F.col("_paged")))
    return out.withColumn(name, F.concat(F.lit(prefix), (F.col("_start") + F.col("position") + first).cast("string"))).drop("_start", "_paged")


def fields(rows: DataFrame, key: str, weights: dict[str, tuple[str, int]]) -> DataFrame:
    """Searchable fields, each distinct one once: key, field, weight, value.

    ``weights`` maps a field's name to its column and weight. One pass over the rows: the fields
    are an array that is exploded, not a union of scans.
    """
    each = F.array(*(F.struct(F.lit(n).alias("field"), F.lit(w).alias("weight"), F.col(c).cast("string").alias("value")) for n, (c, w) in weights.items()))
    exploded = rows.select(key, F.explode(F.array_distinct(each)).alias("f")).select(key, "f.field", "f.weight", "f.value")
    return exploded.where(F.col("value").isNotNull())


def mapping_runs(rows: DataFrame, key: str, body: str, source: str) -> DataFrame:
    """Runs in which body and source positions grow together: key, body_start, body_end, source_start, source_end."""
    along = Stretches(rows.select(key, body, source), key, F.col(body)).previous(F.struct(body, source), "_before")
    goes_on = (F.col(body) == F.col(f"_before.{body}") + 1) & (F.col(source) == F.col(f"_before.{source}") + 1)
    marked = along.then().sum((~F.coalesce(goes_on, F.lit(False))).cast("int"), "_run").done()
    runs = marked.groupBy(key, "_run").agg(F.min(body).alias("body_start"), (F.max(body) + 1).alias("body_end"), F.min(source).alias("source_start"), (F.max(source) + 1).alias("source_end"))
    return runs.drop("_run")


def raw_range(runs: Column, start: Column, end: Column) -> Column:
    """The body range of a field range: struct start, end; null where no run has a part of it.

    ``runs`` is an array of (field_start, field_end, body_start, body_end) in order. A run of one
    length on both sides is cut; one whose sides differ counts whole. The first run gives the
    start, the last one the end.
    """
    hit = F.filter(runs, lambda r: F.greatest(r.field_start, start) < F.least(r.field_end, end))

    def part(r: Column) -> Column:
        even = r.field_end - r.field_start == r.body_end - r.body_start
        a = F.when(even, r.body_start + F.greatest(r.field_start, start) - r.field_start).otherwise(r.body_start)
        b = F.when(even, r.body_start + F.least(r.field_end, end) - r.field_start).otherwise(r.body_end)
        return F.struct(a.alias("start"), b.alias("end"))

    parts = F.transform(hit, part)
    return F.when(F.size(hit) > 0, F.struct(F.get(parts, 0).getField("start").alias("start"), F.element_at(parts, -1).getField("end").alias("end")))


def coverage(mapped: str, total: str) -> Column:
    """``complete``, ``partial``, or ``provenance`` if nothing is mapped."""
    return F.when(F.col(mapped) == 0, "provenance").when(F.col(mapped) >= F.col(total), "complete").otherwise("partial")
