"""Ranked keyword search and bounded reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators.records import positions
from quillon.operators.stretches import Stretches

#: The weight of a match by field.
WEIGHTS = {"title": 8, "selector": 8, "identifier": 8, "path": 4, "plugin": 2, "body": 1}
EXACT_FIELDS = ("title", "selector", "identifier")
PAGE, BUDGET, MOST_NEIGHBOURS = 5, 12_000, 5


def check_query(query: str, limit: int) -> None:
    if not query.strip():
        raise ValueError("a query must not be blank")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")


def _has(term: str):
    return lambda x: t.matches(x, term)


def _field(rows: DataFrame, column: str, test) -> Column:
    """A test of a field, or of any item of a field that is an array."""
    many = rows.schema[column].dataType.typeName() == "array"
    return F.coalesce(F.exists(column, test) if many else test(F.col(column)), F.lit(False))


def _hit(term: str, field: str, shown: Column):
    return lambda at: F.struct(F.lit(term).alias("term"), F.lit(field).alias("field"), shown.alias("text"), at.start.alias("start"), at.end.alias("end"))


def scored(rows: DataFrame, columns: dict[str, str], query: str) -> DataFrame:
    """``rows`` that match a query, with terms, term_count, score and exact.

    ``columns`` maps fields to columns; an array counts item by item. A term scores the weight of
    its heaviest field. All is decided within the row: no explode, no shuffle; the terms are
    literals of the plan.
    """
    per_term = []
    for term in t.query_terms(query):
        weight: Column = F.lit(0)
        for field, column in sorted(columns.items(), key=lambda x: WEIGHTS[x[0]]):
            weight = F.when(_field(rows, column, _has(term)), F.lit(WEIGHTS[field])).otherwise(weight)
        # The heaviest field is asked first, so lighter ones are looked at only if it has no match.
        per_term.append(F.struct(F.lit(term).alias("term"), F.coalesce(weight, F.lit(0)).alias("weight")))
    if not per_term:
        return rows.where(F.lit(False)).withColumns({"terms": F.array().cast("array<string>"), "term_count": F.lit(0), "score": F.lit(0), "exact": F.lit(False)})
    exact = F.lit(False)
    for field in EXACT_FIELDS:
        if field in columns:
            exact = exact | _field(rows, columns[field], lambda x: t.ascii_lower(x) == query.translate(t._TO_LOWER))
    # As a generator's row: later filters and sorts don't evaluate the matches again.
    hits = rows.withColumn("_hits", F.explode(F.array(F.filter(F.array(*per_term), lambda x: x.weight > 0))))
    hits = hits.where(F.size("_hits") > 0)
    return hits.withColumns({"terms": F.transform("_hits", lambda x: x.term), "term_count": F.size("_hits"), "score": F.aggregate("_hits", F.lit(0), lambda a, x: a + x.weight), "exact": exact}).drop("_hits")


def matched(rows: DataFrame, columns: dict[str, str], query: str) -> DataFrame:
    """``rows`` with ``matches``: term, field, text (null for the body), start, end of the first hit of each term in each field.

    Of an array, the first item that has the term counts. Meant for the few rows that are shown.
    """
    each = []
    for term in t.query_terms(query):
        for field, column in columns.items():
            if rows.schema[column].dataType.typeName() == "array":
                text = F.get(F.filter(column, _has(term)), 0)
            else:
                text = F.col(column).cast("string")
            at = t.first_range(text, term)
            shown = F.lit(None).cast("string") if field == "body" else text
            each.append(F.transform(F.array_compact(F.array(at)), _hit(term, field, shown)))
    none = F.array().cast("array<struct<term:string,field:string,text:string,start:int,end:int>>")
    # As a generator's row: what explodes or filters the matches later doesn't look for them again.
    return rows.withColumn("matches", F.explode(F.array(F.flatten(F.array(*each)) if each else none)))


def search(rows: DataFrame, columns: dict[str, str], query: str, limit: int = 10, path: str | None = None, path_column: str = "path", ties: tuple[str, ...] = ()) -> DataFrame:
    """The best ``limit`` rows: more terms first, then exact, score, and ``ties`` ascending."""
    check_query(query, limit)
    if path is not None:
        rows = rows.where(t.under(F.col(path_column), path))
    found = scored(rows, columns, query)
    return found.orderBy(F.desc("term_count"), F.desc("exact"), F.desc("score"), *ties).limit(limit)


def neighbours(rows: DataFrame, page: str, position: str, n: int) -> DataFrame:
    """Pairs of a row and each other row of its page at most ``n`` positions away.

    Each row is sent to the 2n positions around it, so the join is on equality and its rows are
    2n times the input at most.
    """
    if not 1 <= n <= MOST_NEIGHBOURS:
        raise ValueError(f"context must be 1 to {MOST_NEIGHBOURS}")
    around = rows.select(*(F.col(c).alias(f"near_{c}") for c in rows.columns), F.explode(F.array(*(F.lit(i) for i in range(-n, n + 1) if i))).alias("_step"))
    around = around.withColumn("_at", F.col(f"near_{position}") + F.col("_step")).withColumn("_page", F.col(f"near_{page}"))
    return rows.join(around, (rows[page] == around["_page"]) & (rows[position] == around["_at"])).drop("_step", "_at", "_page")


def budgeted(rows: DataFrame, page: str, position: str, text: str, budget: int = BUDGET, own: Column | None = None) -> DataFrame:
    """Rows with ``shown``: the characters of each that a page's budget still has room for, in order; rows of ``own`` first."""
    own = F.lit(False) if own is None else own
    # The rows of ``own`` are few on a page: their lengths are summed up for all others.
    first = rows.where(own).groupBy(F.col(page).alias("_page")).agg(F.sum(F.length(text)).alias("_first"))
    others = Stretches(rows.withColumn("_own", own), page, F.col(position)).sum(F.when(~F.col("_own"), F.length(text)).otherwise(0), "_others", before=True).sum(F.when(F.col("_own"), F.length(text)).otherwise(0), "_ahead", before=True).done()
    others = others.join(first, F.col(page).eqNullSafe(F.col("_page")), "left")
    used = F.when(F.col("_own"), F.col("_ahead")).otherwise(F.col("_others") + F.coalesce("_first", F.lit(0)))
    return others.withColumn("shown", F.greatest(F.lit(0), F.least(F.length(text), F.lit(budget) - used)).cast("long")).select(*rows.columns, "shown")


def cursor_page(rows: DataFrame, record: str, order: list[str], snapshot: str, name: str, offset: int, size: int = PAGE) -> DataFrame:
    """One page of each record's list, with the cursor of the next: ``snapshot:record:list:offset``, null on the last page."""
    page = list_page(rows, record, order, offset, size)
    cursor = F.concat_ws(":", F.lit(snapshot), F.col(record).cast("string"), F.lit(name), F.col("next_offset").cast("string"))
    return page.withColumn("next_cursor", F.when(F.col("next_offset").isNotNull(), cursor))


def list_page(rows: DataFrame, owner: str, order: list[str], offset: int, size: int = PAGE) -> DataFrame:
    """One page of each owner's list, with total, number and next_offset (null on the last page)."""
    if offset % size or offset < 0:
        raise ValueError(f"offset must be a multiple of {size}")
    w = Window.partitionBy(owner).orderBy(*order)
    # Only the first rows of an owner pass through the shuffle; the totals are counts.
    page = rows.withColumn("number", F.row_number().over(w)).where(F.col("number") <= offset + size).where(F.col("number") > offset).withColumn("number", F.col("number") - 1)
    totals = rows.groupBy(F.col(owner).alias("_owner")).agg(F.count("*").alias("total"))
    page = page.join(totals, F.col(owner).eqNullSafe(F.col("_owner"))).drop("_owner")
    return page.withColumn("next_offset", F.when(F.col("total") > offset + size, F.lit(offset + size)))


def drained(rows: DataFrame, key: str, text: str, budget: int = BUDGET) -> DataFrame:
    """Every text in all its bounded slices, as following the continuations gives them: key, part, body, start_byte, next_offset."""
    count = F.greatest(F.ceil(F.length(text) / budget), F.lit(1)).cast("int")
    each = rows.select(key, text, F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    before = F.substring(F.col(text), F.lit(1), F.col("part") * budget)
    body = F.substring(F.col(text), F.col("part") * budget + 1, F.lit(budget))
    end = F.octet_length(before) + F.octet_length(body)
    return each.select(key, "part", body.alias("body"), F.octet_length(before).cast("long").alias("start_byte"), F.when(end < F.octet_length(text), end).cast("long").alias("next_offset"))


def next_of_kind(rows: DataFrame, page: str, position: str, kind: str, wanted: str, value: str, within: int = 5) -> DataFrame:
    """Rows with ``next_value``: ``value`` of the nearest following row of the wanted kind, at most ``within`` rows on."""
    ahead = Window.partitionBy(page).orderBy(position).rowsBetween(1, within)
    return rows.withColumn("next_value", F.first(F.when(F.col(kind) == wanted, F.col(value)), ignorenulls=True).over(ahead))


def marker_runs(rows: DataFrame, page: str, position: str, marker: Column) -> DataFrame:
    """Rows that are no markers with the markers right beside them: ``markers_before``, ``markers_after`` (counts).

    Positions are gapless from 0. Only rows that are no markers are looked at, each beside the one
    before and the one after, so a run of markers of any length is two numbers; pages go by stretches.
    """
    ends = rows.groupBy(F.col(page).alias("_page")).agg(F.max(position).alias("_last"))
    others = rows.where(~marker)
    found = Stretches(others, page, F.col(position)).previous(F.col(position), "_before").done()
    found = Stretches(found, page, -F.col(position)).previous(F.col(position), "_after").done()
    found = found.join(ends, F.col(page).eqNullSafe(F.col("_page")))
    before = F.col(position) - F.coalesce("_before", F.lit(-1)) - 1
    after = F.coalesce("_after", F.col("_last") + 1) - F.col(position) - 1
    return found.withColumns({"markers_before": before.cast("long"), "markers_after": after.cast("long")}).select(*rows.columns, "markers_before", "markers_after")


def calls_drained(occurrences: DataFrame, record: str, page: str, position: str, plugin: Column, site: str) -> DataFrame:
    """All occurrences that a plugin's calls brought, as following cursors to the end gives them: the rows with ``number`` (from 0 per record).

    Kept are those of ``plugin`` with a call site. Numbers go by record, page and position over
    many tasks: counts of pages are summed up, rows number themselves on their page.
    """
    kept = occurrences.where(plugin & F.col(site).isNotNull())
    both = F.xxhash64(record, page)
    numbered = positions(kept.withColumnRenamed(position, "_at0").withColumn("_both", both), "_both", "_at0")
    numbered = numbered.withColumnRenamed("position", "_own0").withColumnRenamed("_at0", position)
    counts = kept.groupBy(F.col(record).alias("_record"), F.col(page).alias("_page")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_record").orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    met = numbered.join(starts, F.col(record).eqNullSafe(F.col("_record")) & F.col(page).eqNullSafe(F.col("_page")))
    return met.withColumn("number", F.col("_start") + F.col("_own0")).select(*occurrences.columns, "number")
