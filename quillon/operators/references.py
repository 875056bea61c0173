"""Definitions and the references to them; owners, requests, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_counts(definitions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Each defined id with its definitions, references and status: unique, ambiguous; unreferenced ones have 0."""
    d = definitions.groupBy(key).agg(F.count("*").alias("definitions"))
    r = references.groupBy(key).agg(F.count("*").alias("n_references"))
    status = F.when(F.col("definitions") > 1, "ambiguous").otherwise("unique")
    return d.join(r, key, "left").select(key, "definitions", F.coalesce("n_references", F.lit(0)).alias("n_references"), status.alias("status"))


def resolved(references: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """References with ``resolution``: ok, unknown, or ambiguous."""
    d = definitions.groupBy(key).agg(F.count("*").alias("_n"))
    state = F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").otherwise("ok")
    return references.join(d, key, "left").withColumn("resolution", state).drop("_n")


def unreferenced(definitions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    return definitions.join(references.select(key), key, "left_anti")


def routed(directives: DataFrame, owners: DataFrame, name: str = "name") -> DataFrame:
    """Directives with their ``owner``; an unknown name has ``error`` unknown_directive.

    Owners are a configuration's few rows. A list of the driver's has no size that Spark knows, so
    they are broadcast by name; else all directives of a name would meet in one task.
    """
    out = directives.join(F.broadcast(owners), name, "left")
    return out.withColumn("error", F.when(F.col("owner").isNull(), "unknown_directive"))


def linked(requests: DataFrame, catalog: DataFrame, target: str = "target") -> DataFrame:
    """Link requests with ``error`` page_not_selected where the target is no page."""
    pages = catalog.select(F.col("path").alias(target), F.lit(True).alias("_page")).distinct()
    out = requests.join(pages, target, "left")
    return out.withColumn("error", F.when(F.col("_page").isNull(), "page_not_selected")).drop("_page")


def associated(named: DataFrame, inventory: DataFrame, test: str, clauses: str, clause: str) -> DataFrame:
    """One row for each test and clause that it names, of those in the inventory: clause, test, together.

    ``clauses`` is an array; ``together`` counts the test's known clauses.
    """
    each = named.select(test, F.explode(F.array_distinct(clauses)).alias(clause)).join(inventory.select(clause).distinct(), clause, "left_semi")
    counts = each.groupBy(test).agg(F.count("*").alias("together"))
    return each.join(counts, test).select(clause, test, "together")


def reviewed(current: DataFrame, ledger: DataFrame, key: str, value: str) -> DataFrame:
    """Ledger against current values: key, state: stale, unreviewed, orphan, current."""
    c = current.select(key, F.col(value).alias("_now"), F.lit(True).alias("_c"))
    old = ledger.select(key, F.col(value).alias("_was"), F.lit(True).alias("_l"))
    state = F.when(F.col("_l").isNull(), "unreviewed").when(F.col("_c").isNull(), "orphan").when(F.col("_now").eqNullSafe(F.col("_was")), "current").otherwise("stale")
    return c.join(old, key, "full_outer").select(key, state.alias("state"))
