"""Running values along a key's rows, by many tasks for each key.

A key is cut into stretches of ``width`` of a numeric column. A window runs within a stretch; what
earlier stretches leave behind, one row for each, is carried over by a window over those rows. So
a key with a third of all rows is many tasks, and through one task for a key go its stretches.

Rows are dealt out once, by a hash of key and stretch. All values of a step share one summary of
the stretches and one join, both of which take the rows as they were dealt; ``then`` begins a step
whose values build on those before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Stretches:
    """Rows of ``key`` in the order of the numeric ``at``, then of ``ties``."""

    def __init__(self, rows: DataFrame, key: str, at: Column, ties: tuple[str, ...] = (), width: int = 1 << 16):
        self.key, self.columns = key, list(rows.columns)
        rows = rows.withColumn("_at", at).withColumn("_s", F.floor(F.col("_at") / width))
        self.rows = rows.withColumn("_g", F.xxhash64(key, "_s")).repartition("_g")
        self.order = [F.col("_at"), *map(F.col, ties)]
        self.own = Window.partitionBy("_g", key, "_s").orderBy(*self.order)
        self.upto = self.own.rowsBetween(Window.unboundedPreceding, 0)
        self.earlier = self.own.rowsBetween(Window.unboundedPreceding, -1)
        #: Name, what a stretch leaves, what earlier ones leave together, the value from both.
        self.asked: list[tuple[str, Column, Callable[[Column], Column], Callable[[Column], Column]]] = []

    def then(self) -> Stretches:
        """The values asked for so far become columns."""
        if not self.asked:
            return self
        along = Window.partitionBy("_k").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
        names = [name for name, *_ in self.asked]
        per = self.rows.groupBy("_g", self.key, "_s").agg(*(left.alias(f"_left_{i}") for i, (_, left, _, _) in enumerate(self.asked)))
        per = per.select(F.col("_g").alias("_h"), F.col(self.key).alias("_k"), F.col("_s").alias("_t"), *(c for c in per.columns if c.startswith("_left_")))
        per = per.select("_h", "_k", "_t", *(over(F.col(f"_left_{i}")).over(along).alias(f"_carried_{i}") for i, (_, _, over, _) in enumerate(self.asked)))
        # The hash alone deals the rows out; that key and stretch are equal is looked at besides.
        same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.col(a).isNull() & F.col(b).isNull())
        met = self.rows.join(per, (F.col("_g") == F.col("_h")) & same(self.key, "_k") & same("_s", "_t"))
        values = {name: value(F.col(f"_carried_{i}")) for i, (name, _, _, value) in enumerate(self.asked)}
        self.rows = met.withColumns(values).select(*self.columns, *names, "_at", "_s", "_g")
        self.columns += names
        self.asked = []
        return self

    def sum(self, value: Column, name: str, before: bool = False) -> Stretches:
        """The sum up to each row, or before it."""
        own = F.coalesce(F.sum(value).over(self.earlier if before else self.upto), F.lit(0))
        self.asked.append((name, F.sum(value), F.sum, lambda c: own + F.coalesce(c, F.lit(0))))
        return self

    def most_before(self, value: Column, name: str) -> Stretches:
        """The greatest value before each row, null at the first."""
        self.asked.append((name, F.max(value), F.max, lambda c: F.greatest(F.max(value).over(self.earlier), c)))
        return self

    def previous(self, value: Column, name: str) -> Stretches:
        """The value of the row before, null at the first."""
        last = F.max_by(F.struct(value.alias("v")), F.struct(*self.order))
        own = F.lag(F.struct(value.alias("v"))).over(self.own)
        self.asked.append((name, last, lambda c: F.last(c, ignorenulls=True), lambda c: F.coalesce(own, c).getField("v")))
        return self

    def latest(self, value: Column, name: str) -> Stretches:
        """The last value that isn't null, up to each row."""
        last = F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
        own = F.last(value, ignorenulls=True).over(self.upto)
        self.asked.append((name, last, lambda c: F.last(c, ignorenulls=True), lambda c: F.coalesce(own, c)))
        return self

    def done(self) -> DataFrame:
        self.then()
        return self.rows.select(*self.columns)
