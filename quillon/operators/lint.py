"""Checks of a documentation tree: every finding is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import joined_path
from quillon.operators import clauses, structure

LINK = r"\[[^\]]*\]\(([^)]+)\)"


def links(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Local links of Markdown files outside fenced code: path, line_no, target, to, anchor.

    Found in the file's row: only links are exploded. ``to`` is the path that the target means,
    its escapes decoded, as seen from the file's folder; null if it leads out of the tree. A
    target that is only an anchor means its own file. URLs with a scheme, and targets with a
    directive, aren't local.
    """
    rows = files.select(key, text, structure.once(structure.fences(F.col(text)).getField("blocks")).alias("_blocks"))
    every = F.transform(F.split(text, r"(?<=\n)"), lambda line, i: F.struct((i + 1).alias("line_no"), F.regexp_extract_all(line, F.lit(LINK), F.lit(1)).alias("targets")))
    # Texts without a link are passed over by one search.
    some = F.when(F.col(text).rlike(LINK), F.filter(every, lambda x: F.size(x.targets) > 0))
    each = rows.select(key, "_blocks", F.explode(some).alias("_l")).where(~F.exists("_blocks", lambda b: F.col("_l.line_no").between(b.first, b.last)))
    each = each.select(key, F.col("_l.line_no").alias("line_no"), F.explode("_l.targets").alias("target"))
    each = each.withColumn("target", F.regexp_replace(F.trim("target"), "^<+|>+$", "")).where(~F.col("target").contains("{%") & ~F.col("target").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"))
    name = F.substring_index("target", "#", 1)
    anchor = F.when(F.col("target").contains("#"), F.regexp_replace("target", "^[^#]*#", ""))
    # A plus is itself in a path; what is no escape is kept as it stands.
    plain = F.replace(name, F.lit("+"), F.lit("%2B"))
    to = F.when(name == "", F.col(key)).otherwise(joined_path(F.regexp_replace(F.col(key), "[^/]*$", ""), F.coalesce(F.try_url_decode(plain), name)))
    return each.select(key, "line_no", "target", to.alias("to"), anchor.alias("anchor"))


def _there(paths: DataFrame) -> DataFrame:
    """Paths and all folders above them, each once: _there."""
    parts = F.split("path", "/")
    return paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_there")).union(paths.sparkSession.range(1).select(F.lit("").alias("_there"))).distinct()


def findings(files: DataFrame, others: DataFrame | None = None, pattern: str = clauses.CLAUSE, anchored: str = "spec-") -> DataFrame:
    """What is wrong with the Markdown files (path, text): path, line_no, code, subject. Empty for a sound tree.

    duplicate_definition (all but a clause's first definition by path and place), definition_anchor
    (a definition whose file hasn't exactly one anchor of it), undefined_clause (named, defined
    nowhere), broken_link, missing_anchor (only anchors that begin with ``anchored`` are looked
    up). ``others`` (path) are files that may be linked to but aren't checked. ``line_no`` is null
    for what belongs to a whole file. A null text has no findings.
    """
    defined = clauses.definitions(files, pattern)
    first = defined.groupBy(F.col("clause").alias("_clause")).agg(F.min(F.struct("path", "start_byte")).alias("_first"))
    twice = defined.join(first, F.col("clause") == F.col("_clause")).where(F.struct("path", "start_byte") != F.col("_first"))
    unknown = clauses.mentions(files, pattern).join(first, F.col("clause") == F.col("_clause"), "left_anti")

    paths = files.select("path") if others is None else files.select("path").unionByName(others.select("path"))
    at = links(files).join(_there(paths), F.col("to") == F.col("_there"), "left")
    ids = files.select(F.col("path").alias("_in"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit('id="([^"]*)"'), F.lit(1)))).alias("_id")).where(F.col("_id").startswith(anchored))
    asked = at.where(F.col("_there").isNotNull() & F.col("anchor").startswith(anchored))
    # Anchors of files that aren't checked aren't known.
    asked = asked.join(files.select(F.col("path").alias("_file")).distinct(), F.col("to") == F.col("_file"), "left_semi")
    lost = asked.join(ids, (F.col("to") == F.col("_in")) & (F.col("anchor") == F.col("_id")), "left_anti")

    def finding(df: DataFrame, code: str, subject: Column, line: Column | None = None) -> DataFrame:
        return df.select("path", (F.lit(None) if line is None else line).cast("int").alias("line_no"), F.lit(code).alias("code"), subject.alias("subject"))

    clause, target, line = F.col("clause"), F.col("target"), F.col("line_no")
    return reduce(
        DataFrame.unionByName,
        [
            finding(twice, "duplicate_definition", clause),
            finding(defined.where("NOT valid"), "definition_anchor", clause),
            finding(unknown, "undefined_clause", clause),
            finding(at.where("_there IS NULL"), "broken_link", target, line),
            finding(lost, "missing_anchor", target, line),
        ],
    )
