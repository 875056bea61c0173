"""Pages and reports as ordered text, includes and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators import structure


def provenance(label: str, path: Column, first: Column, last: Column, start: Column, end: Column, page: Column) -> Column:
    """A quoted line that says where a part of a page comes from."""
    where = t.code_span(F.concat(path, F.lit(":L"), first.cast("string"), F.lit("-L"), last.cast("string")))
    url = F.concat(t.relative_url(path, page), F.lit("#L"), first.cast("string"))
    return F.concat(F.lit(f"> **{label}**: ["), where, F.lit("]("), url, F.lit(") · bytes ["), start.cast("string"), F.lit(","), end.cast("string"), F.lit(")"))


def fenced_code(text: Column, language: Column) -> Column:
    ticks = t.fence(text)
    return F.concat(ticks, F.coalesce(language, F.lit("")), F.lit("\n"), text, F.when(text.endswith("\n"), "").otherwise("\n"), ticks)


def page_path(path: Column) -> Column:
    return F.concat(F.lit("pages/"), path, F.lit(".md"))


def report_path(owner: Column, name: Column) -> Column:
    return F.concat(F.lit("reports/"), owner, F.lit("/"), name, F.lit(".md"))


def assembled(chunks: DataFrame, page: str, order: str, chunk: str, between: str = "") -> DataFrame:
    """One row per page: its chunks in order, joined: page, markdown."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, chunk))), lambda x: x[chunk]), between)
    return chunks.groupBy(page).agg(joined.alias("markdown"))


def included(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Include requests (path, first, last; the whole file if both are null) with ``markdown`` or ``error``.

    Errors are rows: source_error, invalid_range, empty_selection.
    """
    got = requests.join(files.select("path", "text", F.lit(True).alias("_there")), "path", "left")
    # Files are cut where lines are asked for, once; so is the selection, which several expressions look at.
    got = got.withColumn("_cut", structure.once(F.when(F.col("first").isNotNull() | F.col("last").isNotNull(), F.split("text", r"(?<=\n)"))))
    count = F.size("_cut") - F.col("text").endswith("\n").cast("int")
    chosen = F.array_join(F.slice("_cut", F.greatest(F.coalesce("first", F.lit(1)), F.lit(1)), F.greatest(F.coalesce(F.col("last") - F.col("first") + 1, count), F.lit(0))), "")
    got = got.withColumn("_lines", structure.once(F.when(F.col("_cut").isNull(), F.col("text")).otherwise(chosen)))
    legal = F.col("first").isNull() | ((F.col("first") >= 1) & (F.col("first") <= F.col("last")) & (F.col("last") <= count))
    error = F.when(F.col("_there").isNull(), "source_error").when(~legal, "invalid_range").when(~F.col("_lines").rlike(r"\S"), "empty_selection")
    return got.withColumns({"error": error, "markdown": F.when(error.isNull(), F.col("_lines"))}).drop("text", "_there", "_cut", "_lines")


def included_sections(requests: DataFrame, files: DataFrame, sections: DataFrame, last_only: bool = False) -> DataFrame:
    """Include requests (path, title_path) with ``markdown``, the section's text as it is, or ``error``.

    ``title_path`` names the headings from the top down, or, with ``last_only``, only the
    section's own title. Errors are rows: source_error, selection_not_found, selection_ambiguous.
    """
    titles = F.slice("title_path", -1, 1) if last_only else F.col("title_path")
    found = sections.groupBy("path", titles.alias("title_path")).agg(F.count("*").alias("_n"), F.min_by(F.struct("start_byte", "end_byte"), "start_byte").alias("_span"))
    got = requests.join(found, ["path", "title_path"], "left").join(files.select("path", F.col("text").alias("_text")), "path", "left")
    error = F.when(F.col("_text").isNull(), "source_error").when(F.col("_n").isNull(), "selection_not_found").when(F.col("_n") > 1, "selection_ambiguous")
    span = F.decode(F.substring(F.encode("_text", "UTF-8"), F.col("_span.start_byte") + 1, F.col("_span.end_byte") - F.col("_span.start_byte")), "UTF-8")
    return got.withColumns({"error": error, "markdown": F.when(error.isNull(), span)}).drop("_n", "_span", "_text")


def reports(inputs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Reports as Markdown: report, markdown: a heading, the plugin, its inputs, then the fragments.

    inputs: owner, name, order, input; fragments: owner, name, order, markdown. A report without
    inputs or fragments has what is there of it.
    """
    lines = inputs.select("owner", "name", F.lit(0).alias("_part"), "order", F.concat(F.lit("  \n> **Input**: "), t.code_span(F.col("input"))).alias("_chunk"))
    bodies = fragments.select("owner", "name", F.lit(1).alias("_part"), "order", F.concat(F.lit("\n\n"), "markdown").alias("_chunk"))
    both = lines.unionByName(bodies).groupBy("owner", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "order", "_chunk"))), lambda x: x["_chunk"]), "").alias("_rest"))
    head = F.concat(F.lit("# Report: "), t.code_span(F.col("name")), F.lit("\n\n> **Plugin**: "), t.code_span(F.col("owner")))
    return both.select(report_path(F.col("owner"), F.col("name")).alias("report"), F.concat(head, "_rest", F.lit("\n")).alias("markdown"))


def substituted(text: Column, starts: Column, ends: Column, values: Column) -> Column:
    """A text with the ranges [start, end), in characters, sorted and apart, replaced by values."""
    calls = F.arrays_zip(starts.alias("s"), ends.alias("e"), values.alias("v"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, c: F.struct(c.e.cast("int").alias("at"), F.concat(acc.out, F.substring(text, acc.at + 1, c.s.cast("int") - acc.at), c.v).alias("out"))
    return F.aggregate(calls, begin, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))


def with_appendix(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages (page, markdown) with the appendix blocks (page, plugin, markdown) of theirs, in plugin order."""
    appendix = blocks.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("plugin", "markdown"))), lambda x: x.markdown), "\n\n").alias("_more"))
    out = pages.join(appendix, "page", "left")
    return out.withColumn("markdown", F.when(F.col("_more").isNull(), F.col("markdown")).otherwise(F.concat("markdown", F.lit("# Appendix\n\n"), "_more", F.lit("\n")))).drop("_more")


def gate(diagnostics: DataFrame, reports: DataFrame, pages: DataFrame) -> DataFrame:
    """Reports that must not be published in a failed round, as they link to its pages: report.

    diagnostics: severity; reports: report, target; pages: page. Empty if no check failed.
    """
    linking = reports.join(pages.select(F.col("page").alias("target")), "target", "left_semi").select("report").distinct()
    return linking if diagnostics.where("severity = 'error'").head(1) else linking.where(F.lit(False))


def first_failures(nodes: DataFrame, request: str, node: str, error: str) -> DataFrame:
    """Each request with the error of its first failing node, null if none fails: request, error, nodes."""
    return nodes.groupBy(request).agg(F.min_by(error, F.when(F.col(error).isNotNull(), F.col(node))).alias("error"), F.count("*").alias("nodes"))
