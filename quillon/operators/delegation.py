"""Contents that plugins describe as nodes: text of their own, and includes and links that the engine makes for them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators import references, render, rounds, structure
from quillon.operators.tables import written

#: What a node may have; other keys are passed over.
NODES = "array<struct<kind:string,markdown:string,directive:string,arguments:string>>"


def nodes(results: DataFrame, content: str = "content", request: str = "request") -> DataFrame:
    """One row for each node of a plugin's content, a JSON list: request, node (from 0), kind, markdown, directive, arguments, error.

    A content that is no list, or null, is one node with error invalid_content; an empty list is
    one with empty_content. Arguments aren't looked at yet.
    """
    listed = results.withColumn("_c", structure.once(F.when(F.col(content).rlike(r"^\s*\["), F.from_json(content, NODES))))
    bad = F.when(F.col("_c").isNull(), "invalid_content").when(F.size("_c") == 0, "empty_content")
    each = listed.withColumn("_bad", bad).drop(content).select("*", F.posexplode_outer("_c").alias("node", "_n")).drop("_c")
    n = F.col("_n")
    # A node may carry no directive of a plugin: only the engine's own are evaluated, whoever overrides their names.
    error = F.coalesce("_bad", F.when(n.isNull() | n["kind"].isNull(), "unknown_kind"), rounds.description_error(n["kind"], n["directive"], F.lit("")), F.when((n["kind"] == "text") & n["markdown"].isNull(), "empty_content"))
    return each.select(*[c for c in each.columns if c not in ("node", "_n", "_bad")], F.coalesce("node", F.lit(0)).alias("node"), n["kind"].alias("kind"), n["markdown"].alias("markdown"), n["directive"].alias("directive"), n["arguments"].alias("arguments"), error.alias("error"))


def _called(found: DataFrame) -> DataFrame:
    """Nodes; sound standard calls with path, first, last, title_path, last_only and ``error`` of their shape, before any file is looked at."""
    call = (F.col("kind") == "standard_call") & F.col("error").isNull()
    calls = found.withColumn("_call", F.coalesce(call, F.lit(False)))
    calls = calls.withColumn("_a", structure.once(F.when(F.col("_call"), structure.arguments(F.coalesce("arguments", F.lit(""))))))
    first, named = F.get("_a.positional", F.lit(0)), F.col("_a.named")
    lines, by = F.element_at(named, F.lit("lines")), F.element_at(named, F.lit("id"))
    range_ = F.from_json(lines, "array<bigint>")
    two = lines.rlike(r"^\[\s*[0-9]+\s*,\s*[0-9]+\s*\]$")
    one = by.startswith('"')
    known = F.forall(F.map_keys(named), lambda k: k.isin("lines", "id"))
    text = (F.size("_a.positional") == 1) & first.startswith('"')
    shape = (
        ~F.coalesce(text, F.lit(False)) | ~known | (lines.isNotNull() & by.isNotNull()) | ((F.col("directive") == "link") & (F.size(named) > 0))
        | (lines.isNotNull() & ~F.coalesce(two, F.lit(False))) | (by.isNotNull() & ~F.coalesce(one | (by.rlike(r'^\[\s*"') & (F.size(F.from_json(by, "array<string>")) > 0)), F.lit(False)))
    )
    titles = F.when(one, F.array(structure.plain(by))).when(by.isNotNull(), F.from_json(by, "array<string>"))
    out = calls.withColumns({"path": structure.plain(first), "first": F.get(range_, F.lit(0)), "last": F.get(range_, F.lit(1)), "title_path": titles, "last_only": one, "error": F.when(F.col("_call"), F.coalesce("_a.error", F.when(shape, "invalid_arguments"))).otherwise(F.col("error"))})
    return out.drop("_a", "_call", "arguments")


def delegated(results: DataFrame, files: DataFrame, catalog: DataFrame, page: str = "page", request: str = "request") -> DataFrame:
    """Plugins' contents evaluated: request, markdown, error, nodes (see ``rounds.evaluated``).

    ``results`` have request, page (where the content goes) and content; ``files`` path and text of
    the sources, ``catalog`` the paths that have a page. An include gives the whole file, ``lines``
    or, by ``id``, a Markdown section: a string names a title, a list the titles from the top down.
    Markdown comes as it is, code in a fence. A link gives the URL as seen from the page. Wrong
    shapes are errors before files are looked at, ranges and selections after; whatever fails,
    the other nodes are evaluated too.
    """
    key = [request, page, "node"]
    # Four kinds of nodes go on from here: they are parsed once.
    found = written(_called(nodes(results, request=request)), "nodes")
    legal = found.where("kind = 'standard_call' AND error IS NULL").drop("error", "markdown")
    settled = found.where("kind IS NULL OR kind != 'standard_call' OR error IS NOT NULL").select(request, "node", F.when(F.col("error").isNull(), F.col("markdown")).alias("markdown"), "error")
    includes, links = legal.where("directive = 'include'"), legal.where("directive = 'link'")

    by_lines = render.included(includes.where("title_path IS NULL").select(*key, "path", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")), files)
    asked = includes.where("title_path IS NOT NULL")
    wanted = files.join(asked.select("path").distinct(), "path", "left_semi")
    sections = structure.sections(wanted.where(F.col("path").endswith(".md")))
    by_id = [render.included_sections(asked.where(F.col("last_only") == one).select(*key, "path", "title_path"), wanted, sections, last_only=one).select(*key, "path", "markdown", "error") for one in (True, False)]
    included = by_lines.select(*key, "path", "markdown", "error").unionByName(by_id[0]).unionByName(by_id[1])
    included = included.select(request, "node", _shown(F.col("path"), F.col("markdown")).alias("markdown"), "error")

    linked = references.linked(links.select(*key, F.col("path").alias("target")), catalog)
    linked = linked.select(request, "node", F.when(F.col("error").isNull(), t.relative_url(render.page_path(F.col("target")), F.col(page))).alias("markdown"), "error")
    return rounds.evaluated(settled.unionByName(included).unionByName(linked), request)


def _shown(path: Column, markdown: Column) -> Column:
    return F.when(path.endswith(".md"), markdown).otherwise(render.fenced_code(markdown, structure.language(path)))


def dependencies(results: DataFrame, request: str = "request") -> DataFrame:
    """What contents depend on, also by nodes that fail later, each once: request, path, kind (source, page)."""
    calls = _called(nodes(results, request=request)).where("kind = 'standard_call' AND error IS NULL")
    return calls.select(request, "path", F.when(F.col("directive") == "link", "page").otherwise("source").alias("kind")).distinct()


def navigation(requests: DataFrame, material: str, target: str, plugin: str = "navigation") -> DataFrame:
    """A plugin of composed contents: place, request, page, content, what ``delegated`` evaluates.

    Each of the requests (request, page) gets text, the material, a link to the target and text;
    the target's page gets a link appended, the report ``overview`` has one. The engine makes each
    URL from the page where it stands. Requests are ``result:<request>``; append and report, which
    come once, also without requests, are ``append:<target>`` and ``report:overview``.
    """
    spark = requests.sparkSession
    text = lambda s: {"kind": "text", "markdown": s}
    call = lambda name, path: {"kind": "standard_call", "directive": name, "arguments": json.dumps(path, ensure_ascii=False)}
    link = json.dumps([call("link", target)], ensure_ascii=False)
    body = json.dumps([text("Before"), call("include", material), call("link", target), text("After")], ensure_ascii=False)
    results = requests.select(F.lit("result").alias("place"), F.concat(F.lit("result:"), F.col("request").cast("string")).alias("request"), "page", F.lit(body).alias("content"))
    more = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("append").alias("place"), F.lit(f"append:{target}").alias("request"), render.page_path(F.lit(target)).alias("page"), F.lit(link).alias("content")),
        F.struct(F.lit("report").alias("place"), F.lit("report:overview").alias("request"), render.report_path(F.lit(plugin), F.lit("overview")).alias("page"), F.lit(link).alias("content")),
    )).alias("x")).select("x.*")
    return results.unionByName(more)
