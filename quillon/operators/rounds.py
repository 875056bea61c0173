"""A round of publication: what calls became, what was published, what is owned, what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import under
from quillon.operators import structure
from quillon.operators.integrity import compared, span_errors
from quillon.operators.regions import open_region

#: Fixed value: dirty paths of a root beyond which all of it is scanned again.
MOST_DIRTY = 4096


def at_calls(calls: DataFrame, expansions: DataFrame, key: tuple[str, str] = ("path", "start_byte")) -> DataFrame:
    """Calls with the expansion at their place; ``error`` is no_expansion or no_call where one has no other."""
    a = calls.withColumn("_call", F.lit(True))
    b = expansions.withColumn("_expansion", F.lit(True))
    error = F.when(F.col("_expansion").isNull(), "no_expansion").when(F.col("_call").isNull(), "no_call")
    return a.join(b, list(key), "full_outer").withColumn("error", error).drop("_call", "_expansion")


def with_calls(occurrences: DataFrame, calls: DataFrame, key: tuple[str, str] = ("path", "start_byte")) -> DataFrame:
    """Occurrences with the columns of the call at their place, nulls where they come from none."""
    return occurrences.join(calls, list(key), "left")


def evaluated(nodes: DataFrame, request: str = "request", node: str = "node", between: str = "\n\n") -> DataFrame:
    """Contents of requests from their nodes (markdown or error): request, markdown, error, nodes.

    All nodes are there, also after a failing one; the first failure by node number is the
    request's, with its place. Blank contents fail as empty_content. A request's nodes come
    together; requests are many.
    """
    bad = F.col("error").isNotNull()
    first = F.min(F.when(bad, F.struct(F.col(node).alias("at"), F.concat(F.lit("content["), F.col(node).cast("string"), F.lit("]: "), "error").alias("error")))).getField("error")
    blocks = F.transform(F.array_sort(F.collect_list(F.struct(F.col(node).alias("at"), F.coalesce("markdown", F.lit("")).alias("markdown")))), lambda x: x.markdown)
    rows = nodes.groupBy(request).agg(first.alias("_failed"), blocks.alias("_blocks"), F.count("*").alias("nodes"))
    blank = F.forall("_blocks", lambda x: ~x.rlike(r"[^ \t\r\n]"))
    error = F.coalesce("_failed", F.when(blank, "empty_content"))
    return rows.select(request, F.when(error.isNull(), F.array_join("_blocks", between)).alias("markdown"), error.alias("error"), "nodes")


def fragment_error(markdown: Column, sources: Column, required: Column, layout: Column) -> Column:
    """Why a fragment can't be published, null if it can: byte_order_mark, nul, empty, no_sources, open_fence, open_html.

    ``sources`` counts its sources; ``layout`` allows white space alone, which needs none.
    """
    blank = ~markdown.rlike(r"[^ \t\r\n]")
    return (
        F.when(markdown.startswith("\ufeff"), "byte_order_mark")
        .when(markdown.contains("\0"), "nul")
        .when(markdown.isNull() | (markdown == "") | (blank & ~layout), "empty")
        .when(required & ~blank & (sources == 0), "no_sources")
        .otherwise(open_region(markdown))
    )


def fragments_checked(fragments: DataFrame, files: DataFrame, fragment: str = "fragment") -> DataFrame:
    """Fragments with ``error``, null for a sound one: first what is wrong with the text, then the first source that doesn't fit its file.

    ``fragments`` have markdown, required, layout and sources (array of path, start_byte, end_byte,
    start_line, end_line); ``files`` path and text. Sources meet their files by path, one row
    each, and what fails comes back as ``sources[i]: error``, the smallest i of each fragment.
    """
    own = fragments.withColumn("_fragment", F.col(fragment))
    each = own.select("_fragment", F.posexplode("sources").alias("_i", "_s")).select("_fragment", "_i", "_s.*")
    bad = span_errors(each, files).groupBy("_fragment").agg(F.min(F.struct("_i", "error")).alias("_bad"))
    met = own.join(bad.withColumnRenamed("_fragment", "_of"), F.col("_fragment").eqNullSafe(F.col("_of")), "left")
    text = fragment_error(F.col("markdown"), F.size("sources"), F.col("required"), F.col("layout"))
    source = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("sources["), F.col("_bad._i").cast("string"), F.lit("]: "), F.col("_bad.error")))
    return met.withColumn("error", F.coalesce(text, source)).select(*fragments.columns, "error")


def unless(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """All rows if ``gate`` is empty, else none; one plan, in which one row of the gate is enough."""
    shut = gate.select(F.lit(True).alias("_shut")).limit(1)
    return rows.withColumn("_open", F.lit(True)).join(F.broadcast(shut), F.col("_open") == F.col("_shut"), "left_anti").drop("_open")


def removed_pages(owned: DataFrame, pages: DataFrame, diagnostics: DataFrame, key: str = "page") -> DataFrame:
    """Pages owned before that this round didn't make; none if a check failed."""
    gone = owned.select(key).join(pages.select(key), key, "left_anti").distinct()
    return unless(gone, diagnostics.where("severity = 'error'"))


def output_differences(index: DataFrame, published: DataFrame, key: str = "page", digest: str = "sha256") -> DataFrame:
    """Pages of an index whose published file isn't the one it was made with: page, state (missing, changed)."""
    there = published.select(key, F.col(digest).alias("_now"), F.lit(True).alias("_there"))
    got = index.select(key, digest).join(there, key, "left")
    state = F.when(F.col("_there").isNull(), "missing").when(~F.col(digest).eqNullSafe(F.col("_now")), "changed")
    return got.select(key, state.alias("state")).where("state IS NOT NULL")


def list_differences(old: DataFrame, new: DataFrame, owner: str, item: str) -> DataFrame:
    """Owners whose sets of items differ: owner, added, removed (counts)."""
    a = old.select(owner, item).distinct().withColumn("_old", F.lit(1))
    b = new.select(owner, item).distinct().withColumn("_new", F.lit(1))
    each = a.join(b, [owner, item], "full_outer")
    out = each.groupBy(owner).agg(F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(F.col("_new").isNull()).alias("removed"))
    return out.where("added + removed > 0")


def adopted(index: DataFrame, published: DataFrame, scope: DataFrame, key: str = "page", digest: str = "sha256") -> DataFrame:
    """Published pages that a new run may own: those with the index's hash, if ``scope`` (differences of scopes) is empty."""
    same = published.select(key, digest).join(index.select(key, digest), [key, digest], "left_semi").select(key).distinct()
    return unless(same, scope)


def without_outputs(facts: DataFrame, outputs: tuple[str, ...], path: str = "path", dependency: str = "dependency") -> DataFrame:
    """Facts that aren't below generated trees; a dependency there stays, with ``error`` cycle."""
    below = F.lit(False)
    for prefix in outputs:
        below = below | under(F.col(path), prefix)
    return facts.withColumn("error", F.when(below & F.col(dependency), "cycle")).where(~below | F.col(dependency))


def unknown_facts(changes: DataFrame, known: DataFrame, path: str, value: str) -> DataFrame:
    """Changed paths outside what is known, each new value of one once: path, value, n."""
    return changes.join(known.select(path).distinct(), path, "left_anti").groupBy(path, value).agg(F.count("*").alias("n"))


def advanced(baseline: DataFrame, operations: DataFrame, created: DataFrame, folder: str = "folder") -> DataFrame:
    """The baseline with the operations on folders that this publisher made itself, and on no others."""
    own = operations.join(created.select(folder).distinct(), folder, "left_semi")
    return baseline.unionByName(own.select(*baseline.columns)).distinct()


def scans(dirty: DataFrame, root: str = "root", path: str = "path", most: int = MOST_DIRTY) -> DataFrame:
    """What to look at again for each root: root, paths, everything (true beyond ``most`` different paths)."""
    paths = dirty.select(root, path).distinct().groupBy(root).agg(F.count("*").alias("paths"))
    return paths.withColumn("everything", F.col("paths") > most)


def under_reasons(path: str, inputs: str, sources: str) -> Column:
    """Why a record lies below a path: an array of input and source; both columns are arrays of paths."""
    below = lambda c: F.exists(c, lambda x: under(x, path))
    return F.array_compact(F.array(F.when(below(inputs), "input"), F.when(below(sources), "source")))


def owned_after(owned: DataFrame, replaced: DataFrame, removed: DataFrame, key: str = "page") -> DataFrame:
    """What a publisher owns after a round: what it owned or replaced, less what it removed. A page both removed and replaced is owned."""
    return owned.select(key).join(removed.select(key), key, "left_anti").union(replaced.select(key)).distinct()


def subscriptions(desired: DataFrame, current: DataFrame, key: str = "folder") -> DataFrame:
    """Changes of subscriptions, all additions before any removal: folder, action, step."""
    more = desired.select(key).distinct().join(current.select(key), key, "left_anti").select(key, F.lit("add").alias("action"), F.lit(0).alias("step"))
    less = current.select(key).distinct().join(desired.select(key), key, "left_anti").select(key, F.lit("remove").alias("action"), F.lit(1).alias("step"))
    return more.unionByName(less)


def sample(**components: DataFrame) -> DataFrame:
    """The state of all that a round depends on: component, key, value. Each component has key and value."""
    rows = [df.select(F.lit(name).alias("component"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")) for name, df in components.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def freshness(before: DataFrame, now: DataFrame) -> DataFrame:
    """Two samples compared: component, changed (facts that were added, removed or changed), facts; stale where changed > 0."""
    each = compared(before, now, ["component", "key"], ["value"])
    return each.groupBy("component").agg(F.count_if(F.col("state") != "same").alias("changed"), F.count("*").alias("facts"))


def published_reports(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """Reports of known owners among published paths: path, owner, name; ``reports/<owner>/<name>.md`` with valid names."""
    part = lambda i: F.regexp_extract("path", r"^reports/([a-z][a-z0-9_-]*)/([A-Za-z0-9][A-Za-z0-9_#-]*)\.md$", i)
    named = paths.select("path", part(1).alias("owner"), part(2).alias("name")).where("owner != ''")
    return named.join(owners.select("owner").distinct(), "owner", "left_semi")


def description_error(kind: Column, directive: Column, arguments: Column) -> Column:
    """Why a node of a content can't be evaluated, null if it can: unknown_kind, unknown_directive, or an error of its arguments."""
    call = structure.arguments(F.coalesce(arguments, F.lit(""))).getField("error")
    return F.when(~kind.isin("text", "standard_call"), "unknown_kind").when((kind == "standard_call") & ~F.coalesce(directive.isin("include", "link"), F.lit(False)), "unknown_directive").when(kind == "standard_call", call)
