"""Paths through links: chains closed by pointer doubling over a table of links, errors as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.structure import once
from quillon.operators.tables import written

#: Fixed value: links that one path may go through.
MOST_LINKS = 40
#: Doublings after which a chain that still goes on has more links than that.
DOUBLINGS = 6


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def _steps(done: Column, rest: Column) -> Column:
    """Where each part of ``rest`` leads from the folder ``done``: array of (path, out), out if above the root."""

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        at_root = acc.path == ""
        above = F.when(acc.path.contains("/"), F.regexp_replace(acc.path, "/[^/]*$", "")).otherwise(F.lit(""))
        path = F.when(up, above).when(at_root, part).otherwise(F.concat(acc.path, F.lit("/"), part))
        out = acc.out | (up & at_root)
        return F.struct(path.alias("path"), out.alias("out"), F.concat(acc.seen, F.array(F.struct(path.alias("path"), out.alias("out"), up.alias("up")))).alias("seen"))

    # Without ".." the parts lead straight down.
    above = F.when(done == "", F.lit("")).otherwise(F.concat(done, F.lit("/")))
    down = F.transform(rest, lambda _, i: F.struct(F.concat(above, F.array_join(F.slice(rest, 1, i + 1), "/")).alias("path"), F.lit(False).alias("out"), F.lit(False).alias("up")))
    start = F.struct(done.alias("path"), F.lit(False).alias("out"), F.array().cast("array<struct<path:string,out:boolean,up:boolean>>").alias("seen"))
    return F.when(F.array_contains(rest, ".."), F.aggregate(rest, start, step, lambda acc: acc.seen)).otherwise(down)


def _first_link(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Rows (key, done, rest) with the first link that their parts come to: ``link``, ``left`` (parts behind it), ``ended``, ``outside``.

    ``ended`` is the path that the parts lead to where there is no link, null otherwise.
    """
    seen = rows.withColumn("_seen", once(_steps(F.col("done"), F.col("rest"))))
    each = seen.select(F.col(key).alias("_key"), F.posexplode("_seen").alias("_at", "_s")).where("NOT _s.up AND NOT _s.out").select("_key", "_at", F.col("_s.path").alias("_p"))
    hit = each.join(links.select(F.col("link").alias("_link")), F.col("_p") == F.col("_link")).groupBy("_key").agg(F.min(F.struct("_at", "_link")).alias("_hit"))
    # Of what the parts lead to, only the end and the first place above the root go on with the row.
    end = F.when(F.size("_seen") > 0, F.element_at("_seen", -1).getField("path")).otherwise(F.col("done"))
    out_at = F.array_position(F.transform("_seen", lambda s: s.out), True)
    out = seen.withColumns({"_end": end, "_out": F.when(out_at > 0, out_at - 1)}).drop("_seen")
    out = out.join(hit, out[key] == hit["_key"], "left")
    at = F.col("_hit._at")
    left_the_root = F.col("_out").isNotNull() & (at.isNull() | (F.col("_out") <= at))
    return out.withColumns({
        "link": F.when(~left_the_root, F.col("_hit._link")), "left": F.when(at.isNotNull(), F.slice("rest", at + 2, F.size("rest"))),
        "ended": F.when(at.isNull() & ~left_the_root, F.col("_end")), "outside": left_the_root,
    }).drop("_end", "_out", "_key", "_hit")


def closed_links(entries: DataFrame) -> DataFrame:
    """For each link where its chain ends: link, base (a path without links so far, null if there is none), pending (parts still to be walked), chain (the links, in order), error.

    A link's target leads to another link, or to none. Each pointer is joined with the pointer of
    the link that it leads to, so a chain of n links takes log2(n) rounds; what is behind the
    inner link is walked after it, so parts are added up in that order. Ended chains aren't joined
    again. A chain that goes on
    after 2^DOUBLINGS links is a loop, or too long: ``link_loop``. A target that is absolute, or
    leads above the root: ``outside_root``.
    """
    links = entries.where("kind = 'link'").select(F.col("path").alias("link"), "target")
    links = written(links, "links")
    parent = F.when(F.col("link").contains("/"), F.regexp_replace("link", "/[^/]*$", "")).otherwise(F.lit(""))
    start = links.select(F.col("link").alias("of"), parent.alias("done"), _parts(F.col("target")).alias("rest"), F.col("target").startswith("/").alias("absolute"))
    first = _first_link(start, links, "of")
    error = F.when(F.col("absolute") | F.col("outside"), "outside_root")
    pointers = first.select(
        F.col("of"), F.when(error.isNull(), F.col("link")).alias("next"), F.col("ended").alias("base"), F.coalesce("left", F.array().cast("array<string>")).alias("pending"),
        F.array("of").alias("chain"), error.alias("error"),
    )
    # Chains that have ended are settled: only the others go on, and are written again.
    now = written(pointers, "pointers")
    spark, made = entries.sparkSession, [now._written_at]
    settled, going = now.where("next IS NULL"), now.where("next IS NOT NULL")
    for _ in range(DOUBLINGS):
        if not going.limit(1).count():
            break
        # What is next is always a link, so it has a pointer.
        ahead = settled.unionByName(going).select(*(F.col(c).alias(f"_{c}") for c in now.columns))
        met = going.join(ahead, F.col("next") == F.col("_of")).select(
            "of", F.col("_next").alias("next"), F.col("_base").alias("base"), F.concat("_pending", "pending").alias("pending"), F.concat("chain", "_chain").alias("chain"), F.col("_error").alias("error")
        )
        now = written(met, "pointers")
        made.append(now._written_at)
        settled, going = spark.read.schema(now.schema).parquet(*made).where("next IS NULL"), now.where("next IS NOT NULL")
    pointers = settled.unionByName(going)
    loop = F.col("next").isNotNull() | (F.size("chain") > MOST_LINKS)
    return pointers.select(F.col("of").alias("link"), "base", "pending", F.slice("chain", 1, MOST_LINKS + 1).alias("chain"), F.when(loop, "link_loop").otherwise(F.col("error")).alias("error"))


def resolve(queries: DataFrame, entries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``queries`` (path) with ``resolved``, ``links`` (those it goes through, in order), ``node``, ``missing``, ``error``.

    ``entries`` are the files, directories and links below the root: path, kind, target. A part
    is resolved before the next one is looked at, so ``..`` leaves the folder that a link leads to. At most
    ``MOST_LINKS`` links: ``link_loop`` beyond. A path, or a target on its way, that is absolute
    or leads above the root is ``outside_root``. ``node`` is the kind of what is there; where
    nothing is, ``missing`` says why: not_a_directory if a part before the last is a file, else
    not_found. Errors have no resolved path. A null path has all null; repeated rows stay. ``keep``
    are columns of the entry that is there, if nothing is missing.

    A round walks to the first link, by equality of the path's beginnings with links, and jumps to
    the end of that link's closed chain. So there are as many rounds as links that aren't part of
    one another's chains, most often one or two.
    """
    closed = written(closed_links(entries), "closed")
    links = closed.select("link")
    rows = queries.withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "asked")
    absolute = F.col("path").startswith("/")
    todo = rows.where("path IS NOT NULL").select(
        "_row", F.lit("").alias("done"), F.when(absolute, F.array().cast("array<string>")).otherwise(_parts(F.col("path"))).alias("rest"), F.array().cast("array<string>").alias("chain"), F.when(absolute, "outside_root").alias("error")
    )
    ends: list[DataFrame] = []
    while True:
        at = _first_link(todo, links, "_row")
        c = closed.select(*(F.col(x).alias(f"_{x}") for x in closed.columns))
        at = written(at.join(c, F.col("link") == F.col("_link"), "left"), "walked")
        chain = F.concat("chain", F.coalesce("_chain", F.array().cast("array<string>")))
        error = F.coalesce(F.col("error"), F.when(F.col("outside"), "outside_root"), F.col("_error"), F.when(F.size(chain) > MOST_LINKS, "link_loop"))
        on = F.col("link").isNotNull() & error.isNull()
        ends.append(at.where(~on).select("_row", F.when(error.isNull(), F.col("ended")).alias("resolved"), F.slice(chain, 1, MOST_LINKS).alias("links"), error.alias("error")))
        todo = at.where(on).select("_row", F.col("_base").alias("done"), F.concat("_pending", "left").alias("rest"), chain.alias("chain"), "error")
        if not todo.limit(1).count():
            break
    found = ends[0]
    for e in ends[1:]:
        found = found.unionByName(e)
    # The first part that isn't a folder, if it isn't the last one or isn't there.
    top = F.array(F.struct(F.lit("").alias("path"), F.lit(False).alias("out"), F.lit(False).alias("up")))
    walked = found.select("_row", once(F.when(F.col("resolved") == "", top).otherwise(_steps(F.lit(""), _parts(F.col("resolved"))))).alias("_all"))
    each = walked.select(F.col("_row").alias("_r"), F.size("_all").alias("_n"), F.posexplode("_all").alias("_at", "_s")).select("_r", "_n", "_at", F.col("_s.path").alias("_p"))
    kinds = entries.select(F.col("path").alias("_path"), F.col("kind").alias("_kind"), *(F.col(c).alias(f"_of_{c}") for c in keep))
    each = each.join(kinds, F.col("_p") == F.col("_path"), "left")
    bad = F.when((F.col("_p") != "") & F.col("_kind").isNull(), "not_found").when((F.col("_at") < F.col("_n") - 1) & (F.col("_kind") != "directory"), "not_a_directory")
    last = F.when((F.col("_at") == F.col("_n") - 1) & F.col("_path").isNotNull(), F.struct(F.col("_kind").alias("kind"), *(F.col(f"_of_{c}").alias(c) for c in keep)))
    seen = each.groupBy("_r").agg(F.min(F.when(bad.isNotNull(), F.struct("_at", bad.alias("why")))).alias("_bad"), F.max(last).alias("_there"))
    found = found.join(seen, found["_row"] == seen["_r"], "left")
    root = F.when(F.col("resolved") == "", F.lit("directory"))
    there = F.when(F.col("_bad").isNull(), F.col("_there"))
    found = found.select(F.col("_row").alias("_of"), "resolved", "links", F.coalesce(root, there["kind"]).alias("node"), F.col("_bad.why").alias("missing"), "error", *(there[c].alias(f"_of_{c}") for c in keep))
    return rows.join(found, rows["_row"] == found["_of"], "left").select(*queries.columns, "resolved", "links", "node", "missing", "error", *(F.col(f"_of_{c}").alias(c) for c in keep))


def facts(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Facts about paths: the columns of ``resolve``, and ``identity``, ``n_bytes``, ``sha256``.

    ``queries`` have path and ``ask``: metadata (no hash), file (the hash), unlinked_file (the
    hash unless the path goes through a link), directory (its own identity; its entries are
    ``members``). ``entries`` have identity, n_bytes and sha256, such as ``fingerprints`` gives.
    """
    found = resolve(queries, entries, ("identity", "n_bytes", "sha256"))
    wanted = (F.col("ask") == "file") | ((F.col("ask") == "unlinked_file") & (F.size("links") == 0))
    return found.withColumn("sha256", F.when(wanted & (F.col("node") == "file"), F.col("sha256")))


def members(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of the directories that ``queries`` (path, recursive) lead to: the queries' columns, resolved, member, member_kind.

    One row for each entry, at any depth with ``recursive``; links among them aren't followed.
    Folders above an entry meet the asked ones by equality, one row for each level. What asks for
    the root meets all entries where they are: as a level they would meet in one task.
    """
    found = resolve(queries, entries.select("path", "kind", "target")).where("node = 'directory'")
    parts = F.split("path", "/")
    depth = F.size(parts)
    up = F.when(depth > 1, F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("folder"), (i == depth - 1).alias("own"))))
    listed = entries.where("path != ''")
    each = listed.select(F.col("path").alias("member"), F.col("kind").alias("member_kind"), F.explode(up).alias("_u"))
    below = found.where("resolved != ''").join(each, (F.col("resolved") == F.col("_u.folder")) & (F.col("recursive") | F.col("_u.own")))
    every = listed.select(F.col("path").alias("member"), F.col("kind").alias("member_kind"), (depth == 1).alias("_own"))
    top = every.join(F.broadcast(found.where("resolved = ''")), F.col("recursive") | F.col("_own"))
    columns = [*queries.columns, "resolved", "member", "member_kind"]
    return below.select(*columns).unionByName(top.select(*columns))
