"""Queries over trees of files and their links, each beside its SQL."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import maps
from quillon.operators import plugins, project_docs, regions, rounds, search, structure
from quillon.operators.records import positions
from quillon.operators.tables import scratch
from quillon.plans.queries import query
from quillon.sources import facts, resolver
from quillon.sources.buckets import Buckets, canonical_json
from quillon.streaming import supervise

# Customers are folders and orders are in them: status F is a file, O links to the customer's order
# before (the first one to the next customer's folder), P to the one after (the last one to above the root).

_TREE = """e AS (
 SELECT 'c' || c_custkey AS path, 'directory' AS kind, NULL::VARCHAR AS target, 'c' || c_custkey AS identity, NULL::VARCHAR AS sha256 FROM customer UNION ALL
 SELECT 'c' || o_custkey || '/o' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'file' ELSE 'link' END,
  CASE o_orderstatus WHEN 'O' THEN CASE WHEN before IS NULL THEN '../c' || (o_custkey + 1) ELSE 'o' || before END WHEN 'P' THEN CASE WHEN after IS NULL THEN '../../x' ELSE './o' || after END END,
  'o' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN sha256(o_orderkey::VARCHAR) END
 FROM (SELECT *, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
), q AS (
 SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'file' WHEN 'O' THEN 'unlinked_file' ELSE 'metadata' END AS ask, 'c' || o_custkey || '/./o' || o_orderkey ||
  CASE o_orderpriority WHEN '1-URGENT' THEN '/n' WHEN '2-HIGH' THEN '/..' WHEN '3-MEDIUM' THEN '/../o' || o_orderkey ELSE '' END AS path FROM orders)"""


def _tree(read) -> DataFrame:
    o = read("orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before, after = F.lag("o_orderkey").over(w), F.lead("o_orderkey").over(w)
    first = F.concat(F.lit("../c"), F.col("o_custkey") + 1)
    target = F.when(F.col("o_orderstatus") == "O", F.coalesce(F.concat(F.lit("o"), before), first)).when(F.col("o_orderstatus") == "P", F.coalesce(F.concat(F.lit("./o"), after), F.lit("../../x")))
    kind = F.when(F.col("o_orderstatus") == "F", "file").otherwise("link")
    sha = F.when(F.col("o_orderstatus") == "F", F.sha2(F.col("o_orderkey").cast("string"), 256))
    rows = o.select(F.concat(F.lit("c"), "o_custkey", F.lit("/o"), "o_orderkey").alias("path"), kind.alias("kind"), target.alias("target"), F.concat(F.lit("o"), "o_orderkey").alias("identity"), sha.alias("sha256"))
    own = F.concat(F.lit("c"), "c_custkey")
    none = F.lit(None).cast("string")
    folders = read("customer").select(own.alias("path"), F.lit("directory").alias("kind"), none.alias("target"), own.alias("identity"), none.alias("sha256"))
    return folders.unionByName(rows).withColumn("n_bytes", F.length("path").cast("long"))


def _asked(read) -> DataFrame:
    behind = F.when(F.col("o_orderpriority") == "1-URGENT", "/n").when(F.col("o_orderpriority") == "2-HIGH", "/..").when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("/../o"), "o_orderkey")).otherwise("")
    ask = F.when(F.col("o_orderstatus") == "F", "file").when(F.col("o_orderstatus") == "O", "unlinked_file").otherwise("metadata")
    return read("orders").select("o_orderkey", ask.alias("ask"), F.concat(F.lit("c"), "o_custkey", F.lit("/./o"), "o_orderkey", behind).alias("path"))


_PARTS = "list_filter(string_split({0}, '/'), lambda x: x NOT IN ('', '.'))"
#: Part by part, as a file system does it.
_WALKED = f"""{_TREE}, w AS (
 SELECT o_orderkey, ask, path, '' AS done, {_PARTS.format("path")} AS rest, 0 AS n, ''::VARCHAR AS links, NULL::VARCHAR AS error FROM q
 UNION ALL
 SELECT o_orderkey, ask, path, CASE WHEN part = '..' THEN CASE WHEN contains(done, '/') THEN regexp_replace(done, '/[^/]*$', '') ELSE '' END WHEN link THEN done ELSE next END,
  CASE WHEN link THEN list_concat({_PARTS.format("target")}, rest[2:]) ELSE rest[2:] END, n + link::INT, CASE WHEN link AND n < 40 THEN links || ',' || next ELSE links END,
  CASE WHEN part = '..' AND done = '' THEN 'outside_root' WHEN link AND n >= 40 THEN 'link_loop' END
 FROM (SELECT v.*, e.target, part <> '..' AND coalesce(e.kind = 'link', false) AS link FROM (SELECT *, rest[1] AS part, CASE WHEN done = '' THEN rest[1] ELSE done || '/' || rest[1] END AS next FROM w WHERE len(rest) > 0 AND error IS NULL) v LEFT JOIN e ON e.path = next)
), f AS (SELECT o_orderkey, ask, path, CASE WHEN error IS NULL THEN done END AS resolved, links[2:] AS links, error FROM w WHERE len(rest) = 0 OR error IS NOT NULL
), p AS (SELECT o_orderkey, i, len({_PARTS.format("resolved")}) AS n, array_to_string(({_PARTS.format("resolved")})[1:i], '/') AS place FROM f, generate_series(1, 9) AS g(i) WHERE resolved IS NOT NULL AND i <= len({_PARTS.format("resolved")})
), b AS (SELECT o_orderkey, min(CASE WHEN e.path IS NULL THEN i || 'not_found' WHEN i < n AND kind <> 'directory' THEN i || 'not_a_directory' END)[2:] AS missing, max(CASE WHEN i = n THEN kind END) AS last FROM p LEFT JOIN e ON e.path = place GROUP BY 1
), r AS (SELECT f.*, missing, CASE WHEN resolved = '' THEN 'directory' WHEN missing IS NULL THEN last END AS node FROM f LEFT JOIN b USING (o_orderkey))"""


@query(f"WITH RECURSIVE {_WALKED} SELECT o_orderkey, path, resolved, links, node, missing, error FROM r")
def path_resolution(read):
    got = resolver.resolve(_asked(read), _tree(read))
    return got.select("o_orderkey", "path", "resolved", F.array_join("links", ",").alias("links"), "node", "missing", "error")


@query(f"""WITH RECURSIVE {_WALKED} SELECT o_orderkey, ask, r.path, node, CASE WHEN missing IS NULL THEN e.identity END AS identity,
 CASE WHEN missing IS NULL AND node = 'file' AND (ask = 'file' OR ask = 'unlinked_file' AND links = '') THEN e.sha256 END AS sha256 FROM r LEFT JOIN e ON e.path = resolved""")
def path_facts(read):
    return resolver.facts(_asked(read), _tree(read)).select("o_orderkey", "ask", "path", "node", "identity", "sha256")


@query(f"""WITH {_TREE}, a AS (SELECT c_custkey, 'c' || c_custkey AS path, c_acctbal < 0 AS recursive FROM customer), x AS (SELECT *, c_acctbal FROM customer)
SELECT a.path, recursive, e.path AS member, e.kind AS member_kind FROM a JOIN e ON regexp_replace(e.path, '/[^/]*$', '') = a.path AND contains(e.path, '/')
UNION ALL SELECT '.', true, path, kind FROM e UNION ALL SELECT '', false, path, kind FROM e WHERE NOT contains(path, '/')""")
def directory_members(read):
    folders = read("customer").select(F.concat(F.lit("c"), "c_custkey").alias("path"), (F.col("c_acctbal") < 0).alias("recursive"))
    roots = folders.sparkSession.createDataFrame([(".", True), ("", False)], "path string, recursive boolean")
    return resolver.members(folders.unionByName(roots), _tree(read)).select("path", "recursive", "member", "member_kind")


@query("""WITH t AS (SELECT 'c' || o_custkey AS folder, o_orderkey, o_orderstatus = 'F' AS gone, c_acctbal < 0 AS touched, 'c' || o_custkey || '/o' || o_orderkey AS path FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT path, 'directory' AS kind, 'removed' AS state FROM t WHERE touched AND gone UNION ALL
SELECT DISTINCT path || '/l' || l_linenumber, 'file', 'removed' FROM lineitem JOIN t ON o_orderkey = l_orderkey WHERE touched AND gone UNION ALL
SELECT path, 'directory', 'present' FROM t WHERE touched AND NOT gone UNION ALL SELECT DISTINCT folder, 'directory', 'present' FROM t WHERE touched""")
def changed_entries(read):
    """Folders of customers with debts changed: their orders of status F aren't listed any more."""
    o = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumns({"folder": F.concat(F.lit("c"), "o_custkey"), "order": F.concat(F.lit("c"), "o_custkey", F.lit("/o"), "o_orderkey")})
    lines = read("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat("order", F.lit("/l"), "l_linenumber").alias("path"), F.col("order").alias("parent"), F.lit("file").alias("kind"))
    orders = o.select(F.col("order").alias("path"), F.col("folder").alias("parent"), F.lit("directory").alias("kind"))
    folders = o.select(F.col("folder").alias("path"), F.lit("").alias("parent"), F.lit("directory").alias("kind")).distinct()
    touched = o.where("c_acctbal < 0")
    batch = touched.select(F.col("folder").alias("path"), F.lit("").alias("parent"), F.lit("directory").alias("kind")).distinct().withColumn("touched", F.lit(True))
    left = touched.where("o_orderstatus != 'F'").select(F.col("order").alias("path"), F.col("folder").alias("parent"), F.lit("directory").alias("kind"), F.lit(False).alias("touched"))
    known = folders.unionByName(orders).unionByName(lines).withColumn("changed", F.lit(0).cast("long"))
    return facts.changed_entries(known, batch.unionByName(left).withColumn("changed", F.lit(1).cast("long"))).select("path", "kind", "state")


# --- texts and their maps ----------------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT doc_id, len(l) - 1 AS breaks, l, list_transform(range(len(l)), lambda i: strlen(array_to_string(l[1:i], chr(10))) + (i > 0)::INT) AS starts FROM p)
SELECT doc_id, r AS run_no, starts[r // 2 + 1] + CASE WHEN r % 2 = 1 THEN strlen(l[r // 2 + 1]) ELSE 0 END AS at, starts[r // 2 + 1] + strlen(l[r // 2 + 1]) + r % 2 AS "end", starts[r // 2 + 1] + r // 2 + CASE WHEN r % 2 = 1 THEN strlen(l[r // 2 + 1]) ELSE 0 END AS src, starts[r // 2 + 1] + r // 2 + strlen(l[r // 2 + 1]) + 2 * (r % 2) AS src_end
FROM (SELECT doc_id, unnest(range(2 * breaks + 1)) AS r, l, starts FROM n) WHERE r % 2 = 1 OR strlen(l[r // 2 + 1]) > 0""")
def lf_map(read):
    """Texts with CRLF ends as their LF view: a run for each line and one for each end."""
    d = read("documents").select("doc_id", maps.made(F.replace("text", F.lit("\n"), F.lit("\r\n")), "lf").alias("m"))
    runs = maps.exploded(d, "doc_id", "m")
    # Lines without characters have no run: a run's number counts them.
    ends = (F.col("src_end") - F.col("src") > F.col("end") - F.col("at")).cast("long")
    before = F.sum(ends).over(Window.partitionBy("doc_id").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("run_no", F.coalesce(before, F.lit(0)) * 2 + ends).select("doc_id", "run_no", "at", "end", "src", "src_end")


_TAGS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^<>]*>"


@query(rf"""WITH g AS (SELECT page_id, string_split_regex(html, '{_TAGS}') AS gaps, regexp_extract_all(html, '{_TAGS}') AS hits, html FROM (SELECT page_id, regexp_replace(html, '[&`*_~#\\\[\]]|\n\s*', '', 'g') AS html FROM pages)),
r AS (SELECT page_id, i, gaps[i] AS part, (list_sum(list_transform(gaps[1:i], lambda x: strlen(x))) - strlen(gaps[i]))::BIGINT AS place, coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: strlen(x))), 0)::BIGINT AS cut FROM (SELECT *, unnest(range(1, len(gaps) + 1)) AS i FROM g))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS run_no, place AS "at", place + strlen(part) AS "end", place + cut AS src, place + cut + strlen(part) AS src_end FROM r WHERE part <> ''""")
def visible_map(read):
    """What a reader sees of a page, by runs that lead back to its bytes."""
    html = F.regexp_replace("html", r"[&`*_~#\\\[\]]|\n\s*", "")
    d = read("pages").select("page_id", maps.made(html, "visible").alias("m"))
    return maps.exploded(d, "page_id", "m").withColumn("run_no", F.col("run_no").cast("long"))


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'open_html' WHEN 'signup' THEN 'open_fence' END AS error,
 CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 0 ELSE 2 END AS directives,
 CASE event_type WHEN 'click' THEN user_id::VARCHAR WHEN 'view' THEN '' WHEN 'purchase' THEN '' WHEN 'signup' THEN '' ELSE user_id || ',' || event_id END AS arguments FROM events""")
def literal_regions(read):
    """Directives in code spans, raw HTML and fences are text; what nothing closes is an error."""
    a, b = F.concat(F.lit("{% x "), "user_id", F.lit(" %}")), F.concat(F.lit("{% y "), "event_id", F.lit(" %}"))
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("see "), a, F.lit(" not `"), b, F.lit("`\n")))
        .when(kind == "view", F.concat(F.lit("<div>\n"), a, F.lit(' <i title="'), b, F.lit('">\n</div>\n')))
        .when(kind == "purchase", F.concat(F.lit("<!-- "), a, F.lit("\n\n"), b))
        .when(kind == "signup", F.concat(F.lit("```text\n"), a, F.lit("\n``\n"), b))
        .otherwise(F.concat(F.lit("<script>"), b, F.lit("</script>\n"), a, F.lit("\n\n"), b, F.lit("\n")))
    )
    files = read("events").select("event_id", text.alias("text"))
    found = structure.directives(files, "event_id").groupBy(F.col("event_id").alias("_id")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("request_no", "arguments"))), lambda x: x.arguments), ",").alias("a"))
    rows = files.select("event_id", regions.open_region(F.col("text")).alias("error")).join(found, F.col("event_id") == F.col("_id"), "left")
    return rows.select("event_id", "error", F.coalesce("n", F.lit(0)).alias("directives"), F.coalesce("a", F.lit("")).alias("arguments"))


# --- tables in buckets -------------------------------------------------------------------------------


def _two_snapshots(read) -> Buckets:
    """Documents, and documents after a round: texts of low quality are marked, toxic ones gone, those of the benchmark new."""
    d = read("documents").select("doc_id", "text")
    kept = Buckets(d.sparkSession, scratch(d.sparkSession, "buckets"), "doc_id")
    kept.write(d, "before", per_bucket=100)
    labels = read("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = d.join(labels.where("toxic = 0 AND quality = 0").select("doc_id"), "doc_id", "left_semi").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("!")))
    new = read("benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    kept.apply(marked.unionByName(new), labels.where("toxic = 1").select("doc_id"), "after", per_bucket=100)
    return kept


_LABELLED = "l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1)"


@query(f"""WITH {_LABELLED} SELECT doc_id, CASE WHEN toxic = 1 THEN 'removed' ELSE 'changed' END AS state FROM documents JOIN l USING (doc_id) WHERE toxic = 1 OR quality = 0
UNION ALL SELECT -1 - item_id, 'added' FROM benchmark""")
def snapshot_differences(read):
    return _two_snapshots(read).differences("before", "after", ["text"])


@query(f"""WITH {_LABELLED}, r AS (SELECT doc_id, CASE WHEN quality = 0 THEN coalesce(text, '') || '!' ELSE text END AS text FROM documents LEFT JOIN l USING (doc_id) WHERE coalesce(toxic, 0) = 0 UNION ALL SELECT -1 - item_id, text FROM benchmark)
SELECT doc_id, sha256(text) AS sha256, 0::BIGINT AS violations FROM r""")
def verified_snapshot(read):
    """The rows of the later snapshot, and the number of violations that loading it finds."""
    kept = _two_snapshots(read)
    return kept.read("after").select("doc_id", F.sha2("text", 256).alias("sha256"), F.lit(kept.violations("after").count()).alias("violations"))


@query("""SELECT '{"doc_id":' || doc_id || ',"lang":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"n":null,"source":' || coalesce(to_json(source)::VARCHAR, 'null') || '}' AS json FROM documents""")
def canonical_rows(read):
    d = read("documents").select("source", "doc_id", F.lit(None).cast("int").alias("n"), "lang")
    return d.select(canonical_json(d.columns).alias("json"))


# --- plugins, fragments, drains ----------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, source, coalesce(lang, 'none') AS lang, source || '/' || coalesce(lang, 'none') AS project, text FROM documents), l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1)
SELECT project, doc_id AS request_no, 0 AS part, 'text' AS kind, 'Doc ' || doc_id || ': ` ' || source || ' `, version ` ' || lang || ' `.' || chr(10) AS markdown, NULL::VARCHAR AS error, 'Cargo.toml' AS path FROM d JOIN l USING (doc_id) WHERE toxic = 0
UNION ALL SELECT project, doc_id, part, CASE part WHEN 1 THEN 'standard_call' ELSE 'text' END, CASE part WHEN 0 THEN '## API ` d' || doc_id || ' `' || chr(10) || chr(10) || 'The model defines this interface.'
 WHEN 1 THEN '{"positional":["src/model.rs"],"named":{"id":["d' || doc_id || '"]}}' ELSE 'The source above keeps its bytes and its place.' END, NULL, NULL FROM d JOIN l USING (doc_id), (VALUES (0), (1), (2)) AS v(part) WHERE toxic = 1
UNION ALL SELECT project, r, row_number() OVER (PARTITION BY project ORDER BY path) - 1, 'text', '- ` ' || path || ' `: ' || (length(text) - length(replace(text, chr(10), '')) + (text <> '' AND NOT ends_with(text, chr(10)))::INT) || ' source lines.' || chr(10), NULL, path
 FROM (SELECT project, 'src/d' || doc_id || '.rs' AS path, coalesce(text, '') AS text, min(-1 - doc_id) OVER (PARTITION BY project) AS r FROM d)""")
def project_documentation(read):
    """Each source and language as a project, its documents as modules; labelled documents ask for the package or an interface."""
    d = read("documents").select("doc_id", "source", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).withColumn("project", F.concat_ws("/", "source", "lang"))
    labels = read("labels").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("toxic").alias("toxic"))
    manifest = F.concat(F.lit('[package]\nname = "'), "source", F.lit('"\nversion = "'), "lang", F.lit('"\n'))
    files = d.select("project", F.concat(F.lit("src/d"), "doc_id", F.lit(".rs")).alias("path"), "text").unionByName(d.select("project", F.lit("Cargo.toml").alias("path"), manifest.alias("text")).distinct())
    asked = d.join(labels, F.col("doc_id") == F.col("_doc")).select(
        "project", F.col("doc_id").alias("request_no"), F.when(F.col("toxic") == 1, "api").otherwise("package").alias("directive"),
        F.when(F.col("toxic") == 1, F.concat(F.lit('["d'), "doc_id", F.lit('"]'))).otherwise(F.concat(F.lit('["Doc '), "doc_id", F.lit('"]'))).alias("arguments"),
    )
    every = d.groupBy("project").agg(F.min(-1 - F.col("doc_id")).alias("request_no")).select("project", "request_no", F.lit("modules").alias("directive"), F.lit("[]").alias("arguments"))
    return project_docs.documented(asked.unionByName(every), files)


def _counted(inputs, requests):
    """A plugin for the whole round: how many inputs there are, and how many of them come before each request's."""
    paths = [r["path"] for batch in inputs for r in batch]
    asked = 0
    for batch in requests:
        asked += len(batch)
        said = [f"{bisect.bisect_left(paths, r['path'])} of {len(paths)}" for r in batch]
        yield pd.DataFrame({"request_no": [r["request_no"] for r in batch], "markdown": said, "error": None})
    if not asked:
        yield pd.DataFrame({"request_no": [-1], "markdown": [f"{len(paths)} inputs"], "error": [None]})


@query("""WITH i AS (SELECT DISTINCT 'p' || page_id AS path FROM pages), c AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS k, count(*) OVER () AS n FROM i)
SELECT turn * 1000000 + conv_id AS request_no, 'whole' AS owner, k || ' of ' || n AS markdown, NULL::VARCHAR AS error FROM conversations JOIN c ON path = 'p' || (SELECT min(page_id) FROM pages)
UNION ALL SELECT -1, 'idle', (SELECT count(*) FROM i) || ' inputs', NULL""")
def whole_round_plugins(read):
    registry = plugins.Registry()
    registry.add("whole", ["w"], _counted, contract="whole")
    registry.add("idle", ["i"], _counted, contract="whole")
    inputs = read("pages").select(F.concat(F.lit("p"), "page_id").alias("path")).distinct()
    first = read("pages").agg(F.concat(F.lit("p"), F.min("page_id")).alias("path"))
    asked = read("conversations").select((F.col("turn") * 1000000 + F.col("conv_id")).alias("request_no"), F.lit("whole").alias("owner"), F.lit("w").alias("name"), F.lit("").alias("arguments"), F.lit(1).alias("_one"))
    asked = asked.join(F.broadcast(first.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return plugins.run_plugins(asked, registry, inputs=inputs)


@query("""WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1), d AS (SELECT documents.*, toxic, quality, strlen(text) AS size, 1 + length(text) - length(replace(text, chr(10), '')) - ends_with(text, chr(10))::INT AS lines FROM documents LEFT JOIN l USING (doc_id))
SELECT doc_id AS fragment, CASE WHEN quality = 0 THEN 'open_html' WHEN toxic IS NULL AND lang = 'de' THEN 'sources[1]: wrong_lines' WHEN toxic = 1 THEN 'sources[1]: invalid_range' WHEN lang = 'fr' THEN 'sources[2]: source_error' END AS error FROM d""")
def fragment_spans(read):
    """Fragments whose first source is sound; others, further on, are not, by labels and languages."""
    labels = read("labels").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    d = read("documents").join(labels, F.col("doc_id") == F.col("_doc"), "left")
    size, lines = F.octet_length("text"), F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1 - F.col("text").endswith("\n").cast("int")
    span = lambda path, end, last: F.struct(path.alias("path"), F.lit(0).alias("start_byte"), end.alias("end_byte"), F.lit(1).alias("start_line"), last.alias("end_line"))
    own = F.col("doc_id").cast("string")
    wrong = F.when(F.col("toxic").isNull() & (F.col("lang") == "de"), lines + 1).otherwise(lines)
    last = F.when(F.col("lang") == "fr", F.concat(F.lit("no"), own)).otherwise(own)
    sources = F.array(span(own, size, lines), span(own, F.when(F.col("toxic") == 1, size + 1).otherwise(size), wrong), span(last, size, lines))
    text = F.when(F.col("quality") == 0, F.lit("a\n\n<!-- b\n")).otherwise(F.lit("a\n\n<!-- b -->\n"))
    fragments = d.select(F.col("doc_id").alias("fragment"), text.alias("markdown"), F.lit(True).alias("required"), F.lit(False).alias("layout"), sources.alias("sources"))
    return rounds.fragments_checked(fragments, d.select(own.alias("path"), "text")).select("fragment", "error")


@query("""WITH g AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, length(text) > 200 AS marker FROM conversations), o AS (SELECT * FROM g WHERE NOT marker)
SELECT conv_id, position, position - coalesce(lag(position) OVER w, -1) - 1 AS markers_before, coalesce(lead(position) OVER w, (SELECT max(position) FROM g x WHERE x.conv_id = o.conv_id) + 1) - position - 1 AS markers_after FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY position)""")
def adjacent_markers(read):
    rows = positions(read("conversations"), "conv_id", "turn")
    return search.marker_runs(rows.select("conv_id", "position", "text"), "conv_id", "position", F.length("text") > 200).select("conv_id", "position", "markers_before", "markers_after")


@query("""SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) - 1 AS number FROM events WHERE value >= 1 AND user_id > 5""")
def drained_calls(read):
    """Events as occurrences of their type on their user's page; those of small value have no call site."""
    e = read("events").withColumn("site", F.when(F.col("value") >= 1, F.col("value")))
    return search.calls_drained(e, "event_type", "user_id", "event_id", F.col("user_id") > 5, "site").select("event_id", "number")


@query(f"""WITH RECURSIVE {_TREE}, f AS (SELECT regexp_replace(path, '/.*$', '') AS folder, target[4:] AS next FROM e WHERE kind = 'link' AND starts_with(target, '../c')),
s AS (SELECT DISTINCT 'c' || c_custkey AS folder FROM customer WHERE c_acctbal < 0), r AS (SELECT folder, 0 AS round FROM s UNION SELECT f.next, round + 1 FROM r JOIN f USING (folder) WHERE round < 400)
SELECT folder, min(round)::INT AS round FROM r GROUP BY 1""")
def subscription_rounds(read):
    """Folders of customers with debts, and those that links in them lead to, until nothing new appears."""
    links = _tree(read).where("kind = 'link' AND target LIKE '../c%'").select(F.regexp_replace("path", "/.*$", "").alias("_from"), F.substring("target", 4, 100).alias("_to"))
    start = read("customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("folder"))
    step = lambda now: now.join(links, F.col("folder") == F.col("_from")).select(F.col("_to").alias("folder"))
    return supervise.until_nothing_new(start, step, "folder")
