"""Queries over inputs, requests, publication and the answers of the search, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators import integrity, references, render, rounds, structure
from quillon.operators import records as rec
from quillon.operators import search as srch
from quillon.plans.queries import _LOW, _MD, _conversation_pages, query
from quillon.sources import files as src
from quillon.sources.snapshots import target_conflicts

# --- inputs ---------------------------------------------------------------------------------------

_EXT = "CASE lang WHEN 'en' THEN 'md' WHEN 'de' THEN 'py' WHEN 'fr' THEN 'txt' ELSE 'go' END"


def _paths(read) -> DataFrame:
    """Documents as files: folders by source and language, suffixes by language."""
    ext = F.when(F.col("lang") == "en", "md").when(F.col("lang") == "de", "py").when(F.col("lang") == "fr", "txt").otherwise("go")
    return read("documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), ext)).alias("path"), "text")


@query(f"""WITH p AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.' || {_EXT} AS path, {_EXT} AS ext, source, lang FROM documents)
SELECT path, max(error) AS error FROM (
 SELECT path, CASE WHEN ext = 'txt' THEN 'unsupported_file' END AS error FROM p JOIN labels USING (doc_id)
 UNION ALL SELECT path, NULL FROM p WHERE ext <> 'txt' AND source <> 'src3' AND NOT (source = 'src1' AND lang = 'de')) GROUP BY path""")
def input_selection(read):
    paths = _paths(read)
    explicit = paths.join(read("labels").select("doc_id"), "doc_id", "left_semi").select("path")
    return src.select_inputs(paths.select("path"), explicit, ("src3", "src1/de"))


@query("""SELECT doc_id AS path, sha256(unhex(left(h, 200))) AS sha256, CASE WHEN cut THEN 'invalid_utf8' END AS error, CASE WHEN cut THEN octet_length(encode(kept)) END AS error_byte,
 CASE WHEN cut THEN 1 + length(kept) - length(replace(kept, chr(10), '')) END AS error_line FROM (
 SELECT doc_id, h, substr(h, 201, 1) IN ('8', '9', 'A', 'B') AS cut, list_filter(list_transform(range(0, 101), lambda i: left(text, i)), lambda x: octet_length(encode(x)) <= 100)[-1] AS kept
 FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents))""")
def decoded_files(read):
    """The first hundred bytes of each text: where they end within a character, they are no UTF-8."""
    files = read("documents").select(F.col("doc_id").alias("path"), F.substring(F.encode("text", "UTF-8"), F.lit(1), F.lit(100)).alias("content"))
    got = src.decoded(files.withColumn("sha256", F.sha2("content", 256)))
    return got.select("path", "sha256", "error", F.col("error_byte").cast("long").alias("error_byte"), F.col("error_line").cast("long").alias("error_line"))


@query("""WITH t AS (SELECT DISTINCT 'c' || o_custkey || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '/' || o_orderpriority END AS path FROM orders), i AS (SELECT 'c' || c_custkey || '/5-LOW' AS path FROM customer)
SELECT path, 'input' AS reason FROM t SEMI JOIN i USING (path) UNION ALL
SELECT path, 'parent_of_target' FROM t WHERE path IN (SELECT split_part(path, '/', 1) FROM t WHERE contains(path, '/'))""")
def publication_targets(read):
    o = read("orders")
    targets = o.select(F.concat(F.lit("c"), "o_custkey", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("/"), "o_orderpriority"))).alias("path")).distinct()
    return target_conflicts(targets, read("customer").select(F.concat(F.lit("c"), "c_custkey", F.lit("/5-LOW")).alias("path")))


# --- requests and contents --------------------------------------------------------------------------


@query("SELECT o_orderkey, 'd' || row_number() OVER (ORDER BY o_custkey, o_orderkey) AS request_id FROM orders")
def request_numbers(read):
    return rec.occurrence_ids(read("orders"), "o_custkey", "o_orderkey", prefix="d", first=1, name="request_id").select("o_orderkey", "request_id")


_ARGS = """CASE event_type WHEN 'error' THEN 'user=' || user_id || ' user=1' WHEN 'click' THEN '"' || event_type || '" n=' || event_id || ' ids=[1, ' || user_id || ']'
 WHEN 'view' THEN '''it"s'' true -1.5e3' WHEN 'signup' THEN 'n=1 "late"' ELSE event_type END"""


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'duplicate_argument' WHEN 'signup' THEN 'positional_after_named' WHEN 'purchase' THEN 'invalid_arguments' END AS error,
 CASE event_type WHEN 'click' THEN '"click"' WHEN 'view' THEN '"it\\"s",true,-1.5e3' END AS positional,
 CASE WHEN event_type = 'click' THEN event_id::VARCHAR END AS n, CASE WHEN event_type = 'click' THEN '[1, ' || user_id || ']' END AS ids FROM events""")
def directive_arguments(read):
    text = F.expr(_ARGS.replace("'''it\"s'' true -1.5e3'", "\"'it\\\"s' true -1.5e3\""))
    rows = read("events").select("event_id", structure.once(structure.arguments(text)).alias("a"))
    return rows.select("event_id", "a.error", F.array_join("a.positional", ",").alias("positional"), F.element_at("a.named", F.lit("n")).alias("n"), F.element_at("a.named", F.lit("ids")).alias("ids"))


@query("""SELECT user_id, event_id, CASE WHEN o.k IS NULL THEN 'no_expansion' WHEN e.event_id IS NULL THEN 'no_call' END AS error FROM (SELECT user_id, event_id FROM events WHERE event_type = 'click') e
FULL JOIN (SELECT user_id, event_id, 1 AS k FROM events WHERE event_type IN ('click', 'view') AND value >= 1) o USING (user_id, event_id)""")
def expansions_at_calls(read):
    e = read("events").select("user_id", "event_id", "event_type", "value")
    calls, expansions = e.where("event_type = 'click'").select("user_id", "event_id"), e.where("event_type IN ('click', 'view') AND value >= 1").select("user_id", "event_id")
    return rounds.at_calls(calls, expansions, ("user_id", "event_id"))


@query("SELECT e.event_id, e.event_type, c.value AS request FROM events e LEFT JOIN (SELECT user_id, event_id, value FROM events WHERE event_type IN ('click', 'purchase')) c USING (user_id, event_id)")
def occurrence_calls(read):
    e = read("events")
    calls = e.where("event_type IN ('click', 'purchase')").select("user_id", "event_id", F.col("value").alias("request"))
    return rounds.with_calls(e.select("user_id", "event_id", "event_type"), calls, ("user_id", "event_id")).select("event_id", "event_type", "request")


@query("""WITH n AS (SELECT l_orderkey AS request, l_linenumber AS node, min(l_partkey) AS part, min_by(l_suppkey, l_partkey * 1000000 + l_suppkey) AS supp, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
x AS (SELECT request, node, CASE flag WHEN 'N' THEN 'part ' || part WHEN 'A' THEN string_split(d.text, chr(10))[1] || CASE WHEN contains(d.text, chr(10)) THEN chr(10) ELSE '' END WHEN 'R' THEN CASE WHEN s.s_acctbal > 0 THEN '../s' || supp || '.md' END END AS m,
 CASE WHEN flag = 'A' AND d.doc_id IS NULL THEN 'source_error' WHEN flag = 'A' AND trim(string_split(d.text, chr(10))[1], ' ' || chr(9) || chr(13)) = '' THEN 'empty_selection' WHEN flag = 'R' AND coalesce(s.s_acctbal, 0) <= 0 THEN 'page_not_selected' END AS error
 FROM n LEFT JOIN documents d ON d.doc_id = n.part LEFT JOIN supplier s ON s.s_suppkey = n.supp)
SELECT request, CASE WHEN count(error) = 0 THEN string_agg(m, chr(10) || chr(10) ORDER BY node) END AS markdown, 'content[' || min(node) FILTER (error IS NOT NULL) || ']: ' || min_by(error, node) FILTER (error IS NOT NULL) AS error, count(*) AS nodes FROM x GROUP BY 1""")
def content_evaluation(read):
    """An order's lines as the nodes of a content: text, an include of a document's first line, a link to a supplier's page."""
    n = read("lineitem").groupBy(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("node")).agg(F.min("l_partkey").alias("part"), F.min(F.struct("l_partkey", "l_suppkey")).getField("l_suppkey").alias("supp"), F.min("l_returnflag").alias("flag"))
    text = n.where("flag = 'N'").select("request", "node", F.concat(F.lit("part "), F.col("part").cast("string")).alias("markdown"), F.lit(None).cast("string").alias("error"))
    asked = n.where("flag = 'A'").select("request", "node", F.col("part").alias("path"), F.lit(1).alias("first"), F.lit(1).alias("last"))
    included = render.included(asked, read("documents").select(F.col("doc_id").alias("path"), "text")).select("request", "node", "markdown", "error")
    catalog = read("supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"))
    links = n.where("flag = 'R'").select("request", "node", F.concat(F.lit("s"), F.col("supp").cast("string"), F.lit(".md")).alias("target"))
    linked = references.linked(links, catalog).select("request", "node", F.when(F.col("error").isNull(), t.relative_url(F.col("target"), F.lit("pages/p.md"))).alias("markdown"), "error")
    return rounds.evaluated(text.unionByName(included).unionByName(linked))


@query(r"""SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '[^ \t\r\n]') THEN 'empty' WHEN role <> 'system' AND turn = 0 THEN 'no_sources' WHEN role = 'assistant' AND n % 2 = 1 THEN 'open_fence' END AS error
FROM (SELECT *, len(regexp_extract_all(text, '(?m)^ {0,3}```')) AS n FROM conversations)""")
def fragment_errors(read):
    c = read("conversations")
    error = rounds.fragment_error(F.col("text"), F.col("turn"), F.col("role") != "system", F.lit(False))
    return c.select("conv_id", "turn", error.alias("error"))


@query(f"""WITH c AS (SELECT {_MD} AS path, turn, role, text, turn % 3 + 1 AS level, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations)
SELECT path, CASE n WHEN 1 THEN NULL ELSE 'selection_ambiguous' END AS error, CASE n WHEN 1 THEN own || coalesce((SELECT string_agg(repeat('#', x.level::BIGINT) || ' ' || x.role || chr(10) || chr(10) || x.text || chr(10) || chr(10), '' ORDER BY x.turn) FROM c x WHERE x.path = s.path AND x.turn > s.turn
  AND x.turn < coalesce((SELECT min(y.turn) FROM c y WHERE y.path = s.path AND y.turn > s.turn AND y.level <= s.level), 1000000)), '') END AS markdown
FROM (SELECT *, repeat('#', level::BIGINT) || ' ' || role || chr(10) || chr(10) || text || chr(10) || chr(10) AS own FROM c) s WHERE role = 'system' AND k = 1""")
def include_by_title(read):
    """Each page's section with the title system, with all below it."""
    pages = _conversation_pages(read)
    return render.included_sections(pages.select("path", F.array(F.lit("system")).alias("title_path")), pages, structure.sections(pages), last_only=True).where("error IS NULL OR error != 'selection_not_found'").select("path", "error", "markdown")


@query("""SELECT l_orderkey, (CASE WHEN f = b THEN bs + greatest(fs, 2) - fs ELSE bs END)::BIGINT AS body_start, (CASE WHEN f2 = b2 THEN bs2 + least(fe2, 5) - fs2 ELSE be2 END)::BIGINT AS body_end FROM (
 SELECT l_orderkey, arg_min(fs, fs) AS fs, arg_min(fe - fs, fs) AS f, arg_min(be - bs, fs) AS b, arg_min(bs, fs) AS bs, arg_max(fs, fs) AS fs2, arg_max(fe, fs) AS fe2, arg_max(fe - fs, fs) AS f2, arg_max(be - bs, fs) AS b2, arg_max(bs, fs) AS bs2, arg_max(be, fs) AS be2
 FROM (SELECT l_orderkey, l_linenumber AS fs, l_linenumber + 1 AS fe, min(l_partkey) AS bs, min(l_partkey) + (min(l_partkey) % 2 + 1) AS be FROM lineitem GROUP BY 1, 2) WHERE greatest(fs, 2) < least(fe, 5) GROUP BY 1)""")
def field_to_body(read):
    """Field range [2, 5) of each order through runs of one line each; parts with odd keys map to two places."""
    runs = read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    run = F.struct(F.col("l_linenumber").cast("long").alias("field_start"), (F.col("l_linenumber") + 1).cast("long").alias("field_end"), F.col("p").alias("body_start"), (F.col("p") + F.col("p") % 2 + 1).alias("body_end"))
    rows = runs.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    rows = rows.withColumn("r", rec.raw_range(F.col("runs"), F.lit(2).cast("long"), F.lit(5).cast("long"))).where("r IS NOT NULL")
    return rows.select("l_orderkey", F.col("r.start").alias("body_start"), F.col("r.end").alias("body_end"))


@query("SELECT doc_id, length(replace(text, '. ', '.' || chr(10))) AS chars, length(replace(text, '. ', '.' || chr(13) || chr(10))) AS source_chars FROM documents")
def crlf_view(read):
    """Texts with CRLF ends seen with LF, and the source offset of the view's end."""
    crlf = F.replace("text", F.lit(". "), F.lit(".\r\n"))
    view = t.lf(crlf)
    return read("documents").select("doc_id", F.length(view).cast("long").alias("chars"), t.source_offset(crlf, F.length(view)).cast("long").alias("source_chars"))


# --- publication --------------------------------------------------------------------------------------


@query("SELECT DISTINCT o_custkey AS page FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def removed_pages(read):
    o = read("orders").select(F.col("o_custkey").alias("page"), "o_orderstatus")
    notes = read("events").select(F.lit("note").alias("severity"))
    return rounds.removed_pages(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), notes)


@query("SELECT owner, name, side FROM (SELECT c_mktsegment AS owner, c_nationkey AS name, 'left' AS side FROM customer EXCEPT SELECT CASE WHEN s_acctbal > 0 THEN 'BUILDING' ELSE 'MACHINERY' END, s_nationkey, 'left' FROM supplier) UNION ALL (SELECT CASE WHEN s_acctbal > 0 THEN 'BUILDING' ELSE 'MACHINERY' END, s_nationkey, 'right' FROM supplier EXCEPT SELECT c_mktsegment, c_nationkey, 'right' FROM customer)")
def report_set(read):
    asked = read("customer").select(F.struct(F.col("c_mktsegment").alias("owner"), F.col("c_nationkey").alias("name")).alias("report"))
    there = read("supplier").select(F.struct(F.when(F.col("s_acctbal") > 0, "BUILDING").otherwise("MACHINERY").alias("owner"), F.col("s_nationkey").alias("name")).alias("report"))
    return integrity.set_differences(asked, there, "report").select("report.owner", "report.name", "side")


def _digests(read) -> tuple[DataFrame, DataFrame]:
    index = read("documents").select(F.col("doc_id").alias("page"), F.sha2("text", 256).alias("sha256"))
    return index, read("benchmark").select(F.col("item_id").alias("page"), F.sha2("text", 256).alias("sha256"))


@query("SELECT doc_id AS page, CASE WHEN item_id IS NULL THEN 'missing' ELSE 'changed' END AS state FROM documents d LEFT JOIN benchmark b ON doc_id = item_id WHERE d.text IS DISTINCT FROM b.text")
def output_comparison(read):
    return rounds.output_differences(*_digests(read))


@query("SELECT DISTINCT a.user_id AS page, 'same' AS scope FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND floor(a.value) = floor(b.value)")
def adopted_pages(read):
    """With a scope that is the same, and with one that differs, in which nothing is adopted."""
    e = read("events").select(F.col("user_id").alias("page"), F.sha2(F.floor("value").cast("string"), 256).alias("sha256"), "event_type")
    keys = read("documents").select("doc_id")
    same, other = (integrity.set_differences(keys, x, "doc_id") for x in (keys, read("labels").select("doc_id")))
    found = [rounds.adopted(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), scope).withColumn("scope", F.lit(name)) for name, scope in (("same", same), ("other", other))]
    return found[0].unionByName(found[1])


@query("""SELECT user_id, count(*) FILTER (a = 0) AS added, count(*) FILTER (b = 0) AS removed FROM (SELECT user_id, floor(value)::BIGINT AS item, count(*) FILTER (dayofyear(ts) % 2 = 0) AS a, count(*) FILTER (dayofyear(ts) % 2 = 1) AS b FROM events GROUP BY 1, 2) GROUP BY 1
HAVING count(*) FILTER (a = 0) + count(*) FILTER (b = 0) > 0""")
def dependency_lists(read):
    e = read("events").select("user_id", F.floor("value").alias("item"), (F.dayofyear("ts") % 2).alias("day"))
    return rounds.list_differences(e.where("day = 0"), e.where("day = 1"), "user_id", "item")


@query("SELECT source || '/' || lang || '/' || doc_id AS path, n_chars > 1000 AS dependency, CASE WHEN (source = 'src2' OR (source = 'src4' AND lang = 'en')) AND n_chars > 1000 THEN 'cycle' END AS error FROM documents WHERE NOT (source = 'src2' OR (source = 'src4' AND lang = 'en')) OR n_chars > 1000")
def self_outputs(read):
    facts = read("documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), (F.col("n_chars") > 1000).alias("dependency"))
    return rounds.without_outputs(facts, ("src2", "src4/en"))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') GROUP BY 1, 2")
def unknown_repairs(read):
    known = read("orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"))
    return rounds.unknown_facts(read("events"), known, "user_id", "event_type")


@query("SELECT o_custkey AS folder, o_orderpriority AS entry FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def baseline_advance(read):
    o = read("orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderpriority").alias("entry"), "o_orderstatus")
    created = read("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("folder"))
    return rounds.advanced(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'"), created)


@query("SELECT event_type AS root, count(DISTINCT user_id) AS paths, count(DISTINCT user_id) > 90 AS everything FROM events GROUP BY 1")
def dirty_paths(read):
    return rounds.scans(read("events").select(F.col("event_type").alias("root"), F.col("user_id").alias("path")), most=90)


@query("""SELECT 'reports/customer/' || o_custkey || '.md' AS report, '# Report: `' || o_custkey || '`' || chr(10) || chr(10) || '> **Plugin**: `customer`' || string_agg('  ' || chr(10) || '> **Input**: `' || o_orderkey || '`', '' ORDER BY o_orderkey) || string_agg(chr(10) || chr(10) || o_orderpriority, '' ORDER BY o_orderkey) || chr(10) AS markdown FROM orders GROUP BY o_custkey""")
def report_pages(read):
    o = read("orders").select(F.lit("customer").alias("owner"), F.col("o_custkey").cast("string").alias("name"), "o_orderkey", "o_orderpriority")
    inputs = o.select("owner", "name", F.col("o_orderkey").alias("order"), F.col("o_orderkey").cast("string").alias("input"))
    fragments = o.select("owner", "name", F.col("o_orderkey").alias("order"), F.col("o_orderpriority").alias("markdown"))
    return render.reports(inputs, fragments)


# --- search -------------------------------------------------------------------------------------------

_HIT = r"CASE WHEN regexp_matches({low}, '(^|[^\p{{L}}\p{{N}}_]){term}($|[^\p{{L}}\p{{N}}_])') THEN length(regexp_extract({low}, '^((?s:.*?)(?:^|[^\p{{L}}\p{{N}}_])){term}(?:$|[^\p{{L}}\p{{N}}_])', 1)) END"


def _matches_sql() -> str:
    each = [
        f"""SELECT doc_id, '{term}' AS term, '{field}' AS field, {_HIT.format(low=_LOW.format(column), term=term)} AS "at" FROM documents"""
        for term in ("de", "src3", "the")
        for field, column in (("selector", "lang"), ("path", "source"), ("body", "text"))
    ]
    return f"""SELECT doc_id, term, field, "at", "at" + length(term) AS "end" FROM ({" UNION ALL ".join(each)}) WHERE "at" IS NOT NULL"""


@query(_matches_sql())
def search_matches(read):
    rows = srch.matched(read("documents"), {"selector": "lang", "path": "source", "body": "text"}, "the de src3")
    return rows.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.term", "m.field", F.col("m.start").cast("long").alias("at"), F.col("m.end").cast("long").alias("end"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'input,source' ELSE 'input' END AS reasons FROM documents WHERE source = 'src3'")
def path_reasons(read):
    """Records below src3: as an input always, by a source file in two languages."""
    d = read("documents").withColumns({"inputs": F.array(F.concat_ws("/", "source", "lang")), "sources": F.array(F.when(F.col("lang").isin("en", "de"), F.concat_ws("/", "source", F.lit("x"))).otherwise(F.lit("src30/y")), F.lit("other"))})
    rows = d.select("doc_id", rounds.under_reasons("src3", "inputs", "sources").alias("r")).where(F.size("r") > 0)
    return rows.select("doc_id", F.array_join("r", ",").alias("reasons"))


@query(f"""WITH o AS (SELECT l_partkey AS record, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) - 1 AS number, count(*) OVER (PARTITION BY l_partkey) AS total FROM lineitem)
SELECT record, l_orderkey, number::INT AS number, total, CASE WHEN total > 10 THEN 's:' || record || ':occurrences:10' END AS next_cursor FROM o WHERE number BETWEEN 5 AND 9""")
def occurrence_page(read):
    """The second page of each record's occurrences, with the cursor to go on from."""
    rows = read("lineitem").select(F.col("l_partkey").alias("record"), "l_orderkey", "l_linenumber", "l_suppkey")
    return srch.cursor_page(rows, "record", ["l_orderkey", "l_linenumber", "l_suppkey"], "s", "occurrences", 5).select("record", "l_orderkey", "number", "total", "next_cursor")


@query("""SELECT conv_id, turn, shown FROM (SELECT conv_id, turn, greatest(0, least(length(text), 1200 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn <> 1, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS shown FROM conversations)""")
def read_budget(read):
    """A record's body, here the second turn, has the budget first; its neighbours share what is left."""
    return srch.budgeted(read("conversations"), "conv_id", "turn", "text", 1200, own=F.col("turn") == 1).select("conv_id", "turn", "shown")


@query(r"""SELECT clause, page_id AS test, count(*) OVER (PARTITION BY page_id) AS together FROM (
 SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS clause FROM pages) WHERE clause IN (SELECT '/' || w FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM benchmark))""")
def clauses_of_tests(read):
    """Clauses that pages name, one row each, of those that are defined; with how many others they stand."""
    named = read("pages").select(F.col("page_id").alias("test"), F.regexp_extract_all("html", F.lit(r'href="(/[^"]*)"'), F.lit(1)).alias("clauses"))
    inventory = read("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w")).select(F.concat(F.lit("/"), "w").alias("clause"))
    return references.associated(named, inventory, "test", "clauses", "clause")


@query("""SELECT doc_id, part::INT AS part, substr(text, part * 500 + 1, 500) AS body, strlen(left(text, part * 500)) AS start_byte, CASE WHEN length(text) > (part + 1) * 500 THEN strlen(left(text, (part + 1) * 500)) END AS next_offset
FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil(length(text) / 500.0)::BIGINT))) AS part FROM documents)""")
def body_pages(read):
    return srch.drained(read("documents"), "doc_id", "text", 500)


_THE = _HIT.format(low=_LOW.format("text"), term="the")


@query(f"""SELECT doc_id, snippet FROM (SELECT doc_id, substr(text, greatest(0, least("at" - 80, length(text) - 240)) + 1, 240) AS snippet FROM (SELECT doc_id, text, {_THE} AS "at" FROM documents) WHERE "at" IS NOT NULL) WHERE starts_with(snippet, 'The ') ORDER BY doc_id LIMIT 1""")
def first_with_beginning(read):
    """Of all hits, the first whose snippet begins as asked."""
    rows = read("documents").withColumn("at", F.explode(F.array(t.first_hit(F.col("text"), "the")))).where("at IS NOT NULL")
    rows = rows.select("doc_id", t.snippet(F.col("text"), F.col("at")).alias("snippet"))
    return rows.where(F.col("snippet").startswith("The ")).orderBy("doc_id").limit(1)


@query("""SELECT DISTINCT l_orderkey, array_to_string(list_transform(list_sort(list_distinct(list({'p': l_partkey, 's': l_suppkey}) OVER (PARTITION BY l_orderkey))), lambda x: x.p || ':' || x.s), ',') AS sources FROM lineitem""")
def source_order(read):
    """Each order's sources, each once, by path and place."""
    rows = read("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct("l_partkey", "l_suppkey")).alias("x"))
    return rows.select("l_orderkey", F.array_join(F.transform(F.array_sort("x"), lambda x: F.concat_ws(":", x.l_partkey.cast("string"), x.l_suppkey.cast("string"))), ",").alias("sources"))


@query("SELECT DISTINCT o_custkey AS page FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def owned_pages(read):
    o = read("orders").select(F.col("o_custkey").alias("page"), "o_orderstatus", "o_orderpriority")
    return rounds.owned_after(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), o.where("o_orderpriority = '5-LOW'"))


@query("""SELECT folder, 'add' AS action, 0 AS step FROM (SELECT user_id || '/' || floor(value)::BIGINT AS folder FROM events WHERE event_type = 'click' EXCEPT SELECT user_id || '/' || floor(value)::BIGINT FROM events WHERE event_type = 'view')
UNION ALL SELECT folder, 'remove', 1 FROM (SELECT user_id || '/' || floor(value)::BIGINT AS folder FROM events WHERE event_type = 'view' EXCEPT SELECT user_id || '/' || floor(value)::BIGINT FROM events WHERE event_type = 'click')""")
def subscriptions(read):
    e = read("events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.floor("value").cast("string")).alias("folder"), "event_type")
    return rounds.subscriptions(e.where("event_type = 'click'"), e.where("event_type = 'view'"))


@query("""WITH a AS (SELECT 'inputs' AS component, doc_id::VARCHAR AS key, md5(text) AS value FROM documents UNION ALL SELECT 'settings', c_custkey::VARCHAR, c_nationkey::VARCHAR FROM customer),
b AS (SELECT 'inputs' AS component, item_id::VARCHAR AS key, md5(text) AS value FROM benchmark UNION ALL SELECT 'settings', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier)
SELECT coalesce(a.component, b.component) AS component, count(*) FILTER (a.value IS NULL OR b.value IS NULL OR a.value <> b.value) AS changed, count(*) AS facts FROM a FULL JOIN b ON a.component = b.component AND a.key = b.key GROUP BY 1""")
def freshness(read):
    facts = lambda table, key, value: read(table).select(F.col(key).alias("key"), value.alias("value"))
    before = rounds.sample(inputs=facts("documents", "doc_id", F.md5(F.col("text").cast("binary"))), settings=facts("customer", "c_custkey", F.col("c_nationkey")))
    now = rounds.sample(inputs=facts("benchmark", "item_id", F.md5(F.col("text").cast("binary"))), settings=facts("supplier", "s_suppkey", F.col("s_nationkey")))
    return rounds.freshness(before, now)


@query("SELECT 'reports/' || lower(c_mktsegment) || '/' || c_name || '.md' AS path, lower(c_mktsegment) AS owner, c_name AS name FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_nationkey = 0)")
def published_reports(read):
    c = read("customer").withColumn("owner", F.lower("c_mktsegment"))
    suffix = F.when(F.col("c_acctbal") > 0, ".md").otherwise(".txt")
    return rounds.published_reports(c.select(F.concat(F.lit("reports/"), "owner", F.lit("/"), "c_name", suffix).alias("path")), c.where("c_nationkey = 0").select("owner"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'unknown_kind' WHEN 'view' THEN 'unknown_directive' WHEN 'purchase' THEN CASE WHEN value >= 1 THEN 'duplicate_argument' END END AS error FROM events""")
def content_descriptions(read):
    kind = F.when(F.col("event_type") == "error", "markup").when(F.col("event_type") == "signup", "text").otherwise("standard_call")
    directive = F.when(F.col("event_type") == "view", "audit").otherwise("include")
    arguments = F.concat(F.lit('"p" lines=1'), F.when((F.col("event_type") == "purchase") & (F.col("value") >= 1), " lines=2").otherwise(""))
    return read("events").select("event_id", rounds.description_error(kind, directive, arguments).alias("error"))


@query("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"kind\":\"prose\",\"rank\":{\"term_count\":' || (1 + (source = 'src3')::INT) || ',\"exact\":true}}' AS line FROM documents WHERE lang = 'de'")
def result_lines(read):
    """Answers as they are printed: a JSON object a line."""
    d = read("documents").where("lang = 'de'")
    hit = F.struct("doc_id", F.lit("prose").alias("kind"), F.struct((F.col("source") == "src3").cast("int") + F.lit(1), F.lit(True)).cast("struct<term_count:int,exact:boolean>").alias("rank"))
    return d.select("doc_id", F.to_json(hit).alias("line"))
