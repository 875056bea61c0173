"""Queries over specifications, documentation trees and delegated contents, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import clauses, delegation, lint
from quillon.plans.queries import query

_CLAUSE = "'SPEC-' || upper(lang) || '-' || lpad(({0} % 1000)::VARCHAR, 3, '0')"
_SPECS = f"""d AS (SELECT *, head || '## ' || clause || chr(10) || chr(10) || text || chr(10) || chr(10) || 'See ' || other || '.' || chr(10) AS front FROM (
 SELECT doc_id, text, source, lang, source || '/d ' || doc_id || '.md' AS path, {_CLAUSE.format("doc_id")} AS clause, {_CLAUSE.format("(doc_id * 7)")} AS other,
  doc_id % 3 <> 0 AS good, CASE WHEN doc_id % 3 <> 0 THEN '<a id="' || lower({_CLAUSE.format("doc_id")}) || '"></a>' || chr(10) ELSE '' END AS head,
  lower({_CLAUSE.format("(doc_id + 1)")}) AS anchor FROM documents))"""


def _specs(read) -> DataFrame:
    """Documents as specifications: a clause each, two of three with its anchor, a mention of another, a link to the next."""
    named = lambda n: F.concat(F.lit("SPEC-"), F.upper("lang"), F.lit("-"), F.lpad((n % 1000).cast("string"), 3, "0"))
    n = F.col("doc_id")
    head = F.when(n % 3 != 0, F.concat(F.lit('<a id="'), F.lower(named(n)), F.lit('"></a>\n'))).otherwise("")
    link = F.concat(F.lit("[next](../"), "source", F.lit("/d%20"), (n + 1).cast("string"), F.lit(".md#"), F.lower(named(n + 1)), F.lit(")\n"))
    text = F.concat(head, F.lit("## "), named(n), F.lit("\n\n"), "text", F.lit("\n\nSee "), named(n * 7), F.lit(".\n"), link)
    return read("documents").select(F.concat("source", F.lit("/d "), n.cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


@query(rf"""WITH {_SPECS}, f AS (SELECT clause, min(path) AS path FROM d GROUP BY 1), l AS (
 SELECT d.path, d.front, d.anchor, '../' || d.source || '/d%20' || (d.doc_id + 1) || '.md#' || d.anchor AS target, n.path AS there, n.good AND lower(n.clause) = d.anchor AS anchored FROM d LEFT JOIN d n ON n.source = d.source AND n.doc_id = d.doc_id + 1)
SELECT d.path, NULL::INT AS line_no, 'duplicate_definition' AS code, clause AS subject FROM d JOIN f USING (clause) WHERE d.path <> f.path
UNION ALL SELECT path, NULL, 'definition_anchor', clause FROM d WHERE NOT good
UNION ALL SELECT path, NULL, 'undefined_clause', other FROM d WHERE other NOT IN (SELECT clause FROM d)
UNION ALL SELECT path, (1 + length(front) - length(replace(front, chr(10), '')))::INT, CASE WHEN there IS NULL THEN 'broken_link' ELSE 'missing_anchor' END, target FROM l WHERE there IS NULL OR NOT anchored""")
def document_lint(read):
    return lint.findings(_specs(read))


@query(rf"""WITH {_SPECS}, c AS (SELECT clause, count(*) AS n, bool_and(good) AS good, min(path) AS path FROM d GROUP BY 1)
SELECT doc_id, CASE WHEN n = 1 AND good THEN c.path END AS path, CASE WHEN asked IS NULL THEN 'invalid_arguments' WHEN n IS NULL THEN 'clause_not_found' WHEN n > 1 THEN 'clause_ambiguous' WHEN NOT good THEN 'clause_invalid_definition' END AS error
FROM (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN other END AS asked FROM d) LEFT JOIN c ON clause = asked""")
def clause_definitions(read):
    """Requests for clauses, some of them without a name, against the one valid definition that each must have."""
    n = F.col("doc_id")
    asked = F.when(n % 11 != 0, F.concat(F.lit("SPEC-"), F.upper("lang"), F.lit("-"), F.lpad(((n * 7) % 1000).cast("string"), 3, "0")))
    got = clauses.resolved(read("documents").select("doc_id", asked.alias("clause")), clauses.definitions(_specs(read)))
    return got.select("doc_id", "definition.path", "error")


_FRAMED = "octet_length(encode({0})) || ':' || {0}"


def _item_sql(*parts: str) -> str:
    return "sha256(" + " || ".join(f"coalesce({_FRAMED.format(p)}, '-')" for p in parts) + ")"


@query(f"""WITH l AS (SELECT l_partkey AS clause, 'o' || l_orderkey AS path, l_linenumber::VARCHAR AS name, l_returnflag AS f, l_linestatus AS s, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || l_suppkey END AS text FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)),
i AS (SELECT p_partkey AS clause, 'clause' AS kind, {_item_sql("'clause'", "p_partkey::VARCHAR", "p_name")} AS h FROM part
UNION ALL SELECT clause, 'site', {_item_sql("'site'", "path", "text")} FROM l WHERE f = 'R' AND text IS NOT NULL
UNION ALL SELECT clause, CASE WHEN text IS NULL THEN 'unresolved' ELSE 'test' END, {_item_sql("CASE WHEN text IS NULL THEN 'unresolved' ELSE 'test' END", "path", "name", "text")} FROM l WHERE f = 'A'
UNION ALL SELECT clause, 'row', {_item_sql("'row'", "name", "path")} FROM l WHERE f = 'N' AND s = 'F'),
n AS (SELECT clause, count(*) FILTER (kind = 'site') AS sites, count(*) FILTER (kind = 'test') AS tests, count(*) FILTER (kind = 'unresolved') AS unresolved, count(*) FILTER (kind = 'row') AS rows FROM i GROUP BY 1),
p AS (SELECT clause, left(h, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM i GROUP BY 1, 2)
SELECT clause, sites, tests, unresolved, rows, CASE WHEN sites = 0 THEN 'unsited' WHEN tests = 0 THEN 'untested' WHEN rows = 0 THEN 'unaccepted' ELSE 'complete' END AS state, fingerprint
FROM n JOIN (SELECT clause, sha256(string_agg(h, '' ORDER BY p)) AS fingerprint FROM p GROUP BY 1) USING (clause)""")
def clause_records(read):
    """Parts as clauses: returned lines are sites, accepted ones tests, others acceptance rows."""
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_returnflag", F.col("l_suppkey").cast("string")))
    lines = read("lineitem").select(F.col("l_partkey").alias("clause"), F.concat(F.lit("o"), "l_orderkey").alias("path"), F.col("l_linenumber").cast("string").alias("name"), "l_returnflag", "l_linestatus", text.alias("text"))
    rows = lines.where("l_returnflag = 'N' AND l_linestatus = 'F'").select("clause", F.col("name").alias("row_no"), F.col("path").alias("text"))
    parts = read("part").select(F.col("p_partkey").alias("clause"), F.col("p_name").alias("text"))
    return clauses.assembled(parts, lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), rows)


_NODES = """n AS (SELECT l_orderkey AS request, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS node, min(l_partkey) AS part, min_by(l_suppkey, l_partkey * 1000000 + l_suppkey) AS supp, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query(f"""WITH {_NODES}, x AS (SELECT request, node, CASE flag WHEN 'N' THEN 'part ' || part WHEN 'A' THEN CASE WHEN part % 2 = 0 THEN line || ends ELSE '```python' || chr(10) || line || chr(10) || '```' END WHEN 'R' THEN 's' || supp || '.md.md' END AS m,
 CASE WHEN flag = 'A' AND part % 7 = 0 THEN 'invalid_arguments' WHEN flag = 'A' AND doc_id IS NULL THEN 'source_error' WHEN flag = 'A' AND trim(line, ' ' || chr(9) || chr(13)) = '' THEN 'empty_selection' WHEN flag = 'R' AND supp % 5 = 0 THEN 'unknown_directive' WHEN flag = 'R' AND coalesce(s_acctbal, 0) <= 0 THEN 'page_not_selected' END AS error
 FROM (SELECT n.*, d.doc_id, s.s_acctbal, string_split(d.text, chr(10))[1] AS line, CASE WHEN contains(d.text, chr(10)) THEN chr(10) ELSE '' END AS ends FROM n LEFT JOIN documents d ON d.doc_id = n.part LEFT JOIN supplier s ON s.s_suppkey = n.supp))
SELECT request, CASE WHEN count(error) = 0 THEN string_agg(m, chr(10) || chr(10) ORDER BY node) END AS markdown, 'content[' || min(node) FILTER (error IS NOT NULL) || ']: ' || min_by(error, node) FILTER (error IS NOT NULL) AS error, count(*) AS nodes FROM x GROUP BY 1""")
def delegated_contents(read):
    """Orders as contents of a plugin: text, includes of a first line, fenced if it is code, links; some malformed or not the engine's."""
    return delegation.delegated(_contents(read), _suffixed(read), read("supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path")))


def _suffixed(read) -> DataFrame:
    n = F.col("doc_id")
    return read("documents").select(F.concat(F.lit("d"), n.cast("string"), F.when(n % 2 == 0, ".md").otherwise(".py")).alias("path"), "text")


def _contents(read) -> DataFrame:
    n = read("lineitem").groupBy(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("at")).agg(F.min("l_partkey").alias("part"), F.min(F.struct("l_partkey", "l_suppkey")).getField("l_suppkey").alias("supp"), F.min("l_returnflag").alias("flag"))
    part, supp, flag = F.col("part").cast("string"), F.col("supp").cast("string"), F.col("flag")
    path = F.when(flag == "A", F.concat(F.lit('"d'), part, F.when(F.col("part") % 2 == 0, ".md").otherwise(".py"), F.lit('"'), F.when(F.col("part") % 7 == 0, " lines=1").otherwise(" lines=[1, 1]"))).when(flag == "R", F.concat(F.lit('"s'), supp, F.lit('.md"')))
    directive = F.when(flag == "A", "include").when(flag == "R", F.when(F.col("supp") % 5 == 0, "audit").otherwise("link"))
    node = F.struct(F.when(flag == "N", "text").otherwise("standard_call").alias("kind"), F.when(flag == "N", F.concat(F.lit("part "), part)).alias("markdown"), directive.alias("directive"), path.alias("arguments"))
    each = n.select("request", "at", node.alias("node")).groupBy("request").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x.node)).alias("content"))
    return each.select("request", F.concat(F.lit("pages/p"), F.col("request").cast("string"), F.lit(".md")).alias("page"), "content")


@query(f"""WITH {_NODES} SELECT DISTINCT request, CASE flag WHEN 'A' THEN 'd' || part || CASE WHEN part % 2 = 0 THEN '.md' ELSE '.py' END ELSE 's' || supp || '.md' END AS path, CASE flag WHEN 'A' THEN 'source' ELSE 'page' END AS kind
FROM n WHERE (flag = 'A' AND part % 7 <> 0) OR (flag = 'R' AND supp % 5 <> 0)""")
def content_dependencies(read):
    return delegation.dependencies(_contents(read))


@query("""WITH d AS (SELECT doc_id, 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.py' END AS path, text FROM documents), m AS (SELECT max(text) AS text FROM d WHERE path = 'd2.md'), k AS (SELECT count(*) AS n FROM d WHERE path = 'd3.py'),
x AS (SELECT CASE WHEN m.text IS NULL THEN 'content[1]: source_error' WHEN trim(m.text) = '' THEN 'content[1]: empty_selection' WHEN k.n = 0 THEN 'content[2]: page_not_selected' END AS error, m.text AS text, k.n AS n FROM m, k)
SELECT 'result:' || doc_id AS request, CASE WHEN error IS NULL THEN 'Before' || chr(10) || chr(10) || x.text || chr(10) || chr(10) || '../d3.py.md' || chr(10) || chr(10) || 'After' END AS markdown, error, 4 AS nodes FROM d, x
UNION ALL SELECT 'append:d3.py', CASE WHEN n > 0 THEN 'd3.py.md' END, CASE WHEN n = 0 THEN 'content[0]: page_not_selected' END, 1 FROM k
UNION ALL SELECT 'report:overview', CASE WHEN n > 0 THEN '../../pages/d3.py.md' END, CASE WHEN n = 0 THEN 'content[0]: page_not_selected' END, 1 FROM k""")
def navigation_contents(read):
    """Every document's page asks for navigation; one URL for each place where it stands."""
    files = _suffixed(read)
    asked = read("documents").select(F.col("doc_id").alias("request"), F.concat(F.lit("pages/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("page"))
    return delegation.delegated(delegation.navigation(asked, "d2.md", "d3.py"), files, files.select("path"))
