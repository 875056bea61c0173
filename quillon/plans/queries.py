"""The engine's queries over the given tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import hashing
from quillon.functions import text as t
from quillon.operators import integrity, intervals, plugins, references, render, structure
from quillon.operators import records as rec
from quillon.operators import search as srch
from quillon.operators.quantiles import exact_quantiles
from quillon.operators.stretches import Stretches
from quillon.streaming.watch import strongest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (read) under its name; ``read(table)`` gives a table of the folder."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- search -----------------------------------------------------------------------------------

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PARTS = r"string_split_regex(" + _LOW.format(r"regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([^ ])([A-Z][a-z])', '\1 \2', 'g')") + r", '[^\p{{L}}\p{{N}}]+')"


def _match(column: str, term: str) -> str:
    low = _LOW.format(column)
    return rf"({low} = '{term}' OR list_contains(regexp_extract_all({low}, '[\p{{L}}\p{{N}}_]+'), '{term}') OR list_contains({_PARTS.format(column)}, '{term}'))"


def _scored_sql(table: str, key: str, columns: dict[str, str], text: str, terms: list[str]) -> str:
    weight = lambda term: "greatest(" + ", ".join(f"CASE WHEN {_match(c, term)} THEN {srch.WEIGHTS[f]} ELSE 0 END" for f, c in columns.items()) + ")"
    exact = " OR ".join(f"{_LOW.format(c)} = '{text}'" for f, c in columns.items() if f in srch.EXACT_FIELDS) or "false"
    weights = ", ".join(f"{weight(term)} AS w{i}" for i, term in enumerate(terms))
    count = " + ".join(f"(w{i} > 0)::INT" for i in range(len(terms)))
    score = " + ".join(f"w{i}" for i in range(len(terms)))
    return f"SELECT {key}, {count} AS term_count, exact, {score} AS score FROM (SELECT {key}, {exact} AS exact, {weights} FROM {table}) WHERE {score} > 0"


_COLUMNS = {"selector": "lang", "path": "source", "body": "text"}
_RANKED = _scored_sql("documents", "doc_id", _COLUMNS, "the de src3", ["de", "src3", "the"])


@query(f"SELECT * FROM ({_RANKED}) ORDER BY term_count DESC, exact DESC, score DESC, doc_id LIMIT 10")
def search_ranked(read):
    return srch.search(read("documents"), _COLUMNS, "the de src3", 10, ties=("doc_id",)).select("doc_id", "term_count", "exact", "score")


@query(f"SELECT term_count, exact, count(*) AS matches, sum(score)::BIGINT AS total_score FROM ({_RANKED}) GROUP BY term_count, exact")
def search_total(read):
    found = srch.scored(read("documents"), _COLUMNS, "the de src3")
    return found.groupBy("term_count", "exact").agg(F.count("*").alias("matches"), F.sum("score").alias("total_score"))


@query(f"SELECT * FROM ({_scored_sql('(SELECT * FROM documents WHERE source = ' + repr('src3') + ' OR starts_with(source, ' + repr('src3/') + '))', 'doc_id', _COLUMNS, 'de', ['de'])}) ORDER BY term_count DESC, exact DESC, score DESC, doc_id LIMIT 20")
def search_path_filter(read):
    return srch.search(read("documents"), _COLUMNS, "de", 20, path="src3", path_column="source", ties=("doc_id",)).select("doc_id", "term_count", "exact", "score")


@query(f"SELECT * FROM ({_scored_sql('customer', 'c_custkey', {'identifier': 'c_name', 'body': 'c_mktsegment'}, 'machinery customer', ['customer', 'machinery'])}) ORDER BY term_count DESC, exact DESC, score DESC, c_custkey LIMIT 50")
def search_identifier_parts(read):
    found = srch.search(read("customer"), {"identifier": "c_name", "body": "c_mktsegment"}, "machinery customer", 50, ties=("c_custkey",))
    return found.select("c_custkey", "term_count", "exact", "score")


@query("SELECT DISTINCT p_partkey, list_sort(list_distinct(list_filter(" + _PARTS.format("replace(replace(p_brand, '#', ' ') || ' ' || p_name, ' ', 'X_')") + ", lambda x: x <> ''))) AS parts FROM part")
def identifier_parts(read):
    name = F.replace(F.concat(F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(" "), "p_name"), F.lit(" "), F.lit("X_"))
    return read("part").select("p_partkey", F.array_sort(F.array_distinct(t.parts(name))).alias("parts"))


@query(r"""SELECT doc_id, pos AS "at", substr(text, greatest(0, least(pos - 80, length(text) - 240)) + 1, 240) AS snippet
FROM (SELECT *, length(regexp_extract(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^((?s:.*?)(?:^|[^\p{L}\p{N}_]))the(?:$|[^\p{L}\p{N}_])', 1)) AS pos FROM documents
 WHERE regexp_matches(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])'))""")
def search_snippet(read):
    rows = read("documents").withColumn("at", F.explode(F.array(t.first_hit(F.col("text"), "the")))).where("at IS NOT NULL")
    return rows.select("doc_id", F.col("at").cast("long").alias("at"), t.snippet(F.col("text"), F.col("at")).alias("snippet"))


@query(r"""SELECT doc_id, term, min_by(field, weight * -1) AS field, max(weight) AS weight FROM (
 SELECT doc_id, unnest([struct_pack(field := 'selector', weight := 8, value := lang), struct_pack(field := 'path', weight := 4, value := source)], recursive := true) FROM documents), (VALUES ('de'), ('src3')) v(term)
WHERE value = term GROUP BY doc_id, term""")
def first_match_per_field(read):
    rows = rec.fields(read("documents"), "doc_id", {"selector": ("lang", 8), "path": ("source", 4)})
    rows = rows.withColumn("term", F.explode(F.array(F.lit("de"), F.lit("src3")))).where(t.ascii_lower(F.col("value")) == F.col("term"))
    best = rows.groupBy("doc_id", "term").agg(F.max_by("field", "weight").alias("field"), F.max("weight").alias("weight"))
    return best.select("doc_id", "term", "field", "weight")


@query("""SELECT field, count(*) AS n, count(DISTINCT value) AS n_values FROM (
 SELECT DISTINCT doc_id, 'body' AS field, text AS value FROM documents UNION SELECT DISTINCT doc_id, 'path', source FROM documents UNION SELECT DISTINCT doc_id, 'selector', lang FROM documents
) WHERE value IS NOT NULL GROUP BY field""")
def union_fields(read):
    rows = rec.fields(read("documents"), "doc_id", {"body": ("text", 1), "path": ("source", 4), "selector": ("lang", 8)})
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query(r"""SELECT token, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (
 SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}_]+')) AS token FROM documents) GROUP BY token""")
def word_postings(read):
    rows = read("documents").select("doc_id", F.explode(t.words(t.ascii_lower(F.col("text")))).alias("token"))
    per = rows.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


# --- records and reads --------------------------------------------------------------------------

_ID = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in ("lang", "text")) + ")"
_FULL = r"regexp_matches(text, '[^\s\p{Z}\x0B\x{85}]')"


@query(f"SELECT {_ID} AS record_id, count(*) AS n_occurrences, min(doc_id) AS first_doc_id FROM documents WHERE {_FULL} GROUP BY 1")
def dedupe_records(read):
    return rec.record_counts(rec.with_record_id(read("documents"), "lang", "text"), "doc_id")


@query(f"SELECT {_ID} AS record_id, source AS page, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents WHERE {_FULL}")
def record_occurrences(read):
    rows = rec.positions(rec.with_record_id(read("documents"), "lang", "text"), "source", "doc_id")
    return rows.select("record_id", F.col("source").alias("page"), "position")


@query("SELECT conv_id, turn, 'o' || (row_number() OVER (ORDER BY conv_id, turn) - 1) AS occurrence_id FROM conversations")
def occurrence_ids(read):
    return rec.occurrence_ids(read("conversations"), "conv_id", "turn").select("conv_id", "turn", "occurrence_id")


@query("""SELECT count(*) AS rows, count(DISTINCT conv_id) AS pages, count(*) FILTER (turn <> p) AS gaps, count(*) FILTER (b >= turn) AS unordered FROM (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)""")
def position_continuity(read):
    rows = read("conversations").select("conv_id", "turn")
    tagged = lambda df, tag: df.select("conv_id", F.lit(tag).alias("tag"))
    found = tagged(rows, "row").union(tagged(integrity.position_gaps(rows, "conv_id", "turn"), "gap")).union(tagged(integrity.unordered(rows, "conv_id", "turn", "turn"), "late"))
    count = lambda tag: F.count_if(F.col("tag") == tag)
    return found.agg(count("row").alias("rows"), F.count_distinct("conv_id").alias("pages"), count("gap").alias("gaps"), count("late").alias("unordered"))


@query("""SELECT a.conv_id, a.turn, b.turn AS near_turn, b.role AS near_role FROM conversations a JOIN conversations b
ON a.conv_id = b.conv_id AND a.turn <> b.turn AND abs(a.turn - b.turn) <= 2""")
def context_neighbours(read):
    return srch.neighbours(read("conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 2).select("conv_id", "turn", "near_turn", "near_role")


@query("""SELECT conv_id, turn, greatest(0, least(length(text), 1200 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS shown FROM conversations""")
def context_budget(read):
    return srch.budgeted(read("conversations"), "conv_id", "turn", "text", 1200).select("conv_id", "turn", "shown")


@query("""SELECT doc_id, substr(text, 1, 12000) AS body, 0::BIGINT AS start_byte, strlen(substr(text, 1, 12000)) AS end_byte,
 CASE WHEN length(text) > 12000 THEN strlen(substr(text, 1, 12000)) END AS next_offset FROM documents""")
def body_slice(read):
    rows = read("documents").select("doc_id", F.explode(F.array(t.byte_slice(F.col("text"), F.lit(0), srch.BUDGET))).alias("b"))
    return rows.select("doc_id", F.col("b.text").alias("body"), F.col("b.start").cast("long").alias("start_byte"), F.col("b.end").cast("long").alias("end_byte"), F.col("b.next").cast("long").alias("next_offset"))


@query("""SELECT o_custkey, o_orderkey, total, number::INT AS number, CASE WHEN total > 10 THEN 10 END AS next_offset FROM (
 SELECT *, count(*) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS number FROM orders) WHERE number BETWEEN 5 AND 9""")
def list_page(read):
    rows = srch.list_page(read("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], 5)
    return rows.select("o_custkey", "o_orderkey", "total", "number", "next_offset")


@query("""SELECT conv_id, turn, n AS next_text FROM (
 SELECT *, coalesce(CASE WHEN r1 = 'assistant' THEN t1 END, CASE WHEN r2 = 'assistant' THEN t2 END, CASE WHEN r3 = 'assistant' THEN t3 END, CASE WHEN r4 = 'assistant' THEN t4 END, CASE WHEN r5 = 'assistant' THEN t5 END) AS n FROM (
  SELECT conv_id, turn, role, """ + ", ".join(f"lead(role, {i}) OVER w AS r{i}, lead(text, {i}) OVER w AS t{i}" for i in range(1, 6)) + """ FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
) WHERE role = 'user'""")
def next_of_kind(read):
    rows = srch.next_of_kind(read("conversations"), "conv_id", "turn", "role", "assistant", "text")
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("next_value").alias("next_text"))


@query("""SELECT l_orderkey, min(l_linenumber) AS body_start, max(l_linenumber) + 1 AS body_end, min(l_partkey) AS source_start, max(l_partkey) + 1 AS source_end FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, 1 AS fresh FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2))
 ) GROUP BY l_orderkey, run""".replace("1 AS fresh", "CASE WHEN l_linenumber = lag(l_linenumber) OVER o + 1 AND l_partkey = lag(l_partkey) OVER o + 1 THEN 0 ELSE 1 END AS fresh").replace("GROUP BY 1, 2))\n )", "GROUP BY 1, 2) WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber))\n )"))
def mapping_runs(read):
    rows = read("lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(F.min("l_partkey").alias("l_partkey"))
    return rec.mapping_runs(rows, "l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT CASE WHEN mapped = 0 THEN 'provenance' WHEN mapped >= total THEN 'complete' ELSE 'partial' END AS coverage, count(*) AS n FROM (
 SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag = 'R') AS m, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS mapped, sum(l_quantity) AS total FROM lineitem GROUP BY 1) GROUP BY 1""")
def mapping_coverage(read):
    rows = read("lineitem").groupBy("l_orderkey").agg(F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0.0)).alias("mapped"), F.sum("l_quantity").alias("total"))
    return rows.groupBy(rec.coverage("mapped", "total").alias("coverage")).agg(F.count("*").alias("n"))


# --- text ---------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents")
def line_count(read):
    return read("documents").select("doc_id", t.line_count(F.col("text")).cast("long").alias("lines"))


@query("SELECT doc_id, coalesce(array_to_string(string_split(text, chr(10))[2:4], chr(10)), '') || CASE WHEN len(string_split(text, chr(10))) > 4 THEN chr(10) ELSE '' END AS part FROM documents")
def line_slice(read):
    return read("documents").select("doc_id", t.line_slice(F.col("text"), 2, 4).alias("part"))


@query("SELECT page_id, repeat('#', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(html, '#+'), lambda x: length(x))), 0))::BIGINT) AS fence FROM pages")
def adaptive_fence(read):
    return read("pages").select("page_id", t.fence(F.col("html"), "#").alias("fence"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS visible FROM pages""")
def visible_text(read):
    return read("pages").select("page_id", structure.visible_text(F.col("html")).alias("visible"))


@query(r"""SELECT page_id, (i - 1)::INT AS heading_no, levels[i]::INT AS level, trim(regexp_replace(regexp_replace(titles[i], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM (
 SELECT *, unnest(range(1, len(levels) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>', 1) AS levels, regexp_extract_all(html, '(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>', 2) AS titles FROM pages))""")
def page_headings(read):
    return structure.headings(read("pages")).select("page_id", "heading_no", "level", "title")


_MD = "'conv' || conv_id || '.md'"


def _conversation_pages(read) -> DataFrame:
    """Each conversation as a Markdown page: a heading for each turn, its level by the turn's number."""
    turns = read("conversations").select("conv_id", "turn", F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" "), "role", F.lit("\n\n"), "text", F.lit("\n\n")).alias("md"))
    pages = render.assembled(turns, "conv_id", "turn", "md")
    return pages.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.col("markdown").alias("text"))


@query(f"""WITH c AS (SELECT {_MD} AS path, conv_id, turn, role, turn % 3 + 1 AS level,
 strlen(repeat('#', (turn % 3 + 1)::BIGINT) || ' ' || role || chr(10) || chr(10) || text || chr(10) || chr(10)) AS n FROM conversations),
 s AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY turn) - n AS b, sum(n) OVER (PARTITION BY path) AS total FROM c)
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY turn))::INT AS section_no, role AS title, level::INT AS level, b::BIGINT AS start_byte,
 coalesce((SELECT min(x.b) FROM s x WHERE x.path = s.path AND x.turn > s.turn AND x.level <= s.level), total)::BIGINT AS end_byte FROM s""")
def markdown_sections(read):
    return structure.sections(_conversation_pages(read)).select("path", "section_no", "title", "level", "start_byte", "end_byte")


@query(f"""WITH c AS (SELECT {_MD} AS path, turn, role, turn % 3 + 1 AS level FROM conversations)
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY turn))::INT AS section_no,
 array_to_string(list_filter([
  CASE WHEN level > 1 THEN (SELECT max_by(x.role, x.turn) FROM c x WHERE x.path = c.path AND x.turn < c.turn AND x.level = 1) END,
  CASE WHEN level > 2 THEN (SELECT max_by(x.role, x.turn) FROM c x WHERE x.path = c.path AND x.turn < c.turn AND x.level = 2) END, role], lambda x: x IS NOT NULL), ' / ') AS title_path FROM c""")
def title_paths(read):
    return structure.sections(_conversation_pages(read)).select("path", "section_no", F.array_join("title_path", " / ").alias("title_path"))


def _sources(read) -> DataFrame:
    """Documents as Python sources: the first line of each paragraph is a comment, the rest is code."""
    return read("documents").select(F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("# "), F.replace("text", F.lit(". "), F.lit(".\n# "))).alias("text"))


@query(r"""SELECT path, segment_no, kind, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, count(*) AS lines FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY line_no) AS segment_no FROM (
  SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS fresh FROM (
   SELECT path, i AS line_no, CASE WHEN starts_with(l, '#') THEN 'prose' WHEN trim(l) = '' THEN 'layout' ELSE 'code' END AS kind FROM (
    SELECT path, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (
     SELECT source || '/d' || doc_id || '.py' AS path, string_split('# ' || replace(text, '. ', '.' || chr(10) || '# '), chr(10)) AS ls FROM documents)))
  WINDOW w AS (PARTITION BY path ORDER BY line_no))
) GROUP BY ALL""")
def comment_segments(read):
    rows = structure.segments(_sources(read))
    return rows.select("path", "segment_no", "kind", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("lines"))


def _directive_files(read) -> DataFrame:
    """Orders as files with a directive: a block of its own or within a sentence."""
    tag = F.concat(F.lit('{% '), F.when(F.col("o_orderstatus") == "F", "include").when(F.col("o_orderstatus") == "O", "link").otherwise("audit"), F.lit(' "'), "o_orderpriority", F.lit('" lines="1-'), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit('" %}'))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Order.\n\n"), tag, F.lit("\n"))).otherwise(F.concat(F.lit("Order with "), tag, F.lit(" inside.\n")))
    return read("orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


@query("""SELECT 'orders/' || o_orderkey || '.md' AS path, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 1 END AS line_no,
 CASE o_orderstatus WHEN 'F' THEN 'include' WHEN 'O' THEN 'link' ELSE 'audit' END AS name, o_orderkey % 2 <> 0 AS inline, o_orderpriority AS positional, '1-' || (o_orderkey % 9 + 1) AS lines FROM orders""")
def directive_requests(read):
    rows = structure.directives(_directive_files(read))
    rows = rows.withColumn("a", structure.once(structure.arguments(F.col("arguments"))))
    return rows.select("path", "line_no", "name", "inline", F.array_join(F.transform("a.positional", structure.plain), ",").alias("positional"), structure.plain(F.element_at("a.named", F.lit("lines"))).alias("lines"))


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'core' WHEN 'O' THEN 'core' END AS owner, CASE o_orderstatus WHEN 'F' THEN 'include' WHEN 'O' THEN 'link' ELSE 'audit' END AS name,
 CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown_directive' END AS error, count(*) AS n FROM orders GROUP BY ALL""")
def owner_route(read):
    rows = structure.directives(_directive_files(read))
    owners = rows.sparkSession.createDataFrame([("include", "core"), ("link", "core")], "name string, owner string")
    return references.routed(rows, owners).groupBy("owner", "name", "error").agg(F.count("*").alias("n"))


# --- windows, intervals, events -----------------------------------------------------------------


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1)::BIGINT AS sibling FROM events")
def sibling_index(read):
    e = read("events").select("event_id", F.struct("user_id", "event_type").alias("place"))
    return rec.positions(e, "place", "event_id").select("event_id", F.col("position").alias("sibling"))


@query("""SELECT user_id, island, event_type, count(*) AS n, min(event_id) AS first_event FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
  SELECT *, CASE WHEN lag(event_type) OVER w IS NULL OR (event_type = lag(event_type) OVER w AND ts <= lag(ts) OVER w + INTERVAL 1 HOUR) THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))
GROUP BY ALL""")
def line_islands(read):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = intervals.islands(read("events"), "user_id", at, ("event_id",), ["event_type"], 3_600_000_000, intervals.DAY * 1_000_000)
    return rows.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""SELECT user_id, min(s)::BIGINT AS s, max(e)::BIGINT AS e, count(*) AS n FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
   SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + floor(value * 60)::BIGINT AS e FROM events)))
GROUP BY user_id, island""")
def interval_union(read):
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    rows = read("events").select("user_id", start.alias("s"), (start + F.floor(F.col("value") * 60)).alias("e"))
    return intervals.union_of(rows, "user_id", "s", "e")


@query("""WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS at, value FROM events)
SELECT a.event_id, b.event_id AS span_id FROM p a JOIN p b ON a.user_id = b.user_id AND b.value >= 1 AND a.event_id <> b.event_id AND a.at >= b.at AND a.at < b.at + floor(b.value * 30)::BIGINT""")
def interval_join(read):
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    e = read("events").select("event_id", "user_id", start.alias("at"), "value")
    spans = e.where("value >= 1").select(F.col("event_id").alias("span_id"), "user_id", F.col("at").alias("s"), (F.col("at") + F.floor(F.col("value") * 30)).alias("e"))
    found = intervals.containing(e.select("event_id", "user_id", "at"), spans, "user_id", "at", "s", "e", 3600)
    return found.where("event_id != span_id").select("event_id", "span_id")


@query("""SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS last_signup, count(*) AS n FROM (
 SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)
GROUP BY user_id, s""")
def nearest_earlier(read):
    rows = read("events")
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = Stretches(rows, "user_id", at, ("event_id",), intervals.DAY * 1_000_000).latest(signup, "s").done()
    return rows.groupBy("user_id", "s").agg(F.max(signup).alias("last_signup"), F.count("*").alias("n")).drop("s")


@query("""SELECT user_id, CASE max(r) WHEN 4 THEN 'removed' WHEN 3 THEN 'created' WHEN 2 THEN 'content' ELSE 'attributes' END AS kind, count(*) AS n FROM (
 SELECT user_id, CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 END AS r FROM events) WHERE r IS NOT NULL GROUP BY 1""")
def strongest_change(read):
    kinds = F.create_map(*(F.lit(x) for x in ("error", "removed", "signup", "created", "purchase", "content", "click", "attributes")))
    return strongest(read("events").select("user_id", F.element_at(kinds, F.col("event_type")).alias("kind")), "user_id")


@query("SELECT user_id, bool_or(event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def any_error_flag(read):
    error = F.col("event_type") == "error"
    return read("events").groupBy("user_id").agg(F.bool_or(error).alias("failed"), F.count_if(error).alias("errors"))


@query("""SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (
 SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""")
def quiet_sessions(read):
    return intervals.quiet_sessions(read("events"), "user_id", "ts", 30 * 60_000_000)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (
 SELECT user_id, i, t, t AS s, 1 AS b FROM e WHERE i = 1
 UNION ALL
 SELECT e.user_id, e.i, e.t, CASE WHEN e.t - f.t >= 10800000000 OR e.t - f.s >= 28800000000 THEN e.t ELSE f.s END, CASE WHEN e.t - f.t >= 10800000000 OR e.t - f.s >= 28800000000 THEN f.b + 1 ELSE f.b END
 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM f GROUP BY user_id, b""")
def capped_coalescing(read):
    return intervals.capped_bursts(read("events"), "user_id", "ts", 3 * 3_600_000_000, 8 * 3_600_000_000)


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, count(*) FILTER (((event_id & 32) <> 0)) AS flagged FROM events GROUP BY 1")
def percentiles(read):
    rows = read("events")
    flagged = rows.groupBy(F.col("event_type").alias("type")).agg(F.count_if(F.col("event_id").bitwiseAND(F.lit(32)) != 0).alias("flagged"))
    found = exact_quantiles(rows, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return found.join(flagged, found["event_type"].eqNullSafe(flagged["type"])).drop("type")


@query("""WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, max(v) FILTER (i = ceil(0.5::DOUBLE * n)) AS p50, max(v) FILTER (i = ceil(0.95::DOUBLE * n)) AS p95 FROM r GROUP BY 1""")
def nearest_rank_percentiles(read):
    return exact_quantiles(read("lineitem"), "l_suppkey", "l_extendedprice", {"p50": 0.5, "p95": 0.95}, nearest=True)


# --- joins, comparisons, integrity --------------------------------------------------------------


@query("""SELECT status, count(*) AS n FROM (SELECT coalesce(a.k, b.k) AS k,
 CASE WHEN a.k IS NULL THEN 'unknown' WHEN b.k IS NULL THEN 'missing' WHEN a.n > 1 OR b.n > 1 THEN 'duplicate' ELSE 'ok' END AS status
 FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON a.k = b.k) GROUP BY 1""")
def request_result_closure(read):
    asked = read("orders").select(F.col("o_orderkey").alias("k"))
    given = read("lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("k"))
    return integrity.closure(asked, given, "k").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01')")
def append_target_check(read):
    shipped = read("lineitem").where("l_shipdate >= TIMESTAMP_NTZ '2001-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return read("part").select("p_partkey").join(shipped, "p_partkey", "left_anti")


@query("""SELECT p_brand, d.n AS definitions, coalesce(r.n, 0) AS n_references, CASE WHEN d.n > 1 THEN 'ambiguous' ELSE 'unique' END AS status
FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) d LEFT JOIN (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) r USING (p_brand)""")
def definition_refs(read):
    part = read("part").select("p_partkey", "p_brand")
    used = read("lineitem").select(F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    return references.reference_counts(part, used, "p_brand")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unreferenced(read):
    return references.unreferenced(read("customer").select("c_custkey"), read("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS known, CASE WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN NULL ELSE 'page_not_selected' END AS error, count(*) AS n FROM lineitem GROUP BY ALL""")
def link_targets(read):
    catalog = read("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("path"))
    rows = references.linked(read("lineitem").select(F.col("l_suppkey").alias("target")), catalog)
    return rows.groupBy(F.col("error").isNull().alias("known"), "error").agg(F.count("*").alias("n"))


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS state
 FROM (SELECT doc_id AS id, sha256(text) AS h FROM documents) a FULL JOIN (SELECT item_id AS id, sha256(text) AS h FROM benchmark) b USING (id)) GROUP BY 1""")
def fingerprint_diff(read):
    old = read("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"))
    new = read("benchmark").select(F.col("item_id").alias("id"), F.sha2("text", 256).alias("h"))
    return integrity.compared(old, new, ["id"], ["h"]).groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT user_id, event_type, count(*) FILTER (day = 0) AS a, count(*) FILTER (day = 1) AS b FROM (
 SELECT user_id, event_type, dayofyear(ts) % 2 AS day FROM events) GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN a = 0 THEN 'added' WHEN b = 0 THEN 'removed' WHEN a = b THEN 'same' ELSE 'changed' END AS state FROM d""")
def sample_diff(read):
    e = read("events").select("user_id", "event_type", (F.dayofyear("ts") % 2).alias("day"))
    counts = lambda day: e.where(F.col("day") == day).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return integrity.compared(counts(0), counts(1), ["user_id", "event_type"], ["n"])


@query("SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def stale_set(read):
    have = read("customer").select(F.col("c_nationkey").alias("nation"))
    return have.join(read("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")), "nation", "left_anti").distinct()


@query("""SELECT o_orderkey AS scope, 'left' AS side FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')
UNION ALL SELECT r, 'right' FROM (SELECT l_orderkey AS r FROM lineitem WHERE l_linestatus = 'F' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def scope_equal(read):
    asked = read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("scope"))
    return integrity.set_differences(asked, read("lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("scope")), "scope")


@query("SELECT o_custkey AS member FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def dir_members_after(read):
    o = read("orders").select(F.col("o_custkey").alias("member"), "o_orderstatus", "o_orderpriority")
    return integrity.members_after(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), o.where("o_orderpriority = '1-URGENT'"), "member")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unreviewed' WHEN d.doc_id IS NULL THEN 'orphan' WHEN d.v = l.quality THEN 'current' ELSE 'stale' END AS state
FROM (SELECT doc_id, (n_chars > 1000)::INT AS v FROM documents) d FULL JOIN labels l USING (doc_id)""")
def stale_unreviewed_orphan(read):
    now = read("documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("quality"))
    return references.reviewed(now, read("labels"), "doc_id", "quality")


_IDS = f"SELECT {_ID} AS id FROM documents WHERE {_FULL} GROUP BY 1"


@query(f"SELECT sha256(string_agg(h, '' ORDER BY b)) AS snapshot, sum(n)::BIGINT AS records FROM (SELECT left(id, 2) AS b, sha256(string_agg(id, '' ORDER BY id)) AS h, count(*) AS n FROM ({_IDS}) GROUP BY 1)")
def snapshot_identity(read):
    ids = rec.with_record_id(read("documents"), "lang", "text").select("record_id").distinct()
    return integrity.snapshot_identity(ids)


@query()
def record_handles(read):
    """XXH64 in base 62 is beyond SQL; the tests have fixed vectors."""
    ids = rec.with_record_id(read("documents"), "lang", "text").select("record_id").distinct()
    return ids.withColumn("handle", hashing.handles(F.col("record_id"), "0" * 64))


@query(f"SELECT left(id, 3) AS handle, count(*) AS targets FROM ({_IDS}) GROUP BY 1 HAVING count(*) > 1")
def handle_uniqueness(read):
    """Handles as short as three digits stand for several records; those of eleven are made sure of on the way."""
    named = record_handles(read)
    short = named.select("record_id", F.left("record_id", F.lit(3)).alias("handle"))
    clashes = integrity.collisions(named, "handle", "record_id").select("handle", "targets")
    return integrity.collisions(short, "handle", "record_id").select("handle", "targets").unionByName(clashes)


@query("""SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'source_error' WHEN doc_id % 5 = 0 OR strlen(text) = 0 THEN 'invalid_range'
 WHEN doc_id % 3 = 0 THEN 'wrong_lines' END AS error FROM documents) GROUP BY 1""")
def spans_valid(read):
    d = read("documents")
    files = d.where("doc_id % 17 != 0").select(F.col("doc_id").alias("path"), "text")
    size = F.octet_length("text")
    spans = d.select(
        F.col("doc_id").alias("path"), F.lit(0).alias("start_byte"), (size + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("end_byte"),
        F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("start_line"), (t.line_count(F.col("text")) - F.col("text").endswith("\n").cast("int")).alias("end_line"),
    )
    errors = integrity.span_errors(spans, files).select("path", "error")
    return spans.join(errors, "path", "left").groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1),
d AS (SELECT doc_id, lang, source, {_ID} AS id, strlen(text) AS size, coalesce(toxic, 0) AS toxic, coalesce(quality, 1) AS quality FROM documents LEFT JOIN l USING (doc_id) WHERE {_FULL}),
r AS (SELECT CASE WHEN toxic = 1 THEN upper(id) ELSE id END AS id, CASE WHEN quality = 0 THEN 0 ELSE size END AS stop FROM d),
o AS (SELECT id, source AS page, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 + toxic AS position FROM d WHERE lang <> 'fr' UNION ALL SELECT sha256('b' || item_id), 'benchmark', row_number() OVER (ORDER BY item_id) - 1 FROM benchmark)
SELECT 'id_form' AS "check", id AS subject FROM r WHERE NOT regexp_matches(id, '^[0-9a-f]{{64}}$') UNION ALL SELECT 'id_twice', id FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'span', id FROM r WHERE stop <= 0 UNION ALL SELECT 'unknown_record', id FROM o WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT 'no_occurrence', id FROM r WHERE id NOT IN (SELECT id FROM o)
UNION ALL SELECT 'position', page FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY position) - 1 AS want FROM o) WHERE want <> position""")
def index_validation(read):
    """An index with every kind of damage: toxic documents have wrong ids and places, copies come twice, those of low quality have no span, French ones no place."""
    labels = read("labels").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    rows = rec.with_record_id(read("documents"), "lang", "text").join(labels, F.col("doc_id") == F.col("_doc"), "left")
    toxic = F.coalesce("toxic", F.lit(0))
    stop = F.when(F.col("quality") == 0, 0).otherwise(F.octet_length("text"))
    known = rows.select(F.when(toxic == 1, F.upper("record_id")).otherwise(F.col("record_id")).alias("record_id"), F.lit(0).alias("start_byte"), stop.alias("end_byte"))
    placed = rec.positions(rows.where("lang != 'fr'"), "source", "doc_id").select("record_id", F.col("source").alias("page"), (F.col("position") + toxic).alias("position"))
    strange = rec.positions(read("benchmark").withColumn("page", F.lit("benchmark")), "page", "item_id").select(F.sha2(F.concat(F.lit("b"), "item_id"), 256).alias("record_id"), "page", "position")
    return integrity.index_violations(known, placed.unionByName(strange))


# --- pages and plugins --------------------------------------------------------------------------


@query("""SELECT 'pages/conv' || conv_id || '.md' AS page, length(m) AS chars, sha256(m) AS hash FROM (
 SELECT conv_id, string_agg('> **Source**: [`conv' || conv_id || ':L' || turn || '-L' || (turn + 1) || '`](../conv' || conv_id || '#L' || turn || ') · bytes [0,' || strlen(text) || ')' || chr(10) || chr(10) || f || role || chr(10) || text || CASE WHEN ends_with(text, chr(10)) THEN '' ELSE chr(10) END || f || chr(10) || chr(10), '' ORDER BY turn) AS m
 FROM (SELECT *, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0))::BIGINT) AS f FROM conversations) GROUP BY conv_id)""")
def rendered_pages(read):
    d = read("conversations")
    path = F.concat(F.lit("conv"), F.col("conv_id").cast("string"))
    line = render.provenance("Source", path, F.col("turn"), F.col("turn") + 1, F.lit(0), F.octet_length("text"), render.page_path(F.lit("p")))
    chunk = F.concat(line, F.lit("\n\n"), render.fenced_code(F.col("text"), F.col("role")), F.lit("\n\n"))
    pages = render.assembled(d.select(path.alias("path"), "turn", chunk.alias("chunk")), "path", "turn", "chunk")
    return pages.select(render.page_path(F.col("path")).alias("page"), F.length("markdown").cast("long").alias("chars"), F.sha2("markdown", 256).alias("hash"))


@query("""SELECT doc_id, CASE WHEN NOT labelled THEN 'source_error' WHEN n < 3 THEN 'invalid_range' WHEN trim(m, ' ' || chr(10)) = '' THEN 'empty_selection' END AS error,
 CASE WHEN labelled AND n >= 3 AND trim(m, ' ' || chr(10)) <> '' THEN m END AS markdown FROM (
 SELECT doc_id, labelled, len(l) - (ends_with(text, chr(10)))::INT AS n, l[2] || chr(10) || l[3] || CASE WHEN len(l) > 3 THEN chr(10) ELSE '' END AS m FROM (SELECT *, string_split(text, chr(10)) AS l, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents))""")
def include_lines(read):
    d = read("documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    asked = d.select("doc_id", "path", F.lit(2).alias("first"), F.lit(3).alias("last"))
    return render.included(asked, d.join(read("labels"), "doc_id", "left_semi").select("path", "text")).select("doc_id", "error", "markdown")


def _count_words(pdf):
    return pdf.assign(markdown=[None if a is None else f"{len(a)} characters" for a in pdf["arguments"]], error=None)


@query("""SELECT doc_id AS request_no, CASE WHEN lang = 'en' THEN 'english' ELSE 'others' END AS owner, length(text)::VARCHAR || ' characters' AS markdown, NULL::VARCHAR AS error FROM documents""")
def plugin_batch(read):
    registry = plugins.Registry()
    registry.add("english", ["count_en"], _count_words, contract="request")
    registry.add("others", ["count_other"], _count_words, contract="request")
    d = read("documents")
    asked = d.select(F.col("doc_id").alias("request_no"), F.col("source").alias("path"), F.when(F.col("lang") == "en", "count_en").otherwise("count_other").alias("name"), F.col("text").alias("arguments"))
    routed = references.routed(asked, registry.table(d.sparkSession)).drop("error")
    return plugins.run_plugins(routed, registry)


@query("SELECT o_orderpriority AS module, count(*) AS cases, sum(o_totalprice) AS cost FROM orders GROUP BY 1 ORDER BY cost DESC")
def longest_first(read):
    return read("orders").groupBy(F.col("o_orderpriority").alias("module")).agg(F.count("*").alias("cases"), F.sum("o_totalprice").alias("cost")).orderBy(F.desc("cost"))


@query(r"""SELECT page_id, list_sort(list_distinct(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: NOT list_contains(regexp_extract_all(html, 'href="(/[^"]*)"', 1), x)))) AS outside FROM pages""")
def link_difference(read):
    every = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    return read("pages").select("page_id", F.array_sort(F.array_except(every('href="([^"]*)"'), every('href="(/[^"]*)"'))).alias("outside"))


@query("""SELECT doc_id, '<' || left(text, 10) || '>' || substr(text, 11, 10) || '[' || lang || ']' || substr(text, 26) AS text FROM documents""")
def prose_substitution(read):
    d = read("documents")
    values = F.array(F.concat(F.lit("<"), F.left("text", F.lit(10)), F.lit(">")), F.concat(F.lit("["), "lang", F.lit("]")))
    return d.select("doc_id", render.substituted(F.col("text"), F.array(F.lit(0), F.lit(20)), F.array(F.lit(10), F.lit(25)), values).alias("text"))


@query("""SELECT 'conv' || conv_id || '.md' AS path, kind, count(*) AS n FROM (
 SELECT conv_id, 'heading' AS kind FROM conversations
 UNION ALL SELECT conv_id, 'paragraph' FROM conversations) GROUP BY ALL""")
def prose_leaves(read):
    return structure.leaves(_conversation_pages(read)).groupBy("path", "kind").agg(F.count("*").alias("n"))


@query("""SELECT page_id AS path, 1 AS line_no FROM pages WHERE page_id % 3 = 0""")
def open_fences(read):
    fence = F.when(F.col("page_id") % 3 == 0, F.lit("```text\n")).otherwise(F.lit("```text\nx\n```\n"))
    files = read("pages").select(F.col("page_id").alias("path"), F.concat(fence, structure.visible_text(F.col("html"))).alias("text"))
    return structure.open_fences(files)


@query("""SELECT f.s_suppkey AS fact, n_nationkey AS changed FROM supplier f JOIN nation ON f.s_nationkey = n_nationkey OR (f.s_suppkey % 2 = 0 AND n_regionkey = (SELECT n_regionkey FROM nation x WHERE x.n_nationkey = f.s_nationkey)) WHERE n_nationkey % 3 = 0""")
def change_relevance(read):
    nation = read("nation").withColumn("path", F.concat_ws("/", F.lit("w"), F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")))
    s = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    facts = s.select(F.col("s_suppkey").alias("fact"), F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws("/", F.lit("w"), F.col("n_regionkey").cast("string"))).otherwise(F.col("path")).alias("path"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(False)).alias("recursive"))
    found = integrity.affected(nation.where("n_nationkey % 3 = 0").select("path"), facts)
    return found.select("fact", F.element_at(F.split("changed", "/"), -1).cast("int").alias("changed"))


@query("""SELECT 'conv' || conv_id || '.md' AS page, max(text) FILTER (turn = 0) || chr(10) || coalesce('# Appendix' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn > 0) || chr(10), '') AS markdown
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (turn = 0) > 0""")
def appendix_pages(read):
    page = F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".md")).alias("page")
    turns = read("conversations")
    pages = turns.where("turn = 0").select(page, F.concat("text", F.lit("\n")).alias("markdown"))
    return render.with_appendix(pages, turns.where("turn > 0").select(page, F.col("turn").alias("plugin"), F.col("text").alias("markdown")))


@query("""SELECT l_orderkey, min_by(l_returnflag, l_linenumber) FILTER (l_returnflag <> 'N') AS error, count(*) AS nodes FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def first_failures(read):
    nodes = read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    nodes = nodes.withColumn("flag", F.when(F.col("flag") != "N", F.col("flag")))
    return render.first_failures(nodes, "l_orderkey", "l_linenumber", "flag")


@query("""SELECT c_custkey AS report FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)""")
def publication_gate(read):
    reports = read("customer").select(F.col("c_custkey").alias("report"), F.col("c_nationkey").alias("target"))
    failed = read("events").select(F.when(F.col("event_type") == "error", "error").otherwise("note").alias("severity"))
    return render.gate(failed, reports, read("supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("page")))


def _section_tree(read) -> DataFrame:
    """Sections of the conversations' pages as a tree: their titles name them."""
    rows = structure.sections(_conversation_pages(read))
    return rows.select("path", F.col("section_no").alias("node"), F.col("parent_no").alias("parent"), F.col("title").alias("name"), "start_byte")


_TREE = f"""c AS (SELECT {_MD} AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS node, turn, role, turn % 3 + 1 AS level FROM conversations),
t AS (SELECT *, (SELECT max(x.node) FROM c x WHERE x.path = c.path AND x.turn < c.turn AND x.level < c.level) AS parent FROM c)"""


@query(f"WITH {_TREE} SELECT path, node, parent::INT AS parent FROM t")
def section_tree(read):
    return _section_tree(read).select("path", "node", F.col("parent").cast("int").alias("parent"))


@query(f"""WITH {_TREE}, a AS (SELECT path, count(*) AS n, min(node) AS v FROM t WHERE parent IS NULL AND role = 'user' GROUP BY 1),
b AS (SELECT t.path, count(*) AS n, min(t.node) AS v FROM t JOIN a ON t.path = a.path AND a.n = 1 AND t.parent = a.v WHERE t.role = 'assistant' GROUP BY 1)
SELECT p.path, CASE WHEN b.n = 1 THEN b.v END AS node, CASE WHEN a.n IS NULL THEN 'selection_not_found' WHEN a.n > 1 THEN 'selection_ambiguous' WHEN b.n IS NULL THEN 'selection_not_found' WHEN b.n > 1 THEN 'selection_ambiguous' END AS error
FROM (SELECT DISTINCT path FROM t) p LEFT JOIN a USING (path) LEFT JOIN b USING (path)""")
def tree_select(read):
    return structure.selected(_section_tree(read), structure.path_steps("user.assistant"))


@query(f"""WITH {_TREE}, a AS (SELECT path, node, row_number() OVER (PARTITION BY path ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY path) AS n FROM t WHERE parent IS NULL AND role = 'user'),
x AS (SELECT path, max(n) AS n, max(node) FILTER (i = 1) AS v FROM a GROUP BY 1),
b AS (SELECT t.path, count(*) AS n, min(t.node) AS v FROM t JOIN x ON t.path = x.path AND t.parent = x.v WHERE t.role = 'assistant' GROUP BY 1)
SELECT p.path, CASE WHEN b.n IS NOT NULL THEN b.v END AS node, CASE WHEN x.n IS NULL THEN 'selection_not_found' WHEN x.v IS NULL THEN 'selection_out_of_bounds' WHEN b.n IS NULL THEN 'selection_not_found' END AS error
FROM (SELECT DISTINCT path FROM t) p LEFT JOIN x USING (path) LEFT JOIN b USING (path)""")
def tree_select_number(read):
    return structure.selected(_section_tree(read), structure.path_steps('["user", 1, "assistant", 0]'))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '../' || source || '/d%20' || doc_id || '.md' ELSE 'd%20' || doc_id || '.md' END AS url FROM documents""")
def link_urls(read):
    d = read("documents")
    target = F.concat("source", F.lit("/d "), F.col("doc_id").cast("string"), F.lit(".md"))
    page = F.when(F.col("doc_id") % 2 == 0, F.lit("other/p.md")).otherwise(F.concat("source", F.lit("/p.md")))
    return d.select("doc_id", t.relative_url(target, page).alias("url"))


@query("""SELECT url, count(*) AS n, count(DISTINCT page_id) AS pages, bool_or(self) AS to_itself FROM (
 SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url, false AS self FROM pages) GROUP BY url""")
def link_inventory(read):
    rows = read("pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("to"))
    per = rows.groupBy("to", "page_id").agg(F.count("*").alias("n"), F.bool_or(F.col("to") == F.col("url")).alias("self"))
    return per.groupBy(F.col("to").alias("url")).agg(F.sum("n").alias("n"), F.count("*").alias("pages"), F.bool_or("self").alias("to_itself"))


@query("""SELECT p_partkey, coalesce(l.n, 0) AS sites, coalesce(o.n, 0) AS tests, CASE WHEN l.n IS NULL THEN 'unsited' WHEN o.n IS NULL THEN 'untested' ELSE 'ok' END AS state FROM part
LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) o ON o.l_partkey = p_partkey""")
def clause_assembly(read):
    lines = read("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_returnflag")
    sites = lines.where("l_returnflag = 'R'").groupBy("p_partkey").agg(F.count("*").alias("sites"))
    tests = lines.where("l_returnflag = 'A'").groupBy("p_partkey").agg(F.count_distinct("l_orderkey").alias("tests"))
    out = read("part").select("p_partkey").join(sites, "p_partkey", "left").join(tests, "p_partkey", "left")
    state = F.when(F.col("sites").isNull(), "unsited").when(F.col("tests").isNull(), "untested").otherwise("ok")
    return out.select("p_partkey", F.coalesce("sites", F.lit(0)).alias("sites"), F.coalesce("tests", F.lit(0)).alias("tests"), state.alias("state"))


@query("SELECT DISTINCT user_id, event_type AS dependency, json_extract_string(props, '$.k')::BIGINT % 3 AS kind FROM events")
def dependency_union(read):
    rows = read("events").select("user_id", F.col("event_type").alias("dependency"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("kind"))
    return rows.distinct()


@query()
def canonical_events(read):
    """Strict, canonical JSON of the events' properties; key order and refusals are beyond SQL."""
    return read("events").select("event_id", hashing.canonical_json("props").alias("props"))
