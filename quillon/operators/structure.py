"""Text structure by lines: sections, comment and code segments, directives, page text.

Fences are folded in the file's row. Lines are exploded with their byte offsets, and other state
that runs down a file, such as an open comment, is a running window over its lines. A file's lines
meet in one task; files don't.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import maps
from quillon.functions.text import ascii_lower
from quillon.operators.regions import tags_of

#: Language and markers of line and block comments by suffix.
LANGUAGES = {
    "rs": ("rust", "//", "/*", "*/"), "js": ("javascript", "//", "/*", "*/"), "mjs": ("javascript", "//", "/*", "*/"), "cjs": ("javascript", "//", "/*", "*/"), "jsx": ("jsx", "//", "/*", "*/"),
    "ts": ("typescript", "//", "/*", "*/"), "mts": ("typescript", "//", "/*", "*/"), "cts": ("typescript", "//", "/*", "*/"), "tsx": ("tsx", "//", "/*", "*/"), "go": ("go", "//", "/*", "*/"),
    "py": ("python", "#", None, None), "pyi": ("python", "#", None, None), "ml": ("ocaml", None, "(*", "*)"), "mli": ("ocaml", None, "(*", "*)"),
}
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*\r?\n?$"
FENCE = r"^ {0,3}(`{3,}|~{3,})"
ANCHOR = r"""^<a id="([^"]+)"></a>[ \t]*\r?\n?$"""
DIRECTIVE = r"\{%[ \t]*([a-z][a-z0-9_-]*(?:\.[a-z][a-z0-9_-]*)*)((?:[^%]|%(?!\}))*?)[ \t]*%\}"


def suffix(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def language(path: Column) -> Column:
    """Fence label of a source file's language; ``markdown`` for .md; null for what is unsupported."""
    table = F.create_map(*(x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v[0]))), F.lit("md"), F.lit("markdown"))
    return F.element_at(table, suffix(path))


def lines(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Lines with their ends: key, line_no (from 1), line, start_byte, end_byte, in_code.

    in_code: inside a fenced block or on its fences. Fences are found in the file's row, so the
    only shuffle is that of the running sum of bytes.
    """
    files = files.select(key, text, once(fences(F.col(text)).getField("blocks")).alias("_blocks"))
    each = files.select(key, "_blocks", F.posexplode(F.split(text, r"(?<=\n)")).alias("_i", "line")).where("line != ''")
    each = each.select(key, "_i", "line", F.exists("_blocks", lambda b: (F.col("_i") + 1).between(b.first, b.last)).alias("in_code"))
    w = Window.partitionBy(key).orderBy("_i")
    each = each.withColumn("end_byte", F.sum(F.octet_length("line")).over(w).cast("long"))
    return each.select(key, (F.col("_i") + 1).alias("line_no"), "line", (F.col("end_byte") - F.octet_length("line")).alias("start_byte"), "end_byte", "in_code")


def once(value: Column) -> Column:
    """The value as a generator's only row, so that it isn't computed again wherever it is used."""
    return F.explode(F.array(value))


def fences(text: Column) -> Column:
    """Fenced blocks of a text: struct blocks (first and last line), open_line; in the row.

    A block is closed by a line that is only a fence of its character and at least its length;
    other fences within are text. open_line is that of a block that nothing closes, which goes
    on to the end; null if there is none.
    """
    mark = lambda line, i: F.struct((i + 1).alias("line_no"), F.regexp_extract(line, FENCE, 1).alias("mark"), line.rlike(FENCE + r"[ \t]*\r?\n?$").alias("bare"))
    marks = F.when(text.rlike(r"(?m)" + FENCE), F.filter(F.transform(F.split(text, r"(?<=\n)"), mark), lambda m: m.mark != ""))
    block = "array<struct<first:int,last:int>>"
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.array().cast(block).alias("blocks"))

    def fold(acc: Column, m: Column) -> Column:
        closes = m.bare & (F.substring(m.mark, 1, 1) == F.substring(acc.open, 1, 1)) & (F.length(m.mark) >= F.length(acc.open))
        opened = F.struct(m.mark.alias("open"), m.line_no.cast("int").alias("at"), acc.blocks.alias("blocks"))
        closed = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.concat(acc.blocks, F.array(F.struct(acc.at.alias("first"), m.line_no.cast("int").alias("last")))).alias("blocks"))
        return F.when(acc.open == "", opened).when(closes, closed).otherwise(acc)

    def end(acc: Column) -> Column:
        rest = F.array(F.struct(acc.at.alias("first"), F.lit((1 << 31) - 1).alias("last"))).cast(block)
        is_open = acc.open != ""
        return F.struct(F.when(is_open, F.concat(acc.blocks, rest)).otherwise(acc.blocks).alias("blocks"), F.when(is_open, acc.at).alias("open_line"))

    return F.aggregate(F.coalesce(marks, F.array().cast("array<struct<line_no:int,mark:string,bare:boolean>>")), start, fold, end)


def sections(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Sections by headings: key, section_no, parent_no, title, anchor, level, start_byte, end_byte, title_path.

    A section ends where the next heading of its level or a higher one begins. An anchor on the
    line before belongs to it. title_path lists the headings above, itself last; parent_no is the
    last heading before of a smaller level, null at the top.
    """
    own = lines(files, key, text)
    total = Window.partitionBy(key)
    w = total.orderBy("line_no")
    rows = own.withColumns({"_end": F.max("end_byte").over(total), "_before": F.lag("line").over(w), "_from": F.lag("start_byte").over(w)})
    hashes = F.regexp_extract("line", HEADING, 1)
    rows = rows.where(~F.col("in_code") & (hashes != ""))
    anchor = F.regexp_extract("_before", ANCHOR, 1)
    rows = rows.select(
        key, F.length(hashes).alias("level"), F.trim(F.coalesce(F.regexp_extract("line", HEADING, 2), F.lit(""))).alias("title"),
        F.nullif(anchor, F.lit("")).alias("anchor"), F.when(anchor != "", F.col("_from")).otherwise(F.col("start_byte")).alias("start_byte"), "_end",
    )
    at = Window.partitionBy(key).orderBy("start_byte")
    after, upto = at.rowsBetween(1, Window.unboundedFollowing), at.rowsBetween(Window.unboundedPreceding, 0)
    ends = [F.first(F.when(F.col("level") <= k, F.col("start_byte")), ignorenulls=True).over(after) for k in range(1, 7)]
    rows = rows.withColumn("section_no", F.row_number().over(at))
    last = [F.last(F.when(F.col("level") == k, F.struct("start_byte", "title", "section_no")), ignorenulls=True).over(upto).alias(f"_l{k}") for k in range(1, 7)]
    rows = rows.select("*", F.element_at(F.array(*ends), F.col("level")).alias("_next"), *last)
    above = []
    for k in range(1, 7):
        newer = F.lit(True)
        for j in range(1, k):
            newer = newer & (F.coalesce(F.col(f"_l{j}.start_byte"), F.lit(-1)) < F.col(f"_l{k}.start_byte"))
        above.append(F.when((F.col("level") >= k) & newer, F.col(f"_l{k}.title")))
    parent = F.array_max(F.array(*(F.when(F.col("level") > k, F.col(f"_l{k}.section_no")) for k in range(1, 6))))
    return rows.select(key, "section_no", parent.alias("parent_no"), "title", "anchor", "level", "start_byte", F.coalesce("_next", "_end").alias("end_byte"), F.array_compact(F.array(*above)).alias("title_path"))


def segments(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Prose, code and layout of source files: key, segment_no, kind, start_line, end_line, start_byte, end_byte, text, runs.

    Comments that own their lines are prose, without markers; line comments of one indentation and
    marker side by side are one segment, a block comment is one by itself. A block comment owns
    its lines if blanks alone are before and behind it; else it is code, as is one that nothing
    closes. A line that opens and closes comments is left as its last mark says. OCaml's comments nest. The
    rest is code, or layout if blank. Strings aren't followed: marks in them count. Markdown is one
    prose segment. ``runs`` lead from the text back to the file's bytes.
    """
    rows = lines(files.withColumn("_suffix", suffix(F.col(key))).select(key, text), key, text).withColumn("_s", suffix(F.col(key)))
    marks = {i: F.element_at(F.create_map(*(x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v[i])))), F.col("_s")) for i in (1, 2, 3)}
    body = F.regexp_replace("line", r"\r?\n$", "")
    rows = rows.select("*", *(m.alias(f"_m{i}") for i, m in marks.items()), F.ltrim(body).alias("_bare"), body.alias("_body"))
    md, nests = F.col("_s") == "md", F.coalesce(F.col("_m2") == "(*", F.lit(False))
    w = Window.partitionBy(key).orderBy("line_no")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    # Of a line outside comments what follows ``//`` holds no marks.
    seen = F.when(nests, F.col("_body")).otherwise(F.regexp_replace("_body", r"^((?:(?!/\*).)*?)//.*$", "$1"))
    rows = rows.withColumn("_seen", seen)
    last = lambda c, mark: F.length(c) - F.length(F.substring_index(c, mark, -1))
    opens = lambda c: c.contains("/*") & (last(c, "/*") > last(c, "*/"))
    raw = F.col("_body")
    after = F.when(raw.contains("*/"), opens(raw).cast("int")).when(opens(F.col("_seen")), 1)
    edge = F.last(F.when(F.col("_m2") == "/*", after), ignorenulls=True).over(earlier)
    # What is open before a line is counted where comments nest.
    times = lambda mark: (F.length("line") - F.length(F.replace("line", F.lit(mark), F.lit("")))) / 2
    grows = F.when(nests, times("(*") - times("*)")).otherwise(0)
    depth = F.coalesce(F.sum(grows).over(earlier), F.lit(0))
    rows = rows.withColumn("_inside", F.when(nests, depth > 0).otherwise(F.coalesce(edge, F.lit(0)) == 1))
    goes_on = F.when(nests, depth + grows > 0).otherwise(F.coalesce(after, F.col("_inside").cast("int")) == 1)
    begins = ~F.col("_inside") & F.coalesce(F.col("_bare").startswith(F.col("_m2")), F.lit(False))
    within = F.col("_inside") | begins
    rows = rows.withColumns({"_begins": begins, "_within": within, "_ends": within & ~goes_on, "_other": ~F.col("_inside") & ~begins & goes_on})
    # A comment's lines, from the one that it begins on; one that begins behind code is another's.
    rows = rows.withColumn("_comment", F.sum((F.col("_begins") | F.col("_other")).cast("int")).over(w))
    whole = Window.partitionBy(key, "_comment")
    only = ~F.when(nests, F.col("_bare").rlike(r"\*\)[^(]*[^\s(*][^(]*\(\*")).otherwise(F.col("_bare").rlike(r"^/\*.*?\*/\s*\S") & ~F.col("_inside"))
    behind = F.when(nests, F.rtrim("_bare").endswith("*)")).otherwise(F.col("_bare").rlike(r"^(?:(?!\*/).)*\*/\s*$") | (~F.col("_inside") & F.col("_bare").rlike(r"^/\*(?:(?!\*/).)*\*/\s*$")))
    own = F.max(F.when(F.col("_within"), (F.col("_ends") & behind).cast("int"))).over(whole) * F.min(F.when(F.col("_within"), only.cast("int"))).over(whole)
    head = F.max(F.col("_begins").cast("int")).over(whole) * (1 - F.max(F.col("_other").cast("int")).over(whole))
    block = F.col("_within") & (F.coalesce(own, F.lit(0)) == 1) & (head == 1)
    line = ~F.col("_inside") & F.coalesce(F.col("_bare").startswith(F.col("_m1")), F.lit(False)) & ~(F.col("_bare").startswith("#!") & (F.col("line_no") == 1))
    kind = F.when(md, "prose").when(block | line, "prose").when((F.trim("_body") == "") & ~F.col("_within"), "layout").otherwise("code")
    mark = F.when(md, "md").when(block, "block").when(line, F.concat(F.length("_body") - F.length("_bare"), F.lit(":"), F.col("_m1")))
    rows = rows.withColumns({"kind": kind, "_mark": F.coalesce(mark, F.lit(""))})
    fresh = F.coalesce((F.col("kind") != F.lag("kind").over(w)) | (F.col("_mark") != F.lag("_mark").over(w)) | ((F.col("_mark") == "block") & F.col("_begins")), F.lit(True))
    rows = rows.withColumn("segment_no", F.sum(fresh.cast("int")).over(w))
    out = rows.groupBy(key, "segment_no").agg(
        F.first("kind").alias("kind"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "").alias("_raw"), F.first((F.col("kind") == "prose") & ~md).alias("_comment"),
    )
    # Comments alone are cleaned; the other texts are as they are, one run.
    out = out.withColumn("_m", maps.made(F.when(F.col("_comment"), F.col("_raw")), "comment"))
    plain = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.octet_length("_raw").cast("long").alias("end"), F.lit(0).cast("long").alias("src"), F.octet_length("_raw").cast("long").alias("src_end")))
    runs = F.transform(F.when(F.col("_comment"), F.col("_m.runs")).otherwise(plain), lambda r: F.struct(r["at"].alias("at"), r.end.alias("end"), (r.src + F.col("start_byte")).alias("src"), (r.src_end + F.col("start_byte")).alias("src_end")))
    return out.select(key, "segment_no", "kind", "start_line", "end_line", "start_byte", "end_byte", F.when(F.col("_comment"), F.col("_m.text")).otherwise(F.col("_raw")).alias("text"), runs.alias("runs"))


def directives(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Directives outside literal regions: key, line_no, name, arguments, inline, request_no (from 1, by place in the file), start_byte, end_byte.

    One alone on its line, at most three spaces in, is a block; others are inline. In fenced code,
    raw HTML, tags and code spans, and behind a backslash, they are text. Files without an opening
    tag aren't looked at; nothing of a file but its directives leaves its row.
    """
    tags = tags_of(DIRECTIVE)(F.col(text))
    rows = files.where(F.col(text).contains("{%")).select(key, F.posexplode(tags).alias("_i", "t"))
    return rows.select(key, F.col("t.line_no").alias("line_no"), F.col("t.name").alias("name"), F.col("t.arguments").alias("arguments"), (~F.col("t.alone")).alias("inline"), (F.col("_i") + 1).alias("request_no"), F.col("t.start").alias("start_byte"), F.col("t.end").alias("end_byte"))


#: A name and equals sign, if any, and a value: a JSON string, one in single quotes, a JSON array, or a bare scalar.
ARGUMENT = r"""(?<![^ \t])(?:([a-z][a-z0-9_-]*)[ \t]*=[ \t]*)?("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\['\\])*'|\[(?:[^\[\]"]|"(?:[^"\\]|\\.)*"|\[[^\[\]]*\])*\]|[^\s"'\[\]=]+)(?![^ \t])"""
NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
SAFE = float((1 << 53) - 1)
#: What is JSON at sight: strings without escapes, short lists of small numbers.
PLAIN_STRING = r'"[^"\\\x00-\x1f]{0,1000}+"'
PLAIN = rf"(?:{PLAIN_STRING}|\[(?:(?:0|[1-9][0-9]{{0,8}})(?:, ?(?:0|[1-9][0-9]{{0,8}})){{0,8}})?\])"


def arguments(text: Column) -> Column:
    """A directive's arguments: struct positional (array), named (map), error; values are JSON text, null without error.

    Strings come as JSON strings, whatever their quotes; scalars are numbers, booleans and null.
    Errors: invalid_arguments (what is no argument, a bare word, a number that doesn't carry over,
    a string or array that is no JSON), positional_after_named, duplicate_argument. With an error,
    there are no arguments.
    """
    inner = lambda v: F.substring(v, F.lit(2), F.length(v) - 2)
    single = lambda v: F.to_json(F.struct(F.regexp_replace(inner(v), r"\\(['\\])", "$1").alias("v")))
    as_json = lambda v: F.when(v.startswith("'"), F.regexp_replace(single(v), r'^\{"v":|\}$', "")).otherwise(v)

    def legal(v: Column) -> Column:
        number = v.cast("double")
        scalar = v.isin("true", "false", "null") | (v.rlike(f"^{NUMBER}$") & (F.abs(number) < float("inf")) & ((number != F.floor(number)) | (F.abs(number) <= SAFE)))
        return F.when(v.rlike(f"^{PLAIN}\\z"), True).when(v.rlike("^'"), ~v.rlike(r"[\x00-\x1f]")).when(v.rlike(r'^["\[]'), F.try_parse_json(v).isNotNull()).otherwise(scalar)

    item = "struct<key:string,value:string>"

    def checked(pairs: Column, rest: Column) -> Column:
        """From the pairs alone, which are extracted once."""
        start = F.struct(F.lit(False).alias("named"), F.lit(False).alias("late"), F.lit(True).alias("legal"))
        seen = F.aggregate(pairs, start, lambda acc, p: F.struct((acc.named | (p.key != "")).alias("named"), (acc.late | (acc.named & (p.key == ""))).alias("late"), (acc.legal & F.coalesce(legal(p.value), F.lit(False))).alias("legal")))
        keys = F.transform(F.filter(pairs, lambda p: p.key != ""), lambda p: p.key)
        error = lambda s: (
            F.when(rest.rlike(r"[^ \t]") | ~s.legal, "invalid_arguments")
            .when(s.late, "positional_after_named")
            .when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_argument")
        )
        return F.transform(F.array(seen), lambda s: F.struct(pairs.alias("pairs"), error(s).alias("error")))[0]

    def shown(found: Column) -> Column:
        given = F.when(found.error.isNull(), F.transform(found.pairs, lambda p: F.struct(p.key.alias("key"), as_json(p.value).alias("value"))))
        none = F.array().cast(f"array<{item}>")
        named = F.filter(F.coalesce(given, none), lambda p: p.key != "")
        return F.struct(F.transform(F.filter(given, lambda p: p.key == ""), lambda p: p.value).alias("positional"), F.when(found.error.isNull(), F.map_from_entries(named)).alias("named"), found.error.alias("error"))

    # Each step takes the last one's value as the variable of a one-item array, so it is computed once.
    whole = F.regexp_extract_all(text, F.lit(ARGUMENT), F.lit(0))
    split = lambda m: F.struct(F.regexp_extract(m, ARGUMENT, 1).alias("key"), F.regexp_extract(m, ARGUMENT, 2).alias("value"))
    raw = F.array(F.struct(F.transform(whole, split).alias("pairs"), F.regexp_replace(text, ARGUMENT, "").alias("rest")))
    parsed = F.transform(F.transform(raw, lambda r: checked(r.pairs, r.rest)), shown)[0]
    # Most often there is one plain string, which needs no parser.
    alone = F.struct(F.array(text).alias("positional"), F.create_map().cast("map<string,string>").alias("named"), F.lit(None).cast("string").alias("error"))
    return F.when(text.rlike(rf"^{PLAIN_STRING}\z"), alone).otherwise(parsed)


def plain(value: Column) -> Column:
    """The text of a JSON string; other values as they are."""
    return F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]")).otherwise(value)


def path_steps(path: str) -> list[str | int]:
    """Steps of a path expression, ``a.b.0`` or ``["a", 0, "b"]``: names, each with a number after it or none.

    ValueError if it is empty, begins with a number, has two numbers in a row, or one that isn't
    a whole number from 0 to 2^53 - 1.
    """
    parts = json.loads(path) if path.startswith("[") else [int(x) if re.fullmatch("[0-9]+", x) else x for x in path.split(".")]
    steps: list[str | int] = []
    for x in parts:
        number = isinstance(x, int | float) and not isinstance(x, bool)
        if number and (x != int(x) or not 0 <= x < 1 << 53 or not steps or isinstance(steps[-1], int)) or not number and (not isinstance(x, str) or not x and not path.startswith("[")):
            raise ValueError(f"invalid_arguments: {path!r} is no path")
        steps.append(int(x) if number else x)
    if not steps:
        raise ValueError("invalid_arguments: an empty path")
    return steps


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags; entities stay; blanks collapse."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def headings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """HTML headings: key, heading_no, level, title."""
    pattern = r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1\s*>"
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("level"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("title"))
    rows = pages.select(key, F.posexplode(both).alias("heading_no", "h"))
    return rows.select(key, "heading_no", F.col("h.level").cast("int").alias("level"), visible_text(F.col("h.title")).alias("title"))


def entities(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Declarations at the start of lines: key, line_no, language, kind, name. By patterns, one for each family of languages."""
    pattern = r"^[ \t]*(?:pub(?:\([a-z]+\))? |export |default |async |static |abstract |public |private )*(fn|def|class|struct|enum|trait|interface|type|func|function|let|const|module|mod|namespace)[ \t]+(?:rec[ \t]+|\([^)]*\)[ \t]*)?([A-Za-z_$][A-Za-z0-9_$']*)"
    rows = lines(files, key, text).withColumn("name", F.regexp_extract("line", pattern, 2)).where("name != ''")
    return rows.select(key, "line_no", language(F.col(key)).alias("language"), ascii_lower(F.regexp_extract("line", pattern, 1)).alias("kind"), "name")


def sibling_index(rows: DataFrame, parent: str, name: str, order: str) -> DataFrame:
    """Rows with ``sibling``: 0-based among those of one parent and name."""
    return rows.withColumn("sibling", F.row_number().over(Window.partitionBy(parent, name).orderBy(order)) - 1)


def leaves(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Prose leaves of Markdown: key, leaf_no, kind (heading, code, paragraph), start_byte, end_byte, text.

    Leaves are runs of lines that aren't blank; a fenced block is one, a heading too. Lines that
    are only anchors belong to no leaf.
    """
    rows = lines(files, key, text)
    w = Window.partitionBy(key).orderBy("line_no")
    heading = ~F.col("in_code") & F.col("line").rlike(HEADING)
    blank = ~F.col("in_code") & (F.trim(F.regexp_replace("line", r"\s", "")).eqNullSafe("") | F.col("line").rlike(ANCHOR))
    rows = rows.withColumn("kind", F.when(blank, "blank").when(F.col("in_code"), "code").when(heading, "heading").otherwise("paragraph"))
    fresh = F.coalesce(F.col("kind") != F.lag("kind").over(w), F.lit(True)) | heading
    rows = rows.withColumn("_leaf", F.sum(fresh.cast("int")).over(w)).where("kind != 'blank'")
    out = rows.groupBy(key, "_leaf").agg(F.first("kind").alias("kind"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "").alias("text"))
    return out.withColumn("leaf_no", F.row_number().over(Window.partitionBy(key).orderBy("_leaf")) - 1).drop("_leaf")


def open_fences(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Markdown whose last fence isn't closed: key, line_no of that fence."""
    return files.select(key, once(fences(F.col(text)).getField("open_line")).alias("line_no")).where("line_no IS NOT NULL")


def selected(tree: DataFrame, steps: list[str | int], key: str = "path") -> DataFrame:
    """Nodes (node, parent, name, start_byte) reached by a path of names and sibling numbers: key, node, error.

    Each step is a join on the parent; a number picks among what the name before it found. Errors
    are rows: selection_not_found, selection_ambiguous, selection_out_of_bounds.
    """
    at = tree.select(key).distinct().withColumns({"node": F.lit(None).cast(tree.schema["node"].dataType), "error": F.lit(None).cast("string")})
    names = [(s, steps[i + 1] if i + 1 < len(steps) and isinstance(steps[i + 1], int) else None) for i, s in enumerate(steps) if isinstance(s, str)]
    for name, number in names:
        found = tree.where(F.col("name") == name).select(F.col(key).alias("_key"), F.col("parent").alias("_parent"), F.col("node").alias("_node"), F.col("start_byte").alias("_start"))
        stats = found.groupBy("_key", "_parent").agg(F.count("*").alias("_n"), F.min_by("_node", "_start").alias("_first")) if number is None else found.withColumns({"_n": F.count("*").over(Window.partitionBy("_key", "_parent")), "_i": F.row_number().over(Window.partitionBy("_key", "_parent").orderBy("_start")) - 1}).groupBy("_key", "_parent").agg(F.first("_n").alias("_n"), F.max(F.when(F.col("_i") == number, F.col("_node"))).alias("_first"))
        joined = at.join(stats, (at[key] == stats["_key"]) & at["node"].eqNullSafe(stats["_parent"]), "left")
        error = F.when(F.col("_n").isNull(), "selection_not_found").when(F.lit(number is None) & (F.col("_n") > 1), "selection_ambiguous").when(F.col("_first").isNull(), "selection_out_of_bounds")
        at = joined.select(key, F.when(F.col("error").isNull() & error.isNull(), F.col("_first")).alias("node"), F.coalesce("error", error).alias("error"))
    return at
