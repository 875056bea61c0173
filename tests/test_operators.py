import pytest
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators import integrity, intervals, plugins, quantiles, records, references, render, rounds, search, structure
from quillon.plans import queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_search_ranks_by_terms_then_exact_then_score(spark):
    docs = spark.createDataFrame([(1, "guide", "orbit only"), (2, "OrbitPlan", "nothing"), (3, "x", "orbit and thrust")], "id int, title string, body string")
    got = search.search(docs, {"title": "title", "body": "body"}, "orbit thrust", ties=("id",)).collect()
    assert [(r["id"], r["term_count"], r["score"]) for r in got] == [(3, 2, 2), (2, 1, 8), (1, 1, 1)]
    exact = search.search(docs, {"title": "title", "body": "body"}, "orbitplan").collect()
    assert [r["exact"] for r in exact] == [True]
    assert search.search(docs, {"body": "body"}, "...").count() == 0
    with pytest.raises(ValueError):
        search.search(docs, {"body": "body"}, " ")
    with pytest.raises(ValueError):
        search.search(docs, {"body": "body"}, "a", limit=101)


def test_reads(spark):
    turns = spark.createDataFrame([("p", i, "k" if i % 3 else "code", "x" * 10) for i in range(6)], "page string, position int, kind string, text string")
    assert rows(search.neighbours(turns, "page", "position", 1).where("position = 0").select("near_position")) == [(1,)]
    assert [r["shown"] for r in search.budgeted(turns, "page", "position", "text", 25).orderBy("position").collect()] == [10, 10, 5, 0, 0, 0]
    page = search.list_page(turns, "page", ["position"], 5)
    assert [(r["position"], r["total"], r["next_offset"]) for r in page.collect()] == [(5, 6, None)]
    with pytest.raises(ValueError):
        search.list_page(turns, "page", ["position"], 3)
    ahead = search.next_of_kind(turns, "page", "position", "kind", "code", "position", within=2)
    assert [r["next_value"] for r in ahead.orderBy("position").collect()] == [None, 3, 3, None, None, None]


def test_records(spark):
    df = spark.createDataFrame([("a", "p", 1), ("a", "q", 1), ("b", "p", 2), (" ", "p", 3)], "body string, page string, at int")
    named = records.with_record_id(df, "body")
    assert rows(records.records(named, ["body"]).select("body", "n_occurrences")) == [("a", 2), ("b", 1)]
    cut = records.positions(df.drop("body"), "page", "at", width=2)
    assert rows(cut) == [("p", 1, 0), ("p", 2, 1), ("p", 3, 2), ("q", 1, 0)]
    ids = records.occurrence_ids(df, "page", "at", F.substring("page", 1, 1)).orderBy("page", "at")
    assert [r["occurrence_id"] for r in ids.collect()] == ["o0", "o1", "o2", "o3"]
    runs = records.mapping_runs(spark.createDataFrame([("k", i, i + (5 if i < 3 else 9)) for i in range(6)], "k string, b int, s int"), "k", "b", "s")
    assert rows(runs) == [("k", 0, 3, 5, 8), ("k", 3, 6, 12, 15)]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 10), ("a", 1, 2), ("b", 0, 1)], "k string, s int, e int")
    assert rows(intervals.union_of(df, "k", "s", "e")) == [("a", 0, 7, 3), ("a", 9, 10, 1), ("b", 0, 1, 1)]
    points = spark.createDataFrame([("a", i) for i in range(11)], "k string, at int")
    got = intervals.containing(points, df, "k", "at", "s", "e", 4)
    want = sorted((p, s) for p in range(11) for s, e in [(0, 5), (5, 7), (9, 10), (1, 2)] if s <= p < e)
    assert sorted((r["at"], r["s"]) for r in got.collect()) == want


def test_capped_bursts_end_by_quiet_or_length(spark):
    ms = [0, 90, 180, 270, 360, 450, 540, 630, 720, 810, 900, 990, 1080, 1300]
    df = spark.createDataFrame([("p", m / 1000) for m in ms], "k string, s double").select("k", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    got = rows(intervals.capped_bursts(df, "k", "ts", 100_000, 1_000_000).select("first_us", "last_us", "n"))
    assert got == [(0, 990_000, 12), (1_080_000, 1_080_000, 1), (1_300_000, 1_300_000, 1)]


def test_capped_bursts_of_a_hot_key_are_no_lists(spark, capsys):
    import random

    r = random.Random(4)
    events = [("hot", t) for t in range(0, 40_000, 7)] + [("hot", 14)] * 3 + [(None, 5), (None, 700), ("far", -9_000), ("far", None)]
    events += [(f"k{i % 9}", r.randrange(-5_000, 5_000)) for i in range(900)]
    want = []
    for k in {k for k, _ in events}:
        last = first = None
        for t in sorted(t for e, t in events if e == k and t is not None):
            if first is None or t - last >= 60 or t - first >= 160:
                first = t
                want.append([k, t, t, 0])
            last = t
            want[-1][2:] = [t, want[-1][3] + 1]
    df = spark.createDataFrame(events, "k string, us long").select("k", F.timestamp_micros("us").alias("ts"))
    got = intervals.capped_bursts(df, "k", "ts", 60, 160)
    assert sorted(map(repr, (list(x) for x in got.collect()))) == sorted(map(repr, want))
    got.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_exact_quantiles_hold_counts_not_values(spark, capsys):
    inf, nan = float("inf"), float("nan")
    values = {"a": [5.0, -1.5, -0.0, 0.0, 1e300, 3.25, None, 2.0], "b": [7.0], "c": [None], None: [2.0, 4.0], "n": [nan, 1.0, -inf, inf], "t": [1.0] * 99 + [2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    df = df.unionByName(spark.range(5000).selectExpr("'h' AS k", "CAST((id * 7919) % 5003 - 2500 AS double) / 7 AS v"))
    at = {"low": 0.0, "mid": 0.5, "p95": 0.95, "high": 1.0}
    got = {r["k"]: r[1:] for r in quantiles.exact_quantiles(df, "k", "v", at).collect()}
    want = {r["k"]: r[1:] for r in df.groupBy("k").agg(*(F.percentile("v", q).alias(n) for n, q in at.items())).collect()}
    assert got.keys() == want.keys() and got["c"] == (None,) * 4
    for k in want:
        assert [repr(x) if x is None or x != x else pytest.approx(x) for x in want[k]] == [repr(x) if x is None or x != x else x for x in got[k]], k
    queries.QUERIES["percentiles"](spark, "/root/testdata/sf0.001").explain()
    assert "percentile(" not in capsys.readouterr().out


def test_comparisons(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "z"), (3, "y")], "k int, v string")
    assert rows(integrity.compared(a, b, ["k"], ["v"])) == [(1, "same"), (2, "same"), (3, "changed"), (4, "added")]
    assert rows(integrity.set_differences(a, b, "k")) == [(4, "right")]
    assert rows(integrity.closure(a, b.union(b.where("k = 1")), "k")) == [(1, "duplicate"), (2, "ok"), (3, "ok"), (4, "unknown")]
    assert rows(references.reviewed(a, b, "k", "v")) == [(1, "current"), (2, "current"), (3, "stale"), (4, "orphan")]
    h = spark.createDataFrame([("h", "a"), ("h", "b"), ("i", "c"), ("i", "c")], "handle string, target string")
    assert rows(integrity.collisions(h, "handle", "target")) == [("h", 2)]


def test_spans(spark):
    files = spark.createDataFrame([("f", "aé\nb\n")], "path string, text string")
    spans = spark.createDataFrame([("f", 0, 4, 1, 1), ("f", 1, 2, 1, 1), ("f", 4, 9, 2, 2), ("f", 4, 5, 1, 1), ("g", 0, 1, 1, 1), ("f", 4, 6, 2, 2)], "path string, start_byte int, end_byte int, start_line int, end_line int")
    got = rows(integrity.span_errors(spans, files).select("path", "start_byte", "error"))
    assert got == [("f", 1, "invalid_range"), ("f", 4, "invalid_range"), ("f", 4, "wrong_lines"), ("g", 0, "source_error")]


def test_sections_fences_anchors_and_title_paths(spark):
    md = '# A\n\ntext\n```\n# no heading\n```\n<a id="b-1"></a>\n## B ##\n\n### C\n# D\n'
    got = structure.sections(spark.createDataFrame([("x.md", md)], "path string, text string")).orderBy("section_no").collect()
    assert [(r["title"], r["level"], r["anchor"], r["title_path"]) for r in got] == [("A", 1, None, ["A"]), ("B", 2, "b-1", ["A", "B"]), ("C", 3, None, ["A", "B", "C"]), ("D", 1, None, ["D"])]
    assert [md[r["start_byte"] : r["end_byte"]] for r in got][1] == '<a id="b-1"></a>\n## B ##\n\n### C\n'
    assert got[0]["end_byte"] == md.index("# D")


def test_segments_of_comments(spark):
    files = [("a.rs", "// one\n// two\nfn f() {}\n\n  // in\n/* b\n * c\n */\nlet x;\n"), ("b.py", "#!/x\n# hi\nx = 1 # no\n"), ("c.ml", "(* doc *)\nlet a = 1\n"), ("d.md", "# T\n\nx\n")]
    got = structure.segments(spark.createDataFrame(files, "path string, text string")).orderBy("path", "segment_no").collect()
    assert [(r["path"], r["kind"], r["start_line"], r["end_line"]) for r in got] == [
        ("a.rs", "prose", 1, 2), ("a.rs", "code", 3, 3), ("a.rs", "layout", 4, 4), ("a.rs", "prose", 5, 5), ("a.rs", "prose", 6, 8), ("a.rs", "code", 9, 9),
        ("b.py", "code", 1, 1), ("b.py", "prose", 2, 2), ("b.py", "code", 3, 3), ("c.ml", "prose", 1, 1), ("c.ml", "code", 2, 2), ("d.md", "prose", 1, 3),
    ]
    assert got[0]["text"] == "one\ntwo\n" and got[-1]["text"] == "# T\n\nx\n" and got[9]["text"] == "doc" and got[4]["text"] == "b\nc"
    sources = {p: t.encode() for p, t in files}
    for r in got:  # each byte of a text is where its run says
        for run in r["runs"]:
            assert r["text"].encode()[run["at"] : run["end"]] == sources[r["path"]][run["src"] : run["src_end"]]


def test_block_comments_own_their_lines_or_are_code(spark):
    texts = {
        "a.js": "/* a */ x();\ny();\n/* b */\nz();\nx(); /* c\nd */\n/* e\nf */ g();\n/* h */ /* i */\n// j /*\nk();\n/*\n l\n*/\n",
        "b.go": "/* a\n\nb */\nc() // /* d\ne()\n/* open\nf()\n", "c.ts": "/** a\n * // b */\nc;\nu = 'http://x'; /* y */\nv;\n",
        "d.ml": "(* a (* b *)\n c *)\nlet x = 1 (* d\n e *)\n(* f *) let y = 2\n(* g *)\n",
        "e.rs": "/* a */ /* b\nc */\nd;\n/* e */\n/* f */\n",
    }
    got = {}
    for r in structure.segments(spark.createDataFrame(list(texts.items()), "path string, text string")).orderBy("path", "segment_no").collect():
        got.setdefault(r["path"], []).append((r["kind"], r["start_line"], r["end_line"]))
    assert got == {
        "a.js": [("code", 1, 2), ("prose", 3, 3), ("code", 4, 9), ("prose", 10, 10), ("code", 11, 11), ("prose", 12, 14)],
        "b.go": [("prose", 1, 3), ("code", 4, 7)], "c.ts": [("prose", 1, 2), ("code", 3, 5)], "d.ml": [("prose", 1, 2), ("code", 3, 5), ("prose", 6, 6)],
        "e.rs": [("code", 1, 3), ("prose", 4, 4), ("prose", 5, 5)],
    }


def test_directives(spark):
    md = 'x\n\n{% include "a.rs" lines="1-2" %}\n\nsee {% link "b.md" %} and `{% link "no" %}` and \\{% no %}\n```\n{% code %}\n```\n'
    got = structure.directives(spark.createDataFrame([("x.md", md), ("y.md", "none")], "path string, text string")).orderBy("request_no").collect()
    assert [(r["name"], r["inline"], r["line_no"]) for r in got] == [("include", False, 3), ("link", True, 5)]
    args = spark.createDataFrame([(got[0]["arguments"],)], "a string").select(structure.arguments(F.col("a")).alias("x")).first()["x"]
    assert args["positional"] == ['"a.rs"'] and args["named"] == {"lines": '"1-2"'} and args["error"] is None


def test_nested_comments(spark):
    files = spark.createDataFrame([("a.ml", "(* a (* b *)\n   c *)\nlet x = 1\n")], "path string, text string")
    got = structure.segments(files).orderBy("segment_no").collect()
    assert [(r["kind"], r["start_line"], r["end_line"]) for r in got] == [("prose", 1, 2), ("code", 3, 3)]


def test_include_errors_are_rows(spark):
    files = spark.createDataFrame([("f", "a\nb\n\n")], "path string, text string")
    asked = spark.createDataFrame([("f", 1, 2), ("f", 3, 3), ("f", 2, 9), ("g", 1, 1), ("f", None, None)], "path string, first int, last int")
    got = [(r["error"], r["markdown"]) for r in render.included(asked, files).orderBy("path", "first").collect()]
    assert sorted(got, key=str) == sorted([(None, "a\nb\n\n"), (None, "a\nb\n"), ("invalid_range", None), ("empty_selection", None), ("source_error", None)], key=str)


def test_narrative_page(spark):
    line = render.provenance("Source", F.lit("guide.md"), F.lit(1), F.lit(3), F.lit(0), F.lit(43), F.lit("out/pages/guide.md.md"))
    got = spark.range(1).select(line, render.fenced_code(F.lit("fn f() {}"), F.lit("rust"))).first()
    assert got[0] == "> **Source**: [`guide.md:L1-L3`](../../guide.md#L1) · bytes [0,43)"
    assert got[1] == "```rust\nfn f() {}\n```"


def test_plugins(spark, tmp_path):
    registry = plugins.Registry()
    registry.add("core", ["include"], lambda pdf: pdf.assign(markdown="m", error=None))
    with pytest.raises(ValueError):
        registry.add("p", ["include"], lambda pdf: pdf)
    script = tmp_path / "p.py"
    script.write_text("import sys, json\nfor l in sys.stdin:\n  m = json.loads(l)\n  if m['type'] == 'initialize': print(json.dumps({'type': 'ready', 'protocol_version': 1}))\n  else: print(json.dumps({'type': 'result', 'batch_id': m['batch_id'], 'results': [{'id': r['id'], 'status': 'ok', 'markdown': r['arguments'].upper()} for r in m['requests']]}))\n")
    import sys

    registry.add("p", ["include", "shout"], plugins.external([sys.executable, str(script)], "p"), override=("include",))
    asked = spark.createDataFrame([(1, "a.md", "shout", "x"), (2, "a.md", "include", "y")], "request_no long, path string, name string, arguments string")
    routed = references.routed(asked, registry.table(spark)).drop("error")
    assert rows(plugins.run_plugins(routed, registry)) == [(1, "p", "X", None), (2, "p", "Y", None)]


def test_entities(spark):
    files = [("a.rs", "pub fn f() {}\nstruct S;\n"), ("b.py", "class C:\n    def m(self): pass\n"), ("c.go", "func (s *S) Run() {}\n")]
    got = structure.entities(spark.createDataFrame(files, "path string, text string"))
    assert rows(got.select("path", "kind", "name")) == [("a.rs", "fn", "f"), ("a.rs", "struct", "S"), ("b.py", "class", "C"), ("b.py", "def", "m"), ("c.go", "func", "Run")]


def test_leaves_and_open_fences(spark):
    md = "# T\npara\nmore\n\n<a id=\"x\"></a>\n```\na\n\nb\n```\nend\n"
    files = spark.createDataFrame([("x.md", md), ("y.md", "```\nopen\n"), ("z.md", "~~~\n```\n~~~~\n````x\n```\n````\n")], "path string, text string")
    got = structure.leaves(files.where("path = 'x.md'")).orderBy("leaf_no").collect()
    assert [(r["kind"], r["text"]) for r in got] == [("heading", "# T\n"), ("paragraph", "para\nmore\n"), ("code", "```\na\n\nb\n```\n"), ("paragraph", "end\n")]
    assert rows(structure.open_fences(files)) == [("y.md", 1)]


def test_selection(spark):
    tree = spark.createDataFrame([("f", 1, None, "a", 0), ("f", 2, 1, "b", 1), ("f", 3, 1, "b", 5), ("f", 4, 1, "c", 9)], "path string, node int, parent int, name string, start_byte int")
    pick = lambda *steps: tuple(structure.selected(tree, list(steps)).first())
    assert pick("a", "c") == ("f", 4, None) and pick("a", "b", 1) == ("f", 3, None)
    assert pick("a", "b") == ("f", None, "selection_ambiguous") and pick("a", "b", 2) == ("f", None, "selection_out_of_bounds") and pick("x", "b") == ("f", None, "selection_not_found")


def test_affected(spark):
    changes = spark.createDataFrame([("a/b/c",), ("d",)], "path string")
    facts = spark.createDataFrame([(1, "a/b/c", None), (2, "a/b", False), (3, "a", False), (4, "a", True), (5, "d/e/f", None), (6, "a/b/cc", None)], "fact int, path string, recursive boolean")
    assert rows(integrity.affected(changes, facts)) == [(1, "a/b/c"), (2, "a/b/c"), (4, "a/b/c"), (5, "d")]


def test_gate_and_failures(spark):
    reports = spark.createDataFrame([("r", "p"), ("s", "q")], "report string, target string")
    pages = spark.createDataFrame([("p",)], "page string")
    bad, fine = (spark.createDataFrame([(x,)], "severity string") for x in ("error", "note"))
    assert [r["report"] for r in render.gate(bad, reports, pages).collect()] == ["r"] and render.gate(fine, reports, pages).count() == 0
    nodes = spark.createDataFrame([(1, 0, None), (1, 1, "x"), (1, 2, "y"), (2, 0, None)], "r int, n int, e string")
    assert rows(render.first_failures(nodes, "r", "n", "e")) == [(1, "x", 3), (2, None, 1)]


def test_arguments_of_directives(spark):
    cases = {
        "": ([], {}, None),
        """'it"s' "a \\" b" true -1.5e3 [1, "x]"] k="v" l = 'w'""": (['"it\\"s"', '"a \\" b"', "true", "-1.5e3", '[1, "x]"]'], {"k": '"v"', "l": '"w"'}, None),
        "a=1 a=2": (None, None, "duplicate_argument"),
        "a=1 2": (None, None, "positional_after_named"),
        "word": (None, None, "invalid_arguments"),
        "9007199254740993": (None, None, "invalid_arguments"),
        "'open": (None, None, "invalid_arguments"),
        '"a""b"': (None, None, "invalid_arguments"),
        "[1,": (None, None, "invalid_arguments"),
    }
    df = spark.createDataFrame([(x,) for x in cases], "t string")
    for r in df.select("t", structure.arguments(F.col("t")).alias("a")).collect():
        assert (r["a"]["positional"], r["a"]["named"], r["a"]["error"]) == cases[r["t"]], r["t"]


def test_path_expressions():
    assert structure.path_steps("a.b.0") == ["a", "b", 0] and structure.path_steps('["a", 0, "b.c"]') == ["a", 0, "b.c"]
    for bad in ("", "0.a", "a.0.1", "a..b", '["a", 1.5]', '["a", -1]', "[]", '["a", true]'):
        with pytest.raises(ValueError):
            structure.path_steps(bad)


def test_first_ranges_of_terms(spark):
    cases = {"the RetryCount": ("retry", 4, 9), "re-try TRY": ("try", 3, 6), "RETRYNow x": ("now", 5, 8), "entry": ("try", None, None), "去重试": ("重试", 1, 3)}
    for text, (term, a, b) in cases.items():
        got = spark.createDataFrame([(text,)], "t string").select(t.first_range(F.col("t"), term).alias("r"), t.matches(F.col("t"), term).alias("m")).first()
        assert (got["r"] and tuple(got["r"])) == (None if a is None else (a, b)) and got["m"] == (a is not None), text


def test_rounds(spark):
    nodes = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", None), (2, 0, None, "late"), (2, 1, None, "never"), (3, 0, " ", None)], "request int, node int, markdown string, error string")
    assert rows(rounds.evaluated(nodes)) == [(1, "a\n\nb", None, 2), (2, None, "content[0]: late", 2), (3, None, "empty_content", 1)]
    text = spark.createDataFrame([("x", 1), ("", 1), ("\ufeffx", 1), ("a\0", 1), ("x", 0), (" ", 0), ("```\nx", 1)], "m string, n int")
    strict = [r[0] for r in text.select(rounds.fragment_error(F.col("m"), F.col("n"), F.lit(True), F.lit(False))).collect()]
    assert strict == [None, "empty", "byte_order_mark", "nul", "no_sources", "empty", "open_fence"]
    assert text.where("m = ' '").select(rounds.fragment_error(F.col("m"), F.col("n"), F.lit(True), F.lit(True))).first()[0] is None
    pages = spark.createDataFrame([("a",), ("b",)], "page string")
    failed = spark.createDataFrame([("error",)], "severity string")
    assert rows(rounds.removed_pages(pages, pages.where("page = 'a'"), failed.where("false"))) == [("b",)] and not rows(rounds.removed_pages(pages, pages.limit(0), failed))
    runs = spark.createDataFrame([([(0, 2, 10, 12), (5, 7, 20, 29)],)], "r array<struct<field_start:int,field_end:int,body_start:int,body_end:int>>")
    for (a, b), want in {(0, 2): (10, 12), (1, 6): (11, 29), (2, 5): None, (1, 2): (11, 12)}.items():
        got = runs.select(records.raw_range(F.col("r"), F.lit(a), F.lit(b)).alias("x")).first()["x"]
        assert (got and tuple(got)) == want

def test_rows_without_a_page_have_numbers_too(spark):
    from quillon.operators.records import occurrence_ids

    rows = spark.createDataFrame([(None, 1), (None, 2), (1 << 60, 5), ((1 << 60) + 1, 4), (3, 9)], "page long, position_no int")
    got = sorted((r["occurrence_id"], r["page"], r["position_no"]) for r in occurrence_ids(rows, "page", "position_no").collect())
    assert got == [("o0", None, 1), ("o1", None, 2), ("o2", 3, 9), ("o3", 1 << 60, 5), ("o4", (1 << 60) + 1, 4)]
