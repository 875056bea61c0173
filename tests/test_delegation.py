import json

from quillon.operators import delegation

FILES = {"a.md": "# One\n\nx\n\n## Two\n\ny\n\n# Two\n", "b/c.py": "l1\nl2\n\n```\n", "empty.md": " \n"}


def run(spark, contents, page="pages/p/q.md"):
    rows = [(i, page, c if c is None or isinstance(c, str) else json.dumps(c)) for i, c in enumerate(contents)]
    results = spark.createDataFrame(rows, "request int, page string, content string")
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    got = delegation.delegated(results, files, files.select("path"))
    return {r["request"]: (r["markdown"], r["error"], r["nodes"]) for r in got.collect()}


def text(s):
    return {"kind": "text", "markdown": s}


def call(directive, arguments):
    return {"kind": "standard_call", "directive": directive, "arguments": arguments}


def test_delegated(spark):
    got = run(spark, [
        [text("A"), call("include", '"b/c.py" lines=[1, 2]'), call("link", '"a.md"'), text("B")],
        [call("include", '"a.md" id=["One","Two"]')],
        [call("include", '"b/c.py"')],
        [call("include", "\'a.md\' id=\'One\'")],
        [text(" "), call("include", '"a.md" id="Two"'), call("link", '"z.md"')],
        [call("include", '"no.md"'), text("kept")],
        [call("include", '"b/c.py" lines=[2, 9]')], [call("include", '"empty.md"')], [text(" "), text("\n")], [], None, "{}", "[",
        [call("other", '"a.md"')], [{"kind": "html", "markdown": "x"}], [{"kind": "text"}], [None],
    ])
    assert got == {
        0: ("A\n\n```python\nl1\nl2\n```\n\n../a.md.md\n\nB", None, 4), 1: ("## Two\n\ny\n\n", None, 1), 2: ("````python\nl1\nl2\n\n```\n````", None, 1), 3: ("# One\n\nx\n\n## Two\n\ny\n\n", None, 1),
        4: (None, "content[1]: selection_ambiguous", 3), 5: (None, "content[0]: source_error", 2), 6: (None, "content[0]: invalid_range", 1), 7: (None, "content[0]: empty_selection", 1), 8: (None, "empty_content", 2),
        9: (None, "content[0]: empty_content", 1), 10: (None, "content[0]: invalid_content", 1), 11: (None, "content[0]: invalid_content", 1), 12: (None, "content[0]: invalid_content", 1),
        13: (None, "content[0]: unknown_directive", 1), 14: (None, "content[0]: unknown_kind", 1), 15: (None, "content[0]: empty_content", 1), 16: (None, "content[0]: unknown_kind", 1),
    }


def test_shapes_of_calls(spark):
    wrong = ["", "1", '"a.md" "b"', '"a.md" lines=1', '"a.md" lines=[1]', '"a.md" lines=[1, 2.5]', '"a.md" lines=[1, 2] id="One"', '"a.md" id=[]', '"a.md" id=1', '"a.md" id=[1]', '"a.md" other=1', "a.md"]
    got = run(spark, [[call("include", a)] for a in wrong] + [[call("link", '"a.md" id="One"')], [call("link", None)]])
    assert [got[i][1] for i in range(len(got))] == ["content[0]: invalid_arguments"] * (len(wrong) + 2)


def test_dependencies_and_navigation(spark):
    rows = [("r", "pages/p.md", json.dumps([call("include", '"no.md"'), call("include", '"no.md" lines=[1, 2]'), call("link", '"a.md"'), call("link", "1"), text("x")]))]
    results = spark.createDataFrame(rows, "request string, page string, content string")
    assert sorted(map(tuple, delegation.dependencies(results).collect())) == [("r", "a.md", "page"), ("r", "no.md", "source")]
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    asked = spark.createDataFrame([("d1", "pages/x/y.md")], "request string, page string")
    for requests, n in ((asked, 3), (asked.limit(0), 2)):
        plugin = delegation.navigation(requests, "empty.md" if n == 2 else "a.md", "b/c.py")
        got = {r["request"]: r["markdown"] for r in delegation.delegated(plugin, files, files.select("path")).collect()}
        assert len(got) == n and got["append:b/c.py"] == "c.py.md" and got["report:overview"] == "../../pages/b/c.py.md"
    assert sorted(r["place"] for r in delegation.navigation(asked, "a.md", "b/c.py").collect()) == ["append", "report", "result"]
