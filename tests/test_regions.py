from pyspark.sql import functions as F

from quillon.operators import regions, structure
from quillon.operators.rounds import fragment_error


def found(text):
    data = text.encode()
    return [(data[a:b].decode(), kind, closed) for a, b, kind, closed in regions.literal_regions(data)]


def test_regions():
    assert found("a `b` c") == [("`b`", "code", True)]
    assert found("a ``b ` c`` d `open") == [("``b ` c``", "code", True)]
    assert found("a `b\n\nc` d") == [] and found("a `b\nc` d") == [("`b\nc`", "code", True)]
    assert found("x <b title='`'>y</b> `z`") == [("<b title='`'>", "html", True), ("</b>", "html", True), ("`z`", "code", True)]
    assert found("```py\na\n````\nb") == [("```py\na\n````\n", "fence", True)] and found("~~~\n```\n") == [("~~~\n```\n", "fence", False)]
    assert found("<script>\n\nx\n</script> rest\ny") == [("<script>\n\nx\n</script> rest\n", "html", True)]
    assert found("<!-- a\n\nb") == [("<!-- a\n\nb", "html", False)] and found("<!-- a --> `b`\n") == [("<!-- a --> `b`\n", "html", True)]
    assert found("<div>\n`a`\n\n`b`") == [("<div>\n`a`\n", "html", True), ("`b`", "code", True)]
    assert found("text\n<div>\nx\n\ny") == [("<div>\nx\n", "html", True)] and found("text\n<x-y>\n") == [("<x-y>", "html", True)] and found("<x-y>\nz\n") == [("<x-y>\nz\n", "html", True)]
    assert found(r"\`a` \<b> `c`") == [("` \\<b> `", "code", True)] and found("") == [] and found("\n\n") == []
    assert all(a[1] <= b[0] for t in ("`a` <b> `c`\n\n```\nx\n```\n<p>\n",) for a, b in zip(list(regions.literal_regions(t.encode())), list(regions.literal_regions(t.encode()))[1:], strict=False))


def test_directives_in_regions_are_text(spark):
    texts = {
        "code": "`{% a %}` and {% b 1 %}", "html": "<div>\n{% a %}\n\n{% b 1 %}\n", "tag": 'x <i title="{% a %}"> {% b 1 %}', "fence": "```\n{% a %}\n```\n{% b 1 %}\n", "comment": "<!-- {% a %}\n\n{% c %} -->\n{% b 1 %}",
        "escaped": r"\{% a %} \\{% b 1 %}", "opaque": '{% b "`" %} and `{% a %}`', "spans lines": "`x\n{% a %}` {% b 1 %}", "open": "<!-- {% a %}", "none": "{ % a %}", "crlf": "é {% b 1 %}\r\n  {% b 2 %}\r\n",
    }
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {}
    for r in structure.directives(files).orderBy("path", "request_no").collect():
        got.setdefault(r["path"], []).append((r["name"], r["line_no"], r["inline"]))
        assert texts[r["path"]].encode()[r["start_byte"] : r["end_byte"]].startswith(b"{% b")
    assert got == {
        "code": [("b", 1, True)], "html": [("b", 4, False)], "tag": [("b", 1, True)], "fence": [("b", 4, False)], "comment": [("b", 4, False)], "escaped": [("b", 1, True)],
        "opaque": [("b", 1, True)], "spans lines": [("b", 2, True)], "crlf": [("b", 1, True), ("b", 2, False)],
    }


def test_open_regions_are_errors(spark):
    cases = {"<!-- a": "open_html", "```\na": "open_fence", "<script>\n\n": "open_html", "<div>\na": None, "a <!-- b": None, "<pre>x</pre>": None, None: None, "x": None, "~~~\n~~~\n<?a": "open_html"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["e"] for r in rows.select("t", regions.open_region(F.col("t")).alias("e")).collect()} == cases
    got = rows.select("t", fragment_error(F.col("t"), F.lit(1), F.lit(True), F.lit(False)).alias("e")).collect()
    assert {r["t"]: r["e"] for r in got} == cases | {None: "empty"}
