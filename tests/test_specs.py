import hashlib

from pyspark.sql import functions as F

from quillon.functions.text import joined_path
from quillon.operators import clauses, lint

A = '<a id="spec-aa-001"></a>\n## SPEC-AA-001 First\n\nBody.\n'


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_joined_path(spark):
    cases = [("a/b/", "../c.md", "a/c.md"), ("", "./x", "x"), ("a/", "../../x", None), ("a//b", ".", "a/b"), ("a", "..", ""), ("", "a/../../b", None), ("", "", ""), (None, "x", None)]
    df = spark.createDataFrame(cases, "folder string, path string, want string")
    assert df.where(~joined_path(F.col("folder"), F.col("path")).eqNullSafe(F.col("want"))).count() == 0


def test_links(spark):
    texts = {
        "d/a.md": "[x](b.md) and [y](<../c%20d.md#spec-aa-001>)\n```\n[no](z.md)\n```\n[u](https://h/x) [m](mailto:a@b) [t]({% link %}) [s](#spec-b)\n[out](../../o)\n[p](a+b%zz.md)",
        "null.md": None, "none.md": "text (x) [y]\n",
    }
    got = rows(lint.links(files(spark, texts)).drop("path").withColumn("to", F.coalesce("to", F.lit("-"))).withColumn("anchor", F.coalesce("anchor", F.lit("-"))))
    assert got == [
        (1, "../c%20d.md#spec-aa-001", "c d.md", "spec-aa-001"), (1, "b.md", "d/b.md", "-"), (5, "#spec-b", "d/a.md", "spec-b"), (6, "../../o", "-", "-"), (7, "a+b%zz.md", "d/a+b%zz.md", "-"),
    ]


def test_a_sound_tree_has_no_findings(spark):
    texts = {"a.md": A + "[b](d/b.md) [dir](d) [self](#spec-aa-001) [png](i.png)\n", "d/b.md": "See SPEC-AA-001, [it](../a.md#spec-aa-001) and [other](../a.md#plain).\n", "n.md": None}
    assert lint.findings(files(spark, texts), spark.createDataFrame([("i.png",)], "path string")).count() == 0
    assert lint.findings(files(spark, texts).limit(0)).count() == 0


def test_findings(spark):
    texts = {
        "a.md": A, "b.md": A + A, "c.md": "## SPEC-BB-002\n\nSPEC-CC-003 and XSPEC-DD-0041\n", "d.md": "\n[a](a.md#spec-zz)\n[b](no.md)\n[c](../up.md)\n[d](x.png#spec-q)\n",
        "e.md": "```\n## SPEC-EE-005\n```\n### SPEC-BB-002\n", "f.md": None,
    }
    got = lint.findings(files(spark, texts), spark.createDataFrame([("x.png",)], "path string"))
    assert rows(got.withColumn("line_no", F.coalesce("line_no", F.lit(0)))) == [
        ("b.md", 0, "definition_anchor", "SPEC-AA-001"), ("b.md", 0, "definition_anchor", "SPEC-AA-001"), ("b.md", 0, "duplicate_definition", "SPEC-AA-001"), ("b.md", 0, "duplicate_definition", "SPEC-AA-001"),
        ("c.md", 0, "definition_anchor", "SPEC-BB-002"), ("c.md", 0, "undefined_clause", "SPEC-CC-003"), ("c.md", 0, "undefined_clause", "SPEC-DD-004"), ("d.md", 2, "missing_anchor", "a.md#spec-zz"), ("d.md", 3, "broken_link", "no.md"), ("d.md", 4, "broken_link", "../up.md"),
        ("e.md", 0, "undefined_clause", "SPEC-EE-005"),
    ]


def test_resolved(spark):
    defined = clauses.definitions(files(spark, {"a.md": A, "b.md": "## SPEC-BB-002\n", "c.md": '<a id="spec-cc-003"></a>\n## SPEC-CC-003\n', "d.md": "## SPEC-CC-003\n"}))
    asked = spark.createDataFrame([(i, c) for i, c in enumerate(["SPEC-AA-001", "SPEC-BB-002", "SPEC-CC-003", "SPEC-DD-004", "aa", None, "SPEC-AA-001"])], "n int, clause string")
    got = {r["n"]: (r["definition"] and r["definition"]["path"], r["error"]) for r in clauses.resolved(asked, defined).collect()}
    assert got == {0: ("a.md", None), 1: (None, "clause_invalid_definition"), 2: (None, "clause_ambiguous"), 3: (None, "clause_not_found"), 4: (None, "invalid_arguments"), 5: (None, "invalid_arguments"), 6: ("a.md", None)}


def _assembled(spark, sites=(), tests=(), rows_=(), text="t"):
    return clauses.assembled(
        spark.createDataFrame([("c", text)], "clause string, text string"), spark.createDataFrame(list(sites), "clause string, path string, text string"),
        spark.createDataFrame(list(tests), "clause string, path string, name string, text string"), spark.createDataFrame(list(rows_), "clause string, row_no int, text string"),
    ).head()


def test_records_and_fingerprints(spark):
    s, t, r = [("c", "a.rs", "x"), ("c", "a.rs", "x"), ("z", "a.rs", "x")], [("c", "t.rs", "one", "y"), ("c", "t.rs", "two", None)], [("c", 1, "| a |")]
    full = _assembled(spark, s, t, r)
    assert full.asDict() == {"clause": "c", "sites": 2, "tests": 1, "unresolved": 1, "rows": 1, "state": "complete", "fingerprint": full["fingerprint"]}
    assert _assembled(spark, s[::-1], t[::-1], r)["fingerprint"] == full["fingerprint"]
    assert _assembled(spark, [*s, ("c", "b.rs", None)], t, r)["fingerprint"] == full["fingerprint"]  # no code at that place
    others = [_assembled(spark, s[1:], t, r), _assembled(spark, s, t[:1], r), _assembled(spark, s, t, [("c", 2, "| a |")]), _assembled(spark, s, t, r, "u"), _assembled(spark, [("c", "a.r", "sx"), *s[1:]], t, r)]
    assert len({full["fingerprint"], *(o["fingerprint"] for o in others)}) == 6
    assert [_assembled(spark)["state"], _assembled(spark, s)["state"], _assembled(spark, s, t)["state"]] == ["unsited", "untested", "unaccepted"]


def test_fingerprints_of_a_large_key(spark):
    df = spark.range(20_000).select(F.lit("k").alias("clause"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    digests, parts = sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(20_000)), {}
    for d in digests:
        parts.setdefault(d[:2], []).append(d)
    want = hashlib.sha256("".join(hashlib.sha256("".join(p).encode()).hexdigest() for p in parts.values()).encode()).hexdigest()
    assert clauses.fingerprints(df, prefix=2).head()["fingerprint"] == want
