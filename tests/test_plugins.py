import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import plugins, project_docs


def test_contracts(spark):
    """A plugin by page is called for each page; one that wants the whole round once, with all inputs, also without a request."""

    def by_page(pdf):
        return pdf.assign(markdown=f"{len(pdf)} on " + pdf["path"].iloc[0], error=None)

    def whole(inputs, requests):
        paths = [r["path"] for batch in inputs for r in batch]
        n = 0
        for batch in requests:
            n += len(batch)
            yield pd.DataFrame({"request_no": [r["request_no"] for r in batch], "markdown": [f"{r['path']} of {len(paths)}: {','.join(paths[:3])}" for r in batch], "error": None})
        yield pd.DataFrame({"request_no": [-n], "markdown": [f"{n} requests"], "error": [None]})

    registry = plugins.Registry()
    registry.add("pages", ["p"], by_page)
    registry.add("all", ["w"], whole, contract="whole")
    registry.add("idle", ["i"], whole, contract="whole")
    with pytest.raises(ValueError):
        registry.add("x", ["x"], whole, contract="some")
    n = 2500
    asked = spark.range(n).select(F.col("id").alias("request_no"), F.when(F.col("id") % 5 == 0, "all").otherwise("pages").alias("owner"), F.concat(F.lit("f"), F.col("id") % 3).alias("path"), F.lit("p").alias("name"), F.lit("").alias("arguments")).repartition(4)
    inputs = spark.createDataFrame([(f"f{i}",) for i in range(7)], "path string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = plugins.run_plugins(asked, registry, inputs=inputs).collect()
        none = plugins.run_plugins(asked.where("false"), registry, inputs=inputs.where("false")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["owner"], r["request_no"], r["markdown"]) for r in got if r["request_no"] <= 0 and "requests" in r["markdown"]) == [("all", -500, "500 requests"), ("idle", 0, "0 requests")]
    rows = [r for r in got if "requests" not in r["markdown"]]
    assert sorted(r["request_no"] for r in rows) == list(range(n))
    assert {r["markdown"] for r in rows if r["owner"] == "all"} == {f"f{i} of 7: f0,f1,f2" for i in range(3)}
    assert sum(int(m.split()[0]) for m in {r["markdown"] for r in rows if r["owner"] == "pages"}) == 2000
    assert sorted((r["owner"], r["markdown"]) for r in none) == [("all", "0 requests"), ("idle", "0 requests")]


def test_project_docs(spark):
    files = [("a", "Cargo.toml", '[package]\nname = "x`y"\nversion = "1.2"\n'), ("a", "src/b.rs", "x\ny"), ("a", "src/a/c.rs", "z\n"), ("a", "src/no.py", "z"), ("b", "Cargo.toml", "not toml"), ("c", "src/d.rs", "")]
    asked = [("a", 1, "package", '["Crate"]'), ("a", 2, "package", None), ("a", 3, "modules", "[]"), ("a", 4, "api", '["Row"]'), ("b", 5, "package", "[]"), ("b", 6, "modules", None), ("c", 7, "package", "[]"), ("c", 8, "modules", '["x"]'), ("c", 9, "api", "[]"), ("c", 10, "other", "[]"), ("c", 11, "package", '["a\\nb"]'), ("c", 12, "modules", "[]")]
    got = project_docs.documented(spark.createDataFrame(asked, "project string, request_no long, directive string, arguments string"), spark.createDataFrame(files, "project string, path string, text string"))
    rows = {}
    for r in got.orderBy("request_no", "part").collect():
        rows.setdefault(r["request_no"], []).append(r["markdown"] if r["error"] is None else r["error"])
    assert rows[1] == ["Crate: `` x`y ``, version ` 1.2 `.\n"] and rows[2] == ["Package: `` x`y ``, version ` 1.2 `.\n"]
    assert rows[3] == ["- ` src/a/c.rs `: 1 source lines.\n", "- ` src/b.rs `: 2 source lines.\n"]
    assert rows[4][1] == '{"positional":["src/model.rs"],"named":{"id":["Row"]}}' and len(rows[4]) == 3
    assert rows[5][0].startswith("project_material: Cargo.toml") and rows[6] == ["project_material: no modules beneath src/"] and rows[7] == ["project_material: no Cargo.toml"]
    assert all(rows[i][0].startswith("project_material") for i in (8, 9, 10, 11)) and rows[12] == ["- ` src/d.rs `: 0 source lines.\n"]
    with pytest.raises(Exception, match="misses the columns"):
        spark.sql("SELECT * FROM project_docs(TABLE(SELECT 1 AS project))").collect()
