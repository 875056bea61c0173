from pyspark.sql import functions as F

from quillon.functions import hashing
from quillon.functions import text as t


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_query_terms():
    assert t.query_terms("Water soil water") == ["soil", "water"]
    assert t.query_terms("春天播种时节") == sorted(["春天", "天播", "播种", "种时", "时节"])
    assert t.query_terms("春") == ["春"]
    assert t.query_terms("src/A.rs x") == ["src/a.rs", "x"]
    assert t.query_terms("...") == []
    assert t.query_terms("ab春天c") == ["ab", "c", "春天"]


def test_words_split_at_han(spark):
    assert one(spark, "foo_bar春天x, Éa", t.words) == ["foo_bar", "春天", "x", "Éa"]


def test_matches(spark):
    cases = [("fn WaterTank() {}", "tank", True), ("fn WaterTank() {}", "ate", False), ("fn soil_depth() {}", "depth", True), ("watertank", "watertank", True), ("秋天收获，冬天休息", "收获", True), ("HTTPServer", "server", True), ("HTTPServer", "http", True), ("a/b", "a/b", True), ("x a/b", "a/b", False), ("Ärger", "ärger", False)]
    for text, term, want in cases:
        assert one(spark, text, lambda x, term=term: t.matches(x, term)) is want, (text, term)


def test_snippet_lines_fences(spark):
    assert one(spark, "x" * 300, lambda x: t.snippet(x, F.lit(290))) == "x" * 240
    assert one(spark, "abc", lambda x: t.snippet(x, F.lit(None).cast("int"))) == "abc"
    assert one(spark, "a\r\nb\nc", lambda x: t.line_slice(x, 1, 2)) == "a\r\nb\n"
    assert one(spark, "a\n\nb", t.line_count) == 3
    assert one(spark, "a ```` b", t.fence) == "`````"
    assert one(spark, "a", t.fence) == "```"
    assert one(spark, "`a", t.code_span) == "`` `a ``"
    assert one(spark, "a\r\nb\rc", t.lf) == "a\nb\nc"


def test_paths(spark):
    assert one(spark, "a b/ü~.md", t.percent_encoded) == "a%20b/%C3%BC~.md"
    assert one(spark, "docs/a.md", lambda x: t.relative_url(x, F.lit("docs/sub/b.md"))) == "../a.md"
    assert one(spark, "a.md", lambda x: t.relative_url(x, F.lit("b.md"))) == "a.md"
    assert one(spark, "src-old/a", lambda x: t.under(x, "src")) is False
    assert one(spark, "src/a", lambda x: t.under(x, "src")) is True


def test_long_body_continues_by_bytes(spark):
    body = "甲乙😀" + "a" * 11_997 + "\r\n" + "中文b" * 5000 + "終"
    got = one(spark, body, lambda x: t.byte_slice(x, F.lit(0), 12_000))
    assert (got["start"], got["end"], got["next"], len(got["text"])) == (0, 12_007, 12_007, 12_000)
    parts, at = [], 0
    while at is not None:
        got = one(spark, body, lambda x, at=at: t.byte_slice(x, F.lit(at), 12_000))
        parts.append(got["text"])
        at = got["next"]
    assert "".join(parts) == body


def test_handles():
    import xxhash

    assert xxhash.xxh64_hexdigest(b"", 0) == "ef46db3751d8e999"
    assert [hashing.base62(n) for n in (0, 1, 61, 62, 2**64 - 1)] == ["00000000000", "00000000001", "0000000000z", "00000000010", "LygHa16AHYF"]
    assert hashing.handle("0" * 64, "1" * 64) != hashing.handle("0" * 64, None)


def test_canonical_json(spark):
    rows = ['{"b":1,"a":"é"}', '{"a":1,"a":2}', "9007199254740993", "NaN", None, "[1, 2.5]"]
    got = spark.createDataFrame([(r,) for r in rows], "x string").select(hashing.canonical_json("x")).collect()
    assert [r[0] for r in got] == ['{"a":"é","b":1}', None, None, None, None, "[1,2.5]"]
