import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import maps

SAMPLES = ["", "a", "x\r\ny\rz\n", "// one\r\n//two\n  /// three\n", "# a\n#\n#b", "/** a\n * b é\n *\n * c\n */", "  /* first\n     second\n  third */\n", "(* nested words *)", "/**/", "/*\n\n*/", "/* a\r\n   b */", "# Head\n\nSome *bold* and `co  de` &amp; &eacute; [text](url \"t\") <b>x</b>\n\n```py\nx = `1`\n```\nend", "```\nopen & a", "a ``x ` y`` b <!-- gone --> c &nosuch; \\* d", "snake_case and _em_ and **two** words", "`a\nb` <script>x < y</script> ok 汉字 &#x6c49;"]


def origin(data, edits):
    """For each byte of the edited text the byte it is from, a range for what stands as a whole, None for the rest."""
    out, text, src = [], b"", 0
    for start, end, new, own in [*edits, (len(data), len(data), b"", False)]:
        out += range(src, start)
        text += data[src:start] + new
        out += [(start, end) if own else None] * len(new)
        src = end
    return text, out


def test_every_place_leads_back():
    rng = random.Random(0)
    texts = [s.encode() for s in SAMPLES] + ["".join(rng.choices("ab \n\r`*_#&;é<>!-/[]()", k=60)).encode() for _ in range(300)]
    for data in texts:
        for name, f in maps.EDITS.items():
            edits = f(data)
            assert all(a[1] <= b[0] for a, b in zip(edits, edits[1:], strict=False)) and all(0 <= e[0] <= e[1] <= len(data) for e in edits), (name, data, edits)
            text, runs = maps.edited(data, edits)
            want_text, from_ = origin(data, edits)
            assert text == want_text
            text.decode()
            for p, o in enumerate(from_):
                got = maps.source_range(runs, p, p + 1)
                assert got == ((o, o + 1) if isinstance(o, int) else o), (name, data, p)
            assert (maps.inverted(maps.inverted(runs)) == runs).all()
            again, second = maps.edited(text, maps.lf_edits(text) if name != "lf" else maps.visible_edits(text))
            both = maps.composed(second, runs)
            for p in range(len(again)):
                mid = maps.source_range(second, p, p + 1)
                assert maps.source_range(both, p, p + 1) == (maps.source_range(runs, *mid) if mid else None), (name, data, p)


def test_cleaned_comments():
    clean = lambda s: maps.edited(s.encode(), maps.comment_edits(s.encode()))[0].decode()
    assert clean("// one\r\n//two\n  ///  three\n") == "one\ntwo\n three\n"
    assert clean("# a\n#\n#b") == "a\n\nb"
    assert clean("/** a\n * b\n *\n * c\n */") == "a\nb\n\nc"
    assert clean("  /* first\n     second\n  third */\n") == "first\nsecond\nthird"
    assert clean("(* some words *)") == "some words" and clean("/**/") == "" and clean("/*\n\n*/").strip() == ""


def test_visible_text():
    see = lambda s: maps.edited(s.encode(), maps.visible_edits(s.encode()))[0].decode()
    assert see(SAMPLES[11]) == "Head Some bold and co  de & é text x x = `1`\n end"
    assert see("a ``x ` y`` b <!-- gone --> c &nosuch; \\* d") == "a x ` y b  c &nosuch; * d"
    assert see("snake_case and _em_ and **two** words") == "snake_case and em and two words"
    assert see("`a\nb` <script>x < y</script> ok") == "a b  ok"


def test_columns(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([*SAMPLES, None])], "id int, text string").repartition(3)
    got = {r["id"]: r for r in rows.select("id", maps.made(F.col("text"), "lf", "visible").alias("m")).withColumn("back", maps.source_ranges(F.col("m.runs"), F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"))))).withColumn("inverse", maps.inverse(F.col("m.runs"))).collect()}
    for i, s in enumerate(SAMPLES):
        data = s.encode()
        lf, a = maps.edited(data, maps.lf_edits(data))
        text, b = maps.edited(lf, maps.visible_edits(lf))
        runs = maps.composed(b, a)
        assert got[i]["m"]["text"] == text.decode() and [tuple(r) for r in got[i]["m"]["runs"]] == [tuple(r) for r in runs.tolist()]
        want = maps.source_range(runs, 0, 3)
        assert got[i]["back"][0] == want or tuple(got[i]["back"][0]) == want
        assert [tuple(r) for r in got[i]["inverse"]] == sorted(map(tuple, maps.inverted(runs).tolist()))
    assert got[len(SAMPLES)]["m"]["text"] is None
    calls = spark.createDataFrame([(1, "abcdef", [(4, 5, "", True), (1, 2, "XY", True)]), (2, "abc", [(0, 2, "q", False), (1, 3, "r", False)]), (3, "abc", [(0, 9, "q", False)]), (4, "abc", [(0, 1, "q\n", True)]), (5, "abc", None), (6, None, [])], "id int, text string, e array<struct<start:long,end:long,markdown:string,inline:boolean>>")
    got = {r["id"]: r["s"] for r in calls.select("id", maps.substituted(F.col("text"), F.col("e")).alias("s")).collect()}
    assert got[1]["text"] == "aXYcdf" and [tuple(r) for r in got[1]["runs"]] == [(0, 1, 0, 1), (3, 5, 2, 4), (5, 6, 5, 6)]
    assert [got[i]["error"] for i in (2, 3, 4, 5, 6)] == ["overlap", "out_of_range", "line_break", None, None] and got[5]["text"] == "abc" and got[6]["text"] is None
    assert re and np is not None
