import pytest

from quillon.engine import Engine, Stale, read_cursor


@pytest.fixture
def tree(tmp_path):
    """A small gardening project."""
    src = tmp_path / "garden"
    src.mkdir()
    (src / "notes.md").write_text("# Beds\n\n春天播种，秋天收获。\n\n只在秋天浇水。\n\n## Soil\n\nAdd compost, then rest.\n")
    (src / "pump.go").write_text("package pump\nfunc WaterPump() {}\nfunc soil_depth() int { return 3 }\n")
    (src / "timer.py").write_text("# water at dawn\ndef start_timer():\n    return 1\n")
    return src


def test_answers_have_totals_matches_and_exact_hits(spark, tree, tmp_path):
    e = Engine(spark, str(tree), str(tmp_path / "out"))
    snapshot = e.build()
    assert e.build() == snapshot
    got = e.answer("秋天收获")
    assert (got["snapshot"], got["freshness"], got["query_terms"]) == (snapshot, "matched", ["天收", "收获", "秋天"])
    assert (got["total_matches"], got["returned"], got["truncated"]) == (2, 2, False)
    first, second = got["hits"]
    assert (first["terms"], first["snippet"], first["title"]) == (["天收", "收获", "秋天"], "春天播种，秋天收获。\n", "Beds")
    assert [(m["term"], m["field"], m["start"], m["end"]) for m in first["matches"]] == [("天收", "body", 6, 8), ("收获", "body", 7, 9), ("秋天", "body", 5, 7)]
    assert second["terms"] == ["秋天"] and second["snippet"].startswith("只在秋天")
    one = e.answer("秋天", limit=1)
    assert (one["total_matches"], one["returned"], one["truncated"]) == (2, 1, True)
    exact = e.search("waterpump").collect()
    assert [(r["kind"], r["path"], r["exact"]) for r in exact] == [("code", "pump.go", True)]
    parts = e.search("water depth").collect()
    assert (parts[0]["path"], parts[0]["term_count"], parts[0]["exact"]) == ("pump.go", 2, False)
    assert {(m["term"], m["field"], m["text"]) for m in parts[0]["matches"]} >= {("water", "identifier", "WaterPump"), ("depth", "identifier", "soil_depth")}
    assert e.search("epth").count() == 0
    assert e.search("water", path="timer.py").count() == 1 and e.search("water", path="timer").count() == 0


def test_reads_and_freshness(spark, tree, tmp_path):
    e = Engine(spark, str(tree), str(tmp_path / "out"))
    first = e.build()
    handle = e.search("compost").head()["handle"]
    assert e.read(handle).head()["body"]["text"] == "Add compost, then rest.\n"
    assert [r["neighbour"] for r in e.read(handle, context=1).collect()] == [0, 1]
    assert [(r["path"], r["total"], r["next_cursor"]) for r in e.occurrences(handle).collect()] == [("notes.md", 1, None)]
    source = e.sources(handle).collect()
    assert [(r["path"], r["total"], r["next_cursor"]) for r in source] == [("notes.md", 1, None)]
    assert (tree / "notes.md").read_bytes()[source[0]["start_byte"] : source[0]["end_byte"]] == b"Add compost, then rest.\n"
    with pytest.raises(ValueError):
        e.sources(handle, f"{first}:{handle}:occurrences:0")
    with pytest.raises(KeyError):
        e.read("0" * 11)
    for bad in (lambda: e.read("short"), lambda: e.occurrences(handle, "x:y:occurrences:5"), lambda: e.occurrences(handle, f"{first}:{handle}:occurrences:5")):
        with pytest.raises(ValueError):
            bad()
    assert e.read_entity("notes.md", ["Beds", "Soil"]).head()["body"].startswith("## Soil\n")
    (tree / "timer.py").write_text("# changed\n")
    with pytest.raises(Stale):
        e.search("water")
    assert e.answer("water", snapshot=True)["freshness"] == "unchecked"
    assert e.build() != first and e.search("changed").count() == 1
    (tree / "bad.md").write_bytes(b"\xff")
    with pytest.raises(ValueError):
        e.build()


def test_what_is_generated_below_the_source_is_no_input(spark, tree):
    e = Engine(spark, str(tree), str(tree / "site"))
    (tree / "site" / "pages").mkdir(parents=True)
    (tree / "site" / "pages" / "old.md").write_text("# Old\n")
    assert sorted(r["path"] for r in e.files().collect()) == ["notes.md", "pump.go", "timer.py"]


def test_stream_sees_edits_and_removals(spark, tree, tmp_path):
    e, out = Engine(spark, str(tree), str(tmp_path / "o")), str(tmp_path / "facts")
    states = lambda: {r["path"]: r["state"] for r in e.stream(out).collect()}
    assert states() == {"notes.md": "added", "pump.go": "added", "timer.py": "added"}
    assert e.stream(out) is None
    (tree / "pump.go").write_text("package pump\n")
    (tree / "timer.py").unlink()
    (tree / "new.md").write_text("new\n")
    assert states() == {"pump.go": "changed", "timer.py": "removed", "new.md": "added"}


def test_cursor():
    assert read_cursor("s:r:sources:5", "s") == ("r", "sources", 5)
    for bad in ("x:r:sources:5", "s:r:sources:4", "s:r:other:5", "s:r:5"):
        with pytest.raises(ValueError):
            read_cursor(bad, "s")


def test_freshness_reads_only_what_moved_and_sees_settings(spark, tree, tmp_path):
    (tree / "linked.md").symlink_to("notes.md")
    out = str(tmp_path / "out")
    e = Engine(spark, str(tree), out)
    e.build()
    known = spark.read.parquet(f"{out}/snapshot=*/files")
    assert sorted(r["path"] for r in known.collect()) == ["linked.md", "notes.md", "pump.go", "timer.py"]
    assert e.fingerprints(known).selectExpr("sum(n_read)").head()[0] == 0
    (tree / "timer.py").touch()
    assert {r["path"]: r["n_read"] for r in e.fingerprints(known).where("n_read > 0").collect()} == {"timer.py": len("# water at dawn\ndef start_timer():\n    return 1\n")}
    assert {r["component"]: r["changed"] for r in e.freshness().collect()} == {"generator": 0, "settings": 0, "sources": 0}
    (tree / "notes.md").write_text("# Other\n")
    (tree / "pump.go").unlink()
    assert {r["component"]: r["changed"] for r in e.freshness().collect()} == {"generator": 0, "settings": 0, "sources": 3}
    other = Engine(spark, str(tree), out, 'config_version = 1\n[inputs]\nexclude = ["x"]\n')
    with pytest.raises(Stale, match="settings, sources"):
        other.search("water")


def test_a_read_shares_its_budget_and_names_sources(spark, tree, tmp_path, monkeypatch):
    from quillon.operators import search

    e = Engine(spark, str(tree), str(tmp_path / "out"))
    e.build()
    handle = e.search("只在秋天").head()["handle"]
    got = e.read(handle, context=2).collect()
    assert [r["neighbour"] for r in got] == [0, 1, 1, 1, 1] and got[0]["sources"][0]["path"] == "notes.md"
    assert e.search("soil", path="pump.go").head()["path_matches"] == ["input", "source"] and e.search("soil").head()["path_matches"] == []
    monkeypatch.setattr(search, "BUDGET", 12)
    got = e.read(handle, context=2).collect()
    assert [r["body"]["text"] for r in got] == ["只在秋天浇水。\n", "# Be"]
    assert e.read(handle, offset=6).head()["body"]["text"] == "秋天浇水。\n"


def test_a_page_that_would_be_the_folder_of_another_stops_the_round(spark, tree, tmp_path):
    (tree / "notes.md.md").mkdir()
    (tree / "notes.md.md" / "b.md").write_text("# mine\n")
    with pytest.raises(ValueError, match="target_conflict.*parent_of_target"):
        Engine(spark, str(tree), str(tmp_path / "out")).build()


def test_matches_lead_back_to_bodies_and_files(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    guide = "# Plan\n\nWater **the _roses_** &amp; [lilies](http://x.y/roses) at `dawn  x`.\n"
    code = "x = 1\n  // roses grow\r\n  // by the wall\nlet y;\n"
    (src / "guide.md").write_bytes(guide.encode())
    (src / "a.js").write_bytes(code.encode())
    e = Engine(spark, str(src), str(tmp_path / "out"))
    e.build()
    texts = {"guide.md": guide.encode(), "a.js": code.encode()}
    seen = {}
    for r in e.search("roses wall lilies").collect():
        for m in r["matches"]:
            if m["field"] == "body":
                a, b = m["source_range"]["start"], m["source_range"]["end"]
                assert texts[r["path"]][a:b].decode().lower() == m["term"]
                seen.setdefault(r["path"], set()).add(m["term"])
    assert seen == {"guide.md": {"roses", "lilies"}, "a.js": {"roses", "wall"}}
    assert e.search("http").count() == 0 and e.search("x.y/roses").count() == 0  # a link's target is nothing that a reader sees
