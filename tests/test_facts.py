import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quillon.sources import facts, resolver


def make(root, tree):
    for name, data in tree.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.symlink_to(data[2:]) if isinstance(data, str) and data.startswith("->") else p.write_text(data)


def test_a_listing_of_files_links_and_folders(spark, tmp_path):
    make(tmp_path, {"a/b/c.txt": "hello", "a/é.md": "x", "l": "->a/b", ".git/x": "no", "top.md": ""})
    for most in (1, 64):
        spark.dataSource.register(facts.FileEntries)
        got = {r["path"]: r for r in spark.read.format("file_entries").option("path", f"file://{tmp_path}").option("skip", ".git").option("folders", most).load().collect()}
        assert set(got) == {"", "a", "a/b", "a/b/c.txt", "a/é.md", "l", "top.md"}
        assert (got["a/b/c.txt"]["n_bytes"], got["a/b/c.txt"]["kind"], got["a/b/c.txt"]["parent"]) == (5, "file", "a/b")
        assert (got["l"]["kind"], got["l"]["target"]) == ("link", "a/b")
        s = os.stat(tmp_path / "top.md")
        assert got["top.md"]["identity"] == f"{s.st_dev}:{s.st_ino}" and got["top.md"]["modified"] == s.st_mtime_ns
    with pytest.raises(Exception, match="none"):
        facts.entries(spark, str(tmp_path / "none")).count()


def test_only_moved_bytes_are_read(spark, tmp_path):
    make(tmp_path, {f"d{i % 7}/f{i}.txt": f"text {i}" for i in range(300)})
    root = str(tmp_path)
    first = facts.fingerprints(facts.entries(spark, root), None, root).cache()
    total = sum(len(f"text {i}") for i in range(300))
    assert first.agg(F.sum("n_read")).first()[0] == total
    assert facts.fingerprints(facts.entries(spark, root), first, root).agg(F.sum("n_read")).first()[0] == 0
    (tmp_path / "d0/f0.txt").write_text("other")
    (tmp_path / "d1/f1.txt").unlink()
    os.rename(tmp_path / "d2/f2.txt", tmp_path / "d2/moved.txt")
    second = {r["path"]: r for r in facts.fingerprints(facts.entries(spark, root), first, root).collect()}
    assert {p for p, r in second.items() if r["n_read"]} == {"d0/f0.txt", "d2/moved.txt"}
    assert second["d0/f0.txt"]["sha256"] == hashlib.sha256(b"other").hexdigest() and "d1/f1.txt" not in second


def test_a_stream_of_changes(spark, tmp_path):
    """New, edited, renamed, removed files and folders that move with all they hold, by changes alone."""
    tree, ck = tmp_path / "in", str(tmp_path / "ck")
    make(tree, {"a/x.txt": "1", "a/deep/y.txt": "2", "b/z.txt": "3"})
    state = {"known": None}

    def step(batch, _):
        batch = batch.cache()
        if state["known"] is None:
            state["known"] = {r["path"]: r["modified"] for r in batch.collect()}
            return
        listing = [(p, os.path.dirname(p), "directory" if (tree / p).is_dir() or not os.path.splitext(p)[1] else "file", m) for p, m in state["known"].items()]
        known = spark.createDataFrame(listing, "path string, parent string, kind string, changed long")
        for r in facts.changed_entries(known, batch).collect():
            if r["state"] == "removed":
                state["known"].pop(r["path"])
            else:
                state["known"][r["path"]] = r["changed"]

    def go():
        import time

        time.sleep(0.1)
        facts.entry_changes(spark, str(tree)).writeStream.foreachBatch(step).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(60)

    def there():
        return {os.path.relpath(os.path.join(d, n), tree) for d, dirs, names in os.walk(tree) for n in dirs + names} | {""}

    go()
    assert set(state["known"]) == there()
    make(tree, {"a/new.txt": "4", "c/w.txt": "5"})
    (tree / "b/z.txt").unlink()
    go()
    assert set(state["known"]) == there()
    os.rename(tree / "a", tree / "c/a")  # what is in it keeps its times
    (tree / "c/w.txt").write_text("6")
    go()
    assert set(state["known"]) == there()


def brute(entries, path):
    """Part by part, as a file system does it: resolved, links, error."""
    done, rest, links = [], [] if path.startswith("/") else [x for x in path.split("/") if x not in ("", ".")], []
    if path.startswith("/"):
        return None, [], "outside_root"
    while rest:
        part, rest = rest[0], rest[1:]
        if part == "..":
            if not done:
                return None, links, "outside_root"
            done = done[:-1]
            continue
        at = "/".join([*done, part])
        if entries.get(at, ("", ""))[0] == "link":
            if len(links) >= 40:
                return None, links, "link_loop"
            links.append(at)
            target = entries[at][1]
            if target.startswith("/"):
                return None, links, "outside_root"
            rest = [x for x in target.split("/") if x not in ("", ".")] + rest
        else:
            done.append(part)
    return "/".join(done), links, None


def test_resolution_against_a_walk(spark):
    import random

    rng = random.Random(5)
    entries = {"": ("directory", None)}
    for a in "abc":
        entries[a] = ("directory", None)
        for b in "pqrs":
            kind = rng.choice(["directory", "file", "link", "link"])
            entries[f"{a}/{b}"] = (kind, rng.choice(["../b/p", "../c", "p", "q/../r", "..", "../..", "../../x", "/etc", "s/n", "../a/q/t", f"../{rng.choice('abc')}/{rng.choice('pqrs')}"]) if kind == "link" else None)
            if kind == "directory":
                entries[f"{a}/{b}/n"] = ("link", "../" + rng.choice("pqrs"))
    entries |= {f"k{i}": ("link", f"k{i + 1}") for i in range(45)} | {"k45": ("file", None), "loop": ("link", "loop"), "back": ("link", "a/../loop2"), "loop2": ("link", "back")}
    names = [*"abc", *"pqrs", "n", "..", ".", "x"]
    paths = ["/".join(rng.choices(names, k=rng.randint(1, 6))) for _ in range(400)] + ["", "/a", "k0", "k4", "k5", "k6", "k40/x", "loop", "back/..", "k44/../a"]
    table = spark.createDataFrame([(p, k, t) for p, (k, t) in entries.items()], "path string, kind string, target string")
    got = resolver.resolve(spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string"), table).collect()
    assert len(got) == len(paths) + 1
    for r in got:
        if r["path"] is None:
            assert r["resolved"] is None and r["error"] is None
            continue
        resolved, links, error = brute(entries, r["path"])
        assert (r["resolved"], r["error"]) == (resolved, error), r
        assert r["links"] == links, r
        if resolved is not None:
            kind = entries.get(resolved, (None,))[0]
            assert r["node"] == kind and (r["missing"] is None) == (kind is not None)
            above = ["/".join(resolved.split("/")[:i]) for i in range(1, len(resolved.split("/")))]
            if kind is None:
                first = next((entries.get(a, (None,))[0] for a in above if entries.get(a, (None,))[0] != "directory"), None)
                assert r["missing"] == ("not_a_directory" if first == "file" else "not_found")


def test_no_links_and_no_queries(spark):
    none = spark.createDataFrame([], "path string, kind string, target string")
    assert resolver.resolve(spark.createDataFrame([("a/b",)], "path string"), none).collect()[0]["missing"] == "not_found"
    assert resolver.resolve(spark.createDataFrame([], "path string"), none).count() == 0
    assert resolver.closed_links(none).count() == 0
