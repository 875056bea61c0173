import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import spelling
from quillon.llm.spelling import Tree, letters, spelling_variants

SF = "/root/testdata/sf0.001"
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """All columns, near words from the words with one code point left out or replaced."""
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    masks, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            masks.setdefault((w[:i], w[i + 1 :]), []).append(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :]), near[w[:i] + w[i + 1 :]].add(w)
    for alike in masks.values():
        for w in alike:
            near[w] |= set(alike) - {w}
    form = {}
    for w, other in near.items():
        best = min(other, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("cell", [24_000, 150])
def test_whole_table(spark, cell):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(want) > 1000 and got(spelling_variants(docs, cell=cell)) == want


def test_anagrams_chains_and_odd_rows(spark):
    """Anagrams fill one cell beyond its size; forms lead on; letters beyond a-z; nulls, repeats, long runs."""
    rng = random.Random(1)
    base = "abcdefgh"
    anagrams = ["".join(rng.sample(base, 8)) for _ in range(400)]
    texts = [(i, " ".join(w for w in anagrams for _ in range(2))) for i in range(2)]
    texts += [(2, "garden " * 3 + "gardens " * 300 + "gardenz " * 25 + "gardenzz " * 2), (3, "Straße-straßen " * 40 + "strasse strabe straßens " * 2), (4, "ÀÉÎÕÜßÿ ÀÉÎÕÜßx " * 3 + "àéîõüßÿ×÷ " * 2)]
    texts += [(None, "nullword " * 40 + "nulword " * 2), (None, None), (5, ""), (6, "x" * 70_000 + " " + "x" * 70_000 + " " + "x" * 69_999 + "y " + "x" * 69_999 + "y"), (6, "x" * 70_000), (-7, "naïveté " * 20 + "naiveté " * 2 + "日本語gardens"), (8, "A1B2C3D")]
    docs = spark.createDataFrame([(t, d, 1, "z") for d, t in texts], "text string, doc_id long, n int, word string").repartition(3)
    for cell in (24_000, 60):
        assert got(spelling_variants(docs, cell=cell)) == brute(texts)
    assert spelling_variants(docs.where("false")).count() == 0


def test_range_search_by_boxes():
    rng = np.random.default_rng(0)
    words = pa.array(["".join(rng.choice(list("abcdeé"), 7)) for _ in range(500)])
    counts = letters(words)[1]
    tree = Tree(counts, 8)
    for radius in (1, 2):
        found = {(int(q), int(x)) for leaf, rows in tree.within(counts, radius) for q in rows for x in leaf}
        d = np.abs(counts[:, None].astype(int) - counts[None]).sum(2)
        assert {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= radius), strict=True)} <= found
        assert len(found) < 500 * 500 / 2
    assert spelling.one_edit(*(letters(pa.array(x))[0] for x in (["abcdefg"], ["abcxdefg"]))).all()
