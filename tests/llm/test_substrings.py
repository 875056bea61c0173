import hashlib
import random

import numpy as np
import pytest

from quillon.llm import substrings
from quillon.llm.substrings import dedup_substrings

SF = "/root/testdata/sf0.001"


def brute(rows, window=20):
    """n_words, n_removed and the digest of each (doc_id, text), by looking at every window."""
    tie = lambda t: int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "big") >> 1
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]))):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def same(got, want):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = dedup_substrings(docs, texts=True).collect()
    same([r[:4] for r in got], brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("block", [4 << 20, 3000])
def test_hard_cases(spark, monkeypatch, block):
    """Hot passages with branching contexts, periods, repeats within a text, null and repeated ids; leaders of several blocks."""
    monkeypatch.setattr(substrings, "BLOCK", block)
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choices(voc, k=n))
    shared, line = [some(60) for _ in range(4)], some(9)
    rows = [(1 << 60 | i, "\n".join(rng.choice([some(rng.randint(0, 40)), line, rng.choice(shared)]) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    rows += [(-5, shared[1] + " x " + shared[1]), (7, "a " * 500), (8, "a b c " * 90), (9, "a " * 19), (10, "a " * 20), (None, None), (None, shared[0]), (None, shared[0]), (11, ""), (12, " \t\n")]
    rows += [(13, shared[2]), (13, shared[2]), (13, some(30) + " " + shared[2]), (14, "é x   " * 30), (15, "long" * 5000 + " " + shared[3]), (16, shared[3].upper())]
    branching = [" ".join([line, *rng.choices(voc[:2], k=15)]) for _ in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(branching)]
    docs = spark.createDataFrame([(t, "x", d, 3) for d, t in rows], "text string, bucket string, doc_id long, row int").repartition(5)
    same(dedup_substrings(docs).collect(), brute(rows))


def test_wide_windows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x a b c d e f g h y")], "doc_id int, text string")
    same(dedup_substrings(docs, window=8).collect(), brute([(r.doc_id, r.text) for r in docs.collect()], 8))
    assert dedup_substrings(docs.where("false")).count() == 0
    assert dedup_substrings(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()[0][1:3] == (0, 0)


def test_words_are_runs_between_white_space():
    data = np.frombuffer("  a\tbb c\x0bd\x1ce \n".encode(), np.uint8)
    starts, ends, hashes = substrings.split_words(data)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == data.tobytes().split() and len(set(hashes.tolist())) == len(starts)
