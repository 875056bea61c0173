"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.chunks import column
from quillon.llm.common import release, written

#: Words of a cell of a length's tree, about; words of a length that its tree is fitted on, about; words of a leaf.
CELL, SAMPLE, LEAF = 24_000, 6_000, 48
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
#: Letters A-Z, a-z and U+00C0 to U+00FF in UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Dimensions of a vector: a-z, then U+00C0 to U+00FF.
DIMS = 26 + 64
#: Pairs whose codes, and bytes of words whose letters, are compared at once; bytes of words of a cell, at most about.
PAIRS, BYTES, HELD = 1 << 18, 1 << 23, 1 << 24


def without(run: bytes, at: int) -> bytes:
    """A run in UTF-8 without its code point ``at``."""
    text = run.decode()
    return (text[:at] + text[at + 1 :]).encode()


def count_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """The words of all texts and how often they occur: columns word, n.

    A word is a maximal run of letters, A-Z in lower case. If ``every`` divides h, the crc32 of
    ``<doc_id>:<run>``, the run's code point h % length is left out first. A null text has no runs;
    a null doc_id reads as ``null``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> pa.RecordBatch:
            long = [(w, n) for w, n in seen.items() if len(w) >= least_length and (len(w) >= 2 * least_length or len(w.decode()) >= least_length)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in long], pa.binary()).cast(pa.string()), pa.array([n for _, n in long], pa.int64())], ["word", "n"])

        crc = zlib.crc32
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.large_binary()), strict=True):
                if not text.is_valid:
                    continue
                runs = _RUN.findall(text.as_py().translate(_LOWER))
                start = crc(b"null:" if doc is None else b"%d:" % doc)
                for i, h in enumerate([crc(r, start) for r in runs]):
                    if not h % every:
                        runs[i] = without(runs[i], h % len(runs[i].decode()))
                seen.update(runs)
                if len(seen) >= COUNTED:
                    yield told()
        yield told()
        release()

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of words of one length, a row each, as dimensions; and their counts, at most 255."""
    raw = words.cast(pa.large_string())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    own = data[data != 0xC3].astype(np.int64)
    own = np.where(own >= 0x80, own - 0x80 + 26, own - 97).astype(np.uint8).reshape(len(raw), -1)
    counts = np.zeros((len(raw), DIMS), np.int64)
    np.add.at(counts, (np.repeat(np.arange(len(raw)), own.shape[1]), own.ravel()), 1)
    return own, np.minimum(counts, 255).astype(np.uint8)


class Tree:
    """A k-d tree: each node splits at the letter and the count that halve its vectors best."""

    def __init__(self, counts: np.ndarray, leaf: int, cells: bool = False):
        """``cells``: leaves keep no vectors, they are the numbered cells of a space."""
        self.cells = 0
        self.root = self._node(counts, np.arange(len(counts)), leaf, cells)

    def _node(self, counts: np.ndarray, rows: np.ndarray, leaf: int, cells: bool):
        split = None
        if len(rows) > leaf:
            own = counts[rows]
            best = None
            for at in range(1, 4):
                share = np.abs((own >= at).mean(0) - 0.5)
                d = int(share.argmin())
                if share[d] < 0.5 and (best is None or share[d] < best):
                    best, split = share[d], (d, at)
            if split is None:  # alike up to three of each letter
                low, high = own.min(0), own.max(0)
                d = int((high.astype(int) - low).argmax())
                if high[d] > low[d]:
                    split = (d, (int(low[d]) + int(high[d]) + 1) // 2)
        if split is None:
            self.cells += 1
            return self.cells - 1 if cells else rows
        right = counts[rows, split[0]] >= split[1]
        return (*split, self._node(counts, rows[~right], leaf, cells), self._node(counts, rows[right], leaf, cells))

    def within(self, counts: np.ndarray, radius: int) -> Iterator[tuple[object, np.ndarray]]:
        """Leaves whose box is within the L1 distance ``radius`` of some of the vectors, and which these are."""
        stack = [(self.root, np.arange(len(counts)), np.zeros(len(counts), np.int16), {})]
        while stack:
            node, rows, gap, box = stack.pop()
            if not isinstance(node, tuple):
                yield node, rows
                continue
            d, at, low, high = node
            lo, hi = box.get(d, (0, 255))
            own = counts[rows, d].astype(np.int16)
            away = lambda a, b: np.maximum(np.maximum(a - own, own - b), 0)  # noqa: B023, E731
            before = away(lo, hi)
            for child, a, b in ((low, lo, at - 1), (high, at, hi)):
                g = gap - before + away(a, b)
                near = g <= radius
                if near.any():
                    stack.append((child, rows[near], g[near], box | {d: (a, b)}))


def codes(counts: np.ndarray) -> np.ndarray:
    """64 bits whose number of different ones is never more than the L1 distance.

    A letter a-z has a bit for one and a bit for two; the other letters share twelve.
    """
    bits = np.zeros((len(counts), 64), bool)
    bits[:, :26], bits[:, 26:52] = counts[:, :26] >= 1, counts[:, :26] >= 2
    for i in range(12):
        bits[:, 52 + i] = counts[:, 26 + i :: 12].any(1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` differ by exactly one replaced letter, or one that ``b`` has more."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    # Letters from the left that agree, and from the right; together they are all of the shorter word.
    left = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    right = np.logical_and.accumulate(a[:, ::-1] == b[:, : -n - 1 : -1], axis=1).sum(1)
    return left + right >= n


def near_pairs(words: np.ndarray, counts: np.ndarray, tree: Tree, others: np.ndarray, other_counts: np.ndarray, radius: int, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``others``, row of ``words``) one edit apart. ``upper``: ``others`` begin with ``words``, each pair once."""
    if not len(others) or not len(words):
        return
    mine, theirs = codes(counts), codes(other_counts)
    for leaf, rows in tree.within(other_counts, radius):
        step = max(1, PAIRS // len(leaf))
        for at in range(0, len(rows), step):
            q = rows[at : at + step]
            i, j = np.nonzero(np.bitwise_count(theirs[q][:, None] ^ mine[leaf][None, :]) <= radius)
            i, j = q[i], leaf[j]
            if upper:
                i, j = i[i > j], j[i > j]
            some = max(1, BYTES // words.shape[1])
            for k in range(0, len(i), some):
                ok = one_edit(others[i[k : k + some]], words[j[k : k + some]])
                yield i[k : k + some][ok], j[k : k + some][ok]


def search_cell(table: pa.Table) -> pa.Table:
    """The near words that a cell's home words have among themselves and with its visitors, summed up for each word.

    ``role`` 0 is at home, 1 a visitor of the same length, 2 one that is a letter shorter.
    """
    role = column(table, "role").to_numpy()
    order = np.argsort(role, kind="stable")
    words, n, role = column(table, "word").take(pa.array(order)), column(table, "n").to_numpy()[order], role[order]
    home, same = int((role == 0).sum()), int((role <= 1).sum())
    a, b = [], []
    if home:
        letters_, counts = letters(words.slice(0, same))
        tree = Tree(counts[:home], LEAF)
        for i, j in near_pairs(letters_[:home], counts[:home], tree, letters_, counts, 2, True):
            a.append(i), b.append(j)
        if same < len(words):
            short, short_counts = letters(words.slice(same))
            for i, j in near_pairs(letters_[:home], counts[:home], tree, short, short_counts, 1, False):
                a.append(i + same), b.append(j)
    if not a:
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    # The near word of largest n first; of equal ones the smallest, whose UTF-8 has the order of code points.
    rank = np.empty(len(words), np.int64)
    rank[pa.compute.sort_indices(words.cast(pa.binary())).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(a)))
    take = lambda x: words.take(pa.array(x))
    return pa.table({"word": take(a[first]), "n_near": pa.array(size, pa.int64()), "near": take(b[first]), "near_n": pa.array(n[b[first]], pa.int64())})


def spelling_variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, every: int = 31, cell: int = CELL) -> DataFrame:
    """Words that are probably variants of a far more frequent one: word, form, root, n, n_near, form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A
    word's ``form`` is its near word of largest n, of equal ones the smallest in the order of code
    points, if that n is ``ratio`` times the word's or more; else null. ``root`` is the last word
    that the forms lead to, the word itself if it has none. Words as ``count_words`` has them;
    rows of ``docs`` that repeat count each, other columns aren't read, an empty table has no words.

    One edit gives letter counts an L1 distance of at most two, one for an inserted letter. Each
    length with more than ``cell`` words has a k-d tree over letter counts whose leaves are cells;
    it is fitted on about ``SAMPLE`` words, chosen by their hash, and all words are dealt to
    it. A word is at home in one cell and visits those of the same length with higher numbers,
    and those of the next length, whose box lies within two, or one, of it. In a cell, a k-d tree
    of the home words answers range searches for all, boxes prune, and the letters' order is
    verified. Homes of a cell with many more words, as anagrams can't be split, are dealt into parts.
    """
    spark = docs.sparkSession
    words = written(count_words(docs, least_length, least_count, every).withColumn("len", F.char_length("word")), "words")
    # Lengths with more than a cell of words: fewer than words / cell.
    room = F.greatest(F.lit(1), F.least(F.lit(cell), F.floor(F.lit(HELD) / F.col("len")).cast("int")))
    crowded = {r["len"]: (r["n"], r["room"]) for r in words.groupBy("len").agg(F.count("*").alias("n")).withColumn("room", room).where(F.col("n") > F.col("room")).collect()}
    trees: dict[int, Tree] = {}
    if crowded:
        share = F.element_at(F.create_map(*(F.lit(x) for k, (n, _) in crowded.items() for x in (k, max(1, n // SAMPLE)))), F.col("len"))
        picked = words.where(F.col("len").isin(*crowded) & (F.pmod(F.xxhash64("word"), share) == 0)).select("word", "len").toArrow()
        of = picked.column("len").to_numpy()
        for k, (n, fits) in crowded.items():
            own = column(picked.select(["word"]).take(pa.array(np.flatnonzero(of == k))), "word")
            if len(own):
                trees[k] = Tree(letters(own)[1], max(1, int(len(own) * fits / n)), cells=True)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch["len"].to_numpy()
            for k in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == k)
                own = batch["word"].take(pa.array(rows))
                counts = letters(own)[1]
                home = np.zeros(len(rows), np.int64)
                out = []
                if k in trees:
                    for c, at in trees[k].within(counts, 0):
                        home[at] = c
                    for c, at in trees[k].within(counts, 2):
                        at = at[home[at] < c]
                        out.append((at, np.full(len(at), c), 1, k))
                out.append((np.arange(len(rows)), home, 0, k))
                for c, at in trees[k + 1].within(counts, 1) if k + 1 in trees else [(0, np.arange(len(rows)))]:
                    out.append((at, np.full(len(at), c), 2, k + 1))
                at = np.concatenate([x[0] for x in out])
                yield pa.RecordBatch.from_arrays(
                    [
                        own.take(pa.array(at)), batch["n"].take(pa.array(rows[at])), pa.array(np.concatenate([x[1] for x in out]), pa.int64()),
                        pa.array(np.concatenate([np.full(len(x[0]), x[3]) for x in out]), pa.int32()), pa.array(np.concatenate([np.full(len(x[0]), x[2]) for x in out]), pa.int32()),
                    ],
                    ["word", "n", "cell", "len", "role"],
                )
        release()

    dealt = words.select("word", "n", "len").mapInArrow(deal, "word string, n long, cell long, len int, role int")
    dealt = written(dealt, "cells")
    # Cells of several parts: fewer than words / (2 * cell).
    full = dealt.where("role = 0").groupBy("len", "cell").agg(F.count("*").alias("c")).where(F.col("c") > 2 * room)
    full = full.select(F.col("len").alias("_len"), F.col("cell").alias("_cell"), F.ceil(F.col("c") / room).alias("parts"))
    dealt = dealt.join(full, (F.col("len") == F.col("_len")) & (F.col("cell") == F.col("_cell")), "left")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    part = F.pmod(F.xxhash64("word"), parts)
    # At home in one part, and a visitor of all parts with higher numbers; other visitors come to all.
    each = F.explode(F.sequence(F.when(F.col("role") == 0, part).otherwise(0), parts - 1))
    dealt = dealt.select("word", "n", "len", "cell", "role", part.alias("own"), each.alias("part"))
    dealt = dealt.select("word", "n", "len", "cell", "part", F.when((F.col("role") == 0) & (F.col("part") != F.col("own")), 1).otherwise(F.col("role")).alias("role"))
    near = dealt.groupBy("len", "cell", "part").applyInArrow(search_cell, "word string, n_near long, near string, near_n long")
    best = near.groupBy(F.col("word").alias("_word")).agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    out = words.join(best, words["word"] == F.col("_word"), "left")
    chosen = -F.col("best.m") >= ratio * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.w")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n"))
    out = written(out, "forms")
    # Each form has ``ratio`` times the occurrences of the one before: chains are short, and doubling ends them soon.
    links = out.where("form IS NOT NULL").select(F.col("word").alias("a"), F.col("form").alias("b"))
    while links.limit(1).count():
        ahead = links.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        longer = written(links.join(ahead, links["b"] == ahead["_a"], "left").select("a", F.coalesce("_b", "b").alias("b"), F.col("_a").isNotNull().alias("on")), "roots")
        links = longer.select("a", "b")
        if not longer.where("on").limit(1).count():
            break
    return out.join(links, out["word"] == links["a"], "left").select("word", "form", F.coalesce("b", "word").alias("root"), "n", "n_near", "form_n")
