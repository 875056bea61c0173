"""Substring dedup by relative Lempel-Ziv parsing: passages of many words that occur earlier go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.chunks import CHUNK, column, in_chunks, pack, texts_of, unpack
from quillon.llm.common import release, written

#: Words of an anchor: a window's anchor is the one of its runs of so many words with the smallest hash.
ANCHOR = 8
#: Anchors that a task compares, and bytes of passages of a reference block, about.
ANCHORS, BLOCK = 400_000, 4 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9FB21C651E98DF25)
_SEGMENT = 1 << 20
_FIRST = -(1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBEA225F9EB34556D)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBEA225F9EB34556D)
    return h ^ (h >> np.uint64(32))


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of some bytes begin and end, and their 64-bit hashes."""
    white = np.concatenate([[True], _WHITE[data], [True]])
    edge = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edge[::2], edge[1::2]
    hashes, at = [], 0
    while at < len(starts):
        # Words up to a segment's end; a longer word is taken whole.
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SEGMENT, "right")))
        a, b = starts[at:to], ends[at:to]
        lengths = b - a
        total = int(lengths.sum())
        first = np.cumsum(lengths) - lengths
        place = np.arange(total) - np.repeat(first, lengths)
        powers = np.full(int(lengths.max()), _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        hashes.append(_mixed(np.add.reduceat(_BYTE[data[place + np.repeat(a, lengths)]] * powers[place], first)))
        at = to
    return starts, ends, np.concatenate(hashes) if hashes else np.empty(0, np.uint64)


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = h * _BASE + words[i : i + n]
    return _mixed(h)


def anchors(g: np.ndarray, span: int) -> np.ndarray:
    """Places of the smallest hash, the first of equal ones, of every ``span`` side by side."""
    n = len(g) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(n)
    least = g[:n].copy()
    for i in range(1, span):
        lower = g[i : i + n] < least
        least[lower] = g[i : i + n][lower]
        best[lower] = np.flatnonzero(lower) + i
    return np.unique(best)


class Chunk:
    """The words of a chunk's texts and the anchors of their windows."""

    def __init__(self, table: pa.Table, window: int):
        data, offsets = texts_of(table)
        self.data, self.offsets = data, offsets
        ends_of_texts = offsets[1:] - offsets[0]
        data = data[offsets[0] : offsets[-1]]
        # A separator after each text, so that no word crosses it.
        joined = np.insert(data, ends_of_texts, 32)
        self.starts, self.ends, hashes = split_words(joined)
        bounds = ends_of_texts + np.arange(len(ends_of_texts))
        self.joined = joined
        self.counts = np.diff(np.concatenate([[0], np.searchsorted(self.starts, bounds)]))
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        width = min(ANCHOR, window)
        g = grams(hashes, width)
        if len(self.doc) >= width and len(g):
            # Runs that cross from one text into the next are no anchors of either.
            crossing = self.doc[: len(g)] != self.doc[width - 1 :]
            places = anchors(g, window - width + 1)
            self.at = places[~crossing[places]]
            self.hash = g[self.at]
        else:
            self.at, self.hash = np.empty(0, np.int64), np.empty(0, np.uint64)


def passages(chunk: Chunk, classes: np.ndarray, leaders: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of words that hold all windows of anchors of one leader: leader, document, first word, end."""
    place = np.searchsorted(classes, chunk.hash)
    place[place == len(classes)] = 0
    known = classes[place] == chunk.hash if len(classes) else np.zeros(len(chunk.hash), bool)
    at, leader = chunk.at[known], leaders[place[known]]
    doc = chunk.doc[at]
    width = min(ANCHOR, window)
    a = np.maximum(at - (window - width), chunk.first[doc])
    b = np.minimum(at + window, chunk.first[doc] + chunk.counts[doc])
    order = np.lexsort((a, doc, leader))
    leader, doc, a, b = leader[order], doc[order], a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (leader[1:] != leader[:-1]) | (doc[1:] != doc[:-1]) | (a[1:] > b[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(a)) - 1 if len(a) else np.empty(0, np.int64)
    return leader[new], doc[new], a[new], b[last]


def parse(words: np.ndarray, seeds: np.ndarray, bounds: np.ndarray, window: int) -> tuple[list, list]:
    """Greedy factors of passages against an index of what earlier ones hold; where windows are new.

    ``words`` are the passages' words side by side, ``bounds`` where each begins and ends,
    ``seeds`` the hash of the window at each place. A window that the index has begins a factor,
    as long as the words there and at the place found go on alike. Windows inside a factor aren't
    looked up; at its end, those that cross it are, so none is missed. Other windows join the index.
    """
    raw = words.tobytes()
    seed = seeds.tolist()
    index: dict[int, int] = {}
    end_of = np.repeat(bounds[1:], np.diff(bounds)).tolist()
    factors, new = [], []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        i, last = start, end - window
        while i <= last:
            key = seed[i]
            j = index.get(key)
            while j is not None and raw[8 * j : 8 * (j + window)] != raw[8 * i : 8 * (i + window)]:
                key += 1 << 64  # another window of the same hash
                j = index.get(key)
            if j is None:
                index[key] = i
                new.append(i)
                i += 1
                continue
            n, most = window, min(end - i, end_of[j] - j)
            step = 32
            while n < most:
                m = min(step, most - n)
                if raw[8 * (i + n) : 8 * (i + n + m)] == raw[8 * (j + n) : 8 * (j + n + m)]:
                    n += m
                    step *= 2
                elif m == 1:
                    break
                else:
                    step = m // 2
            factors.append((i, i + n))
            i += n - window + 1
    return factors, new


def factor_block(block: pa.Table, window: int, keep_new: bool) -> tuple[np.ndarray, np.ndarray, dict]:
    """Factors of a block's passages, as (row, first word, end); places of new windows of ``shared`` rows, with hashes.

    The block's reference is what its passages hold, in the order of documents; windows meet
    those of the same leader only.
    """
    leader, doc, tie, row, start = (column(block, n).to_numpy() for n in ("leader", "doc", "tie", "row", "start"))
    order = np.lexsort((start, row, tie, doc, leader))
    text = pa.table({"text": column(block, "words").cast(pa.large_binary()).take(pa.array(order))}).combine_chunks()
    data, offsets = texts_of(text)
    lengths = offsets[1:] - offsets[0]
    joined = np.insert(data[offsets[0] : offsets[-1]], lengths, 32)
    starts, _, words = split_words(joined)
    bounds = np.concatenate([[0], np.searchsorted(starts, lengths + np.arange(len(lengths)))])
    leader, doc, tie, row, start = (x[order] for x in (leader, doc, tie, row, start))
    of = np.repeat(np.arange(len(order)), np.diff(bounds))
    g = grams(words, window)
    mine = _mixed(leader.astype(np.uint64))
    seeds = _mixed(g ^ mine[of[: len(g)]]) if len(g) else g
    factors, new = parse(words, seeds, bounds, window)
    f = np.array(factors, np.int64).reshape(-1, 2)
    owner = of[f[:, 0]]
    f = f - bounds[owner][:, None] + start[owner][:, None]
    told = column(block, "told").to_numpy(zero_copy_only=False)[order]
    f, rows = f[told[owner]], row[owner][told[owner]]
    found = {}
    if keep_new:
        shared = column(block, "shared").to_numpy(zero_copy_only=False)[order]
        at = np.array(new, np.int64)
        at = at[shared[of[at]]] if len(at) else at
        p = of[at]
        # A second hash beside the first: 128 bits stand for a window.
        other = np.full(len(at), 7, np.uint64)
        for i in range(window):
            other = _mixed(other ^ words[at + i]) + np.uint64(i)
        found = {"h0": g[at].view(np.int64), "h1": other.view(np.int64), "leader": leader[p], "doc": doc[p], "tie": tie[p], "row": row[p], "start": at - bounds[p] + start[p]}
    return rows, f, found


def dedup_substrings(docs: DataFrame, window: int = 20, texts: bool = False) -> DataFrame:
    """Remove each word that a window of ``window`` words covers whose words also start earlier.

    Earlier is: in a document of smaller doc_id, or before in the same one. Rows of one doc_id
    follow each other by a hash of their texts, equal ones in any order; a null doc_id comes before
    all others. Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space) and, with ``texts``, ``kept_text``; one row for each of ``docs``, whose other columns are
    not read. A null text has no words. Windows are judged on the input alone.

    Relative Lempel-Ziv parsing against reference blocks:

    * Each window has an anchor, the smallest of the hashes of its runs of ``ANCHOR`` words, so
      equal windows have equal anchors. Anchors that occur once lead nowhere. For all others the
      first chunk's text that has it is the leader.
    * The words around anchors of one leader are a passage. The passages of a leader meet in one
      reference block, so a block without an anchor of a document can have no factor of it, and
      each document is parsed against all blocks that can.
    * In a block (``parse``) passages are factored greedily against the index of all that earlier
      ones hold; factors have ``window`` words or more, windows that cross a factor's end are looked
      up by themselves, so results are exact.
    * A leader with more passages than a block may hold has several blocks. Each gets the leader's
      own passages as reference; windows that are new to more than one of them are compared by two
      64-bit hashes, one row for each block.

    Nothing but counts goes to the driver; a task holds a chunk, a block, or ``ANCHORS`` anchors.
    Every occurrence of an anchor within a chunk is one record, so a passage that all documents
    share is one for each chunk.
    """
    if window < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} words at least")
    spark = docs.sparkSession

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in in_chunks(batches):
            yield pa.RecordBatch.from_pydict({"chunk": [number], "held": pa.array([pack(table)], pa.binary())})
        release()

    chunks = written(docs.select("doc_id", "text").mapInArrow(chunk, "chunk long, held binary"), "chunks")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, chunks.count() * (CHUNK // 36) // ANCHORS + 1)  # a word has about 6 bytes, an anchor 6 words

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held in zip(batch["chunk"].to_pylist(), batch["held"], strict=True):
                c = Chunk(unpack(held), window)
                h, first, n = np.unique(c.hash, return_index=True, return_counts=True)
                bucket = (h >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cut = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
                rows = {"bucket": [], "chunk": [], "held": []}
                for a, b in zip(cut, cut[1:], strict=False):
                    own = order[a:b]
                    own = own[np.argsort(h[own])]
                    rows["bucket"].append(int(bucket[own[0]]))
                    rows["chunk"].append(number)
                    rows["held"].append(pack(pa.table({"hash": h[own], "doc": c.doc[c.at[first[own]]].astype(np.uint16), "more": n[own] > 1})))
                yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int64()), pa.array(rows["chunk"], pa.int64()), pa.array(rows["held"], pa.binary())], ["bucket", "chunk", "held"])
        release()

    def answer(group: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in column(group, "held")]
        numbers = column(group, "chunk").to_numpy()
        h = np.concatenate([column(p, "hash").to_numpy() for p in parts])
        c = np.repeat(numbers, [len(p) for p in parts])
        row = (c << 14) | np.concatenate([column(p, "doc").to_numpy().astype(np.int64) for p in parts])
        more = np.concatenate([column(p, "more").to_numpy(zero_copy_only=False) for p in parts])
        order = np.lexsort((row, h))
        h, row, more, c = h[order], row[order], more[order], c[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(starts, len(h)))
        many = (size > 1) | np.logical_or.reduceat(more, starts)
        kept = np.repeat(many, size)
        leader = np.repeat(row[starts], size)[kept]
        h, c = h[kept], c[kept]
        order = np.lexsort((h, c))
        h, c, leader = h[order], c[order], leader[order]
        cut = np.append(np.flatnonzero(np.diff(c, prepend=-1)), len(c))
        out = [(int(c[a]), pack(pa.table({"hash": h[a:b], "leader": leader[a:b]}))) for a, b in zip(cut, cut[1:], strict=False)]
        return pa.table({"to": pa.array([x for x, _ in out], pa.int64()), "told": pa.array([x for _, x in out], pa.binary())})

    def cut(own: pa.Table, told: pa.Table) -> pa.Table:
        out = {n: [] for n in ("leader", "doc", "tie", "row", "start", "words")}
        told = [unpack(x) for x in column(told, "told")]
        if told and len(own):
            h = np.concatenate([column(t, "hash").to_numpy() for t in told])
            order = np.argsort(h)
            leaders = np.concatenate([column(t, "leader").to_numpy() for t in told])[order]
            number = column(own, "chunk")[0].as_py()
            table = unpack(column(own, "held")[0])
            c = Chunk(table, window)
            ids = column(table, "doc_id").cast(pa.int64()).fill_null(_FIRST).to_numpy()
            ties: dict[int, int] = {}
            joined = c.joined.tobytes()
            for leader, d, a, b in zip(*(x.tolist() for x in passages(c, h[order], leaders, window)), strict=True):
                if d not in ties:
                    text = c.data[c.offsets[d] : c.offsets[d + 1]].tobytes()
                    ties[d] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big") >> 1
                for k, v in zip(out, (leader, int(ids[d]), ties[d], (number << 14) | d, a - int(c.first[d]), joined[c.starts[a] : c.ends[b - 1]]), strict=True):
                    out[k].append(v)
        return pa.table({k: pa.array(v, pa.binary() if k == "words" else pa.int64()) for k, v in out.items()})

    asked = chunks.mapInArrow(ask, "bucket long, chunk long, held binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "to long, told binary")
    found = chunks.groupBy("chunk").cogroup(told.groupBy("to")).applyInArrow(cut, "leader long, doc long, tie long, row long, start long, words binary")
    found = written(found, "passages")

    sizes = found.groupBy("leader").agg(F.sum(F.length("words")).alias("b"), F.sum(F.when(F.col("row") == F.col("leader"), F.length("words"))).alias("own"))
    sizes = written(sizes, "leaders")
    total = sizes.agg(F.sum("b")).first()[0] or 0
    blocks = max(tasks, -(-total // BLOCK))
    # Leaders of more than a block: at most as many as there are blocks.
    hot = sizes.where(F.col("b") > BLOCK).select(F.col("leader").alias("_l"), F.ceil(F.col("b") / BLOCK).alias("parts"), (F.coalesce("own", F.lit(0)) <= BLOCK).alias("_repeat"))
    dealt = found.join(hot, found["leader"] == F.col("_l"), "left")
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    every = F.when((F.col("row") == F.col("leader")) & F.col("_repeat"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(part))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("parts").isNotNull(), every).otherwise(F.array(F.lit(-1).cast("long")))))
    dealt = dealt.select(
        *found.columns, F.col("parts").isNotNull().alias("shared"), (F.col("parts").isNull() | (F.col("part") == part)).alias("told"),
        F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("leader"), F.lit(blocks))).otherwise(F.xxhash64("leader", "part")).alias("block"),
    )

    def factor(block: pa.Table) -> pa.Table:
        rows, f, new = factor_block(block, window, keep_new=True)
        n, m = len(rows), len(new.get("h0", ()))
        none = lambda k: np.zeros(k, np.int64)
        columns = {"row": np.concatenate([rows, new["row"]]), "a": np.concatenate([f[:, 0], new["start"]]), "b": np.concatenate([f[:, 1], none(m)])}
        columns |= {k: np.concatenate([none(n), new[k]]) for k in ("leader", "h0", "h1", "doc", "tie")}
        release()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    parsed = written(dealt.groupBy("block").applyInArrow(factor, "row long, a long, b long, leader long, h0 long, h1 long, doc long, tie long"), "factors")
    new = parsed.where("b = 0")
    key = ["leader", "h0", "h1"]
    firsts = new.groupBy(*key).agg(F.min(F.struct("doc", "tie", "row", "a")).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n").withColumnsRenamed({k: f"_{k}" for k in key})
    again = new.join(firsts, [new[k] == F.col(f"_{k}") for k in key]).where((F.col("row") != F.col("f.row")) | (F.col("a") != F.col("f.a")))
    spans = parsed.where("b > 0").select("row", "a", "b").union(again.select("row", "a", F.col("a") + window))
    # A chunk's spans travel packed by task, a few rows for each chunk.
    spans = spans.select(F.shiftright("row", 14).alias("to"), F.col("row").bitwiseAND(F.lit((1 << 14) - 1)).alias("d"), "a", "b")

    def keep(own: pa.Table, spans: pa.Table) -> pa.Table:
        rows = []
        if len(own):
            table = unpack(column(own, "held")[0])
            data, offsets = texts_of(table)
            by: dict[int, list] = {}
            for d, a, b in zip(*(column(spans, k).to_pylist() for k in ("d", "a", "b")), strict=True):
                by.setdefault(d, []).append((a, b))
            for d in range(len(table)):
                words = data[offsets[d] : offsets[d + 1]].tobytes().split()
                kept, n, at = words, len(words), 0
                if d in by:
                    kept = []
                    for a, b in sorted(by[d]):
                        kept += words[at:a] if a > at else []
                        at = max(at, b)
                    kept += words[at:]
                text = b" ".join(kept)
                rows.append((n, n - len(kept), hashlib.sha256(text).hexdigest(), text if texts else None))
            out = {"doc_id": column(table, "doc_id")}
        else:
            out = {"doc_id": pa.array([], pa.int64())}
        for i, (name, kind) in enumerate((("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.binary()))):
            if texts or name != "kept_text":
                column_ = pa.array([r[i] for r in rows], kind)
                out[name] = column_.cast(pa.string()) if name == "kept_text" else column_
        return pa.table(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return chunks.groupBy("chunk").cogroup(spans.groupBy("to")).applyInArrow(keep, schema)

