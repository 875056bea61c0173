"""Exact join of documents by the Jaccard similarity of their word n-grams.

Texts with one set of shingles are one class from the start; the join is between classes.

Blocks: all shingles have one order, rare ones first. Two sets that link differ in so few
shingles that among the first 2 * (1 - t) * n + 2 of each, in this order, two neighbours are
neighbours in both: pairs of neighbours are a set's signs. The order comes from counts of all
shingles in a table of a fixed size, so what many texts share, such as a passage that goes round,
is hardly ever in a sign; it decides on speed alone. The classes that share a sign and are of like
size form a group, and all groups with one smallest class, the pivot, are a block of the incidence
matrix. Candidates are never closed transitively before they are compared.

Product: within a block, rows are documents and columns n-grams; the product of the sparse
matrix with its transpose, in strips of columns and bands of rows of like size, adds up the
overlaps. Sizes too far apart aren't multiplied, pairs whose overlap is below the bound are
discarded. A task returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, free_names, release, written
from quillon.llm.embeddings import _forest
from quillon.llm.shingles import mixed, shingle_set, text_bytes

#: Rows, and shingles, of a block of a task, about.
BLOCK, BLOCK_SHINGLES = 768, 1 << 20
#: Columns of a strip and rows of a band.
STRIP, BAND = 2048, 128
#: Rows of a batch whose sets are held at once.
ROWS = 1024
#: Slots of the table of counts, a power of two, and those of a row that goes through a shuffle.
SLOTS, CHUNK = 1 << 20, 1 << 10
#: Candidates of a large block that all its others are compared with first.
PIVOTS = 8
#: Sets that a task remembers so as not to sign a copy again; only speed depends on it.
REMEMBERED = 200_000


class Levels:
    """Size classes: a set links only with sets of its own class and the next ones up and down."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.first = [1]

    def of(self, n: int) -> int:
        while self.first[-1] <= n:
            self.first.append(self.first[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.first, n, "right")) - 1


def _key(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def signs(s: np.ndarray, order: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of neighbours in a sorted set's rare-first order, one of which each linked set has too.

    Let sets of x and y shingles overlap in o, which linking bounds from below, and let x's first
    q end no later in the order than y's. At least q - (x - o) of these are common. The common
    ones have a gap fewer between them; one that isn't common, of x - o and y - o at most, lies in
    one gap. So a gap is empty in both if q is 2 * (x - o) + (y - o) + 2, which is at most
    2 * (1 - t) * x + 2, with y = t * x. None if no other set can link with one of this size.
    """
    n = len(s)
    if n * den < num * (n + 1):
        return s[:0]
    first = s[np.argsort(order[_slot(s)], kind="stable")[: 2 * (den - num) * n // den + 2]]
    return mixed(first[:-1] * np.uint64(0x9E3779B97F4A7C15) + first[1:])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of ``ROWS`` rows: what is made of a part is handed on before the next one is looked at."""
    return (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))


def slot_order(texts: DataFrame, width: int) -> np.ndarray:
    """Ranks of the slots by how many shingles of all texts fall in them: what the driver gets has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        for batch in _slices(batches):
            found = [_slot(shingle_set(data, width)) for data in text_bytes(batch.column("text"))]
            counts += np.bincount(np.concatenate([np.empty(0, np.int64), *found]), minlength=SLOTS).astype(np.uint32)
        rows = counts.reshape(-1, CHUNK)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([rows[i].tobytes() for i in some], pa.binary())], ["chunk", "counts"])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(data, np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    schema = "chunk long, counts binary"
    rows = texts.select("text").mapInArrow(count, schema).repartition(F.col("chunk")).mapInArrow(add, schema).collect()
    total = np.zeros((SLOTS // CHUNK, CHUNK), np.uint64)
    for r in rows:
        total[r["chunk"]] = np.frombuffer(r["counts"], np.uint64)
    # Ranks of 16 bits; slots alike in count are as one.
    level = np.unique(total.ravel(), return_inverse=True)[1].ravel()
    return np.minimum(level, (1 << 16) - 1).astype(np.uint16)


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits, in words of 64, for a column ``h``: its size is fixed, whatever the rows."""
    at = F.pmod(F.col("h"), F.lit(bits))
    words = hashes.select(F.floor(at / 64).alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    return out


def _in_bitmap(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = len(table) * 64
    at = h.view(np.uint64) & np.uint64(bits - 1)  # as pmod of a power of two
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bits(rows: int) -> int:
    """Bits of a filter for so many rows: 16 to 32 each, 2^20 to 2^25 in all (4 MB)."""
    return 1 << min(25, max(20, (16 * rows).bit_length()))


def similar(sets: list[np.ndarray], asked: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), one of them asked for, of sets whose overlap reaches num / den of their union."""
    sizes = np.array([len(s) for s in sets])
    by_size = np.argsort(sizes, kind="stable")
    sizes, asked = sizes[by_size], asked[by_size]
    n = len(sets)
    # Of the sets after it in this order, how far a set can link; a smaller partner looks for it.
    reach = np.searchsorted(sizes, sizes * den // num, "right")
    if n <= 3:
        pairs = [(i, j) for i in range(n) for j in range(i + 1, reach[i]) if asked[i] or asked[j]]
        overlap = [len(np.intersect1d(sets[by_size[i]], sets[by_size[j]], assume_unique=True)) for i, j in pairs]
        i, j = np.array(pairs, int).reshape(-1, 2).T
        overlap = np.array(overlap, int)
        good = overlap * den >= (sizes[i] + sizes[j] - overlap) * num
        return by_size[i[good]], by_size[j[good]]
    row = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(np.concatenate([sets[i] for i in by_size]), return_inverse=True, return_counts=True)
    shared = times > 1  # an n-gram of one document adds nothing
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    bands = [(a, min(a + BAND, n), int(reach[min(a + BAND, n) - 1])) for a in range(0, n, BAND)]
    totals = [np.zeros((b - a, end - a), np.int32) for a, b, end in bands]
    for first in range(0, int(shared.sum()), STRIP):
        at, to = np.searchsorted(column, [first, first + STRIP])
        strip = np.zeros((n, STRIP), np.float32)
        strip[row[at:to], column[at:to] - first] = 1
        for (a, b, end), total in zip(bands, totals, strict=True):
            if end > a + 1:
                total += (strip[a:b] @ strip[a:end].T).astype(np.int32)  # at most STRIP: exact
    found_i, found_j = [np.empty(0, int)], [np.empty(0, int)]
    for (a, b, end), total in zip(bands, totals, strict=True):
        i, j = np.arange(a, b)[:, None], np.arange(a, end)[None, :]
        good = (total.astype(np.int64) * (den + num) >= (sizes[a:b][:, None] + sizes[a:end][None, :]) * num) & (j > i) & (j < reach[a:b][:, None]) & (asked[a:b][:, None] | asked[a:end][None, :])
        i, j = np.nonzero(good)
        found_i.append(i + a)
        found_j.append(j + a)
    return by_size[np.concatenate(found_i)], by_size[np.concatenate(found_j)]


def _links(num: int, den: int):
    """Links within each root of a task, as a forest."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, part in pdf.groupby("root"):
            if len(part) < 2:
                continue
            sets = [np.frombuffer(s, "<u8") for s in part["shingles"]]
            keys = part["key"].tolist()
            i, j = similar(sets, part["asked"].to_numpy(bool), num, den)
            out += [(keys[x], keys[y]) for x, y in _forest(len(keys), i, j)]
        return pd.DataFrame(out, columns=["a", "b"])

    return links


def jaccard_components(docs: DataFrame, num: int = 90, den: int = 100, width: int = 3) -> DataFrame:
    """Each document's class and component: doc_id, text_hash, n_shingles, key, root, component_id.

    Words are runs of other characters than white space, A-Z in lower case; a document's set is
    its distinct shingles of ``width`` words, with fewer words the whole sequence as one. Two
    documents link where den * overlap >= num * union. ``key`` names the set (128 bits), ``root``
    the component, component_id is its smallest doc_id. Null texts and texts without words have
    an empty set, a null key, and are components of their own. Rows that repeat are of one class;
    null doc_ids take part and count as largest. doc_id may be of any type that has an order, and
    keeps it. Nothing is dropped, however large a group is; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("id_hash"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(slot_order(rows, width))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(num, den)
        for batch in _slices(batches):
            sets = [shingle_set(data, width) for data in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "id_hash", "text_hash")), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), pa.array([levels.of(len(s)) if len(s) else None for s in sets], pa.int32())], ["doc_id", "id_hash", "text_hash", "n_shingles", "key", "level"])
        release()

    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = written(rows.mapInArrow(describe, f"doc_id {kind}, id_hash long, text_hash long, n_shingles long, key binary, level int"), "signed")
    many = signed.count()
    # One document of each class.
    classes = written(signed.where("key IS NOT NULL").groupBy("key").agg(F.min("id_hash").alias("h")).withColumn("node", F.xxhash64("key")), "classes")
    some = rows.select("id_hash", "text")

    def sign(allowed):
        """Signs of the sets of texts, each set once in a task; with a filter, those in it alone."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels, seen = Levels(num, den), set()
            for batch in _slices(batches):
                own, keys, level = [np.empty(0, np.uint64)], [], []
                for data in text_bytes(batch.column("text")):
                    s = shingle_set(data, width)
                    key = _key(s)
                    if key is None or key in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    h = signs(s, order.value, num, den)
                    h = h if allowed is None else h[_in_bitmap(allowed.value, h)]
                    own.append(h)
                    keys += [key] * len(h)
                    level += [levels.of(len(s))] * len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(keys, pa.binary()), pa.array(level, pa.int32())], ["sign", "key", "level"])
            release()

        return some.select("text").mapInArrow(run, "sign long, key binary, level int").select("sign", F.xxhash64("key").alias("node"), "level")

    # Signs of two classes or more. A filter of a bounded size thins out the rest before the join.
    shared = sign(None).groupBy("sign").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("sign")
    shared = written(shared, "shared")
    sent = spark.sparkContext.broadcast(_bitmap(shared.select(F.col("sign").alias("h")), _bits(64 * many)))
    some_signs = sign(sent).join(shared, "sign")
    # Sizes that can link are of one level or of neighbours: group g has the levels g - 1 and g.
    # Without a member of its own level it only repeats the group below.
    members = written(some_signs.select("sign", "node", F.explode(F.array(F.lit(0), F.lit(1))).alias("up"), (F.col("level") + F.col("up")).alias("level")), "members")
    groups = members.groupBy("sign", "level").agg(F.min("node").alias("root"), F.max("node").alias("high"), F.min("up").alias("up")).where("root < high AND up = 0").select("sign", "level", "root")
    stars = written(members.join(groups, ["sign", "level"]).select("root", "node").distinct(), "stars")

    # The sets of the candidates, from the texts again.
    classes = written(classes.join(stars.select("node").distinct(), "node").select("key", "node", "h"), "candidates")
    wanted = spark.sparkContext.broadcast(_bitmap(classes.select("h"), _bits(many)))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in _slices(batches):
            batch = batch.filter(pa.array(_in_bitmap(wanted.value, batch.column("id_hash").to_numpy())))
            # Rows that repeat in full are mostly neighbours or alone; those left are dropped below.
            h = batch.column("id_hash").to_numpy()
            batch, last = batch.filter(pa.array(h != np.append([h[0] - 1 if last is None else last], h[:-1]))) if len(h) else batch, h[-1] if len(h) else last
            sets = [shingle_set(data, width) for data in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id_hash"), pa.array([_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["h", "key", "n", "shingles"])
        release()

    sets = some.mapInArrow(collect, "h long, key binary, n long, shingles binary").where("key IS NOT NULL")
    sets = written(sets.join(classes, ["key", "h"]).dropDuplicates(["key", "h"]).select("node", "key", "n", "shingles"), "sets")
    links = _compared(stars.join(sets.select("node", "key", "n"), "node").select("root", "key", "n"), sets.select("key", "shingles"), num, den)
    roots = connected_components(links, "a", "b").withColumnRenamed("root", "_root")

    out = signed.select("doc_id", "text_hash", "n_shingles", "key").join(roots, signed["key"] == roots["node"], "left")
    out = out.withColumn("root", F.coalesce("_root", "key")).drop("node", "_root")
    least = out.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "_root")
    out = out.join(least, out["root"] == least["_root"], "left")
    return out.select("doc_id", "text_hash", "n_shingles", "key", "root", F.coalesce("least", "doc_id").alias("component_id"))


def _compared(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between the keys of each root that join what all its links join.

    Rows are root, key, n; a key may be in several roots. Sets, key and shingles, are fetched
    once the narrow rows have been dealt to tasks. A root of no more than a
    block is one product. A larger one is cut into blocks: first, each block is compared within
    itself and with a few pivots of the root. What this joins to the root's largest component
    needs no more comparisons among itself, so only the others are then compared with all.
    """
    rows = written(rows, "rows")
    weights = rows.groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    weights = weights.withColumn("blocks", F.ceil(F.greatest(F.col("rows") / BLOCK, F.least(F.col("weight") / BLOCK_SHINGLES, F.col("rows") / 2))).cast("int"))
    weights = written(weights, "weights")
    total = weights.agg(F.sum("rows"), F.max("blocks")).first()
    tasks = max(1, (total[0] or 0) // BLOCK)
    rows = written(rows.join(weights.select("root", "blocks"), "root"), "dealt").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    large = rows.where("blocks > 1")
    pivots = large.groupBy("root", F.pmod(F.xxhash64("key", F.lit("pivot")), F.lit(PIVOTS)).alias("p")).agg(F.min("key").alias("key")).select("root", "key")
    pivots = large.join(pivots, ["root", "key"], "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pivots = pivots.where("other != block").withColumn("block", F.col("other")).drop("other")
    first = rows.unionByName(pivots).withColumn("asked", F.lit(True))
    # Small roots share tasks; each is compared by itself there.
    task = F.when(F.col("blocks") > 1, F.xxhash64("root", "block")).otherwise(F.pmod(F.xxhash64("root"), F.lit(tasks)))
    links = first.withColumn("task", task).join(sets, "key").groupBy("task", (F.col("blocks") > 1).alias("cut")).applyInPandas(_links(num, den), "a binary, b binary")
    links = written(links, "links")
    if (total[1] or 0) <= 1:
        return links
    inside = connected_components(links, "a", "b").withColumnRenamed("root", "part")
    large = large.join(inside, large["key"] == inside["node"], "left").withColumn("part", F.coalesce("part", "key")).drop("node")
    large = written(large, "large")
    parts = large.groupBy("root", "part").agg(F.count("*").alias("size"))
    main = parts.groupBy("root").agg(F.max(F.struct("size", "part")).getField("part").alias("main"))
    large = large.join(main, "root")
    asked = large.where("part != main")
    cuts = asked.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.least(F.sum("n") / BLOCK_SHINGLES, F.count("*") / 2))).cast("int").alias("cuts"))
    left = asked.join(cuts, "root").withColumn("cut", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asked", F.lit(True))
    right = large.join(cuts, "root").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("asked", F.lit(False))
    cols = ["root", "key", "cut", "block", "asked"]
    both = left.select(cols).unionByName(right.select(cols))
    # By a hash of its own: by root, the joins' partitioning would do, and a root be one task.
    more = both.withColumn("task", F.xxhash64("root", "cut", "block")).join(sets, "key").groupBy("task").applyInPandas(_links(num, den), "a binary, b binary")
    return written(links.unionByName(more.where("a != b")), "links")


def keep_one_of_each(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id, of the smallest text hash.

    All columns stay. Documents without words stay, each of them; a row that repeats the one that
    stays goes.
    """
    found = written(jaccard_components(docs, num, den, width), "components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    one = found.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("x"))
    *others, mark, own = free_names(docs, "doc_id", "text_hash", "one", "hash")
    named = dict(zip(("doc_id", "text_hash"), others, strict=True))
    one = one.select(*(F.col(f"x.{c}").alias(n) for c, n in named.items())).distinct()
    # Documents without words: their hashes stand for themselves.
    empty = found.where("root IS NULL").select(F.col("doc_id").alias(named["doc_id"]), F.col("text_hash").alias(named["text_hash"])).distinct()
    marked = one.withColumn("_one", F.lit(True)).unionByName(empty.withColumn("_one", F.lit(False)))
    marked = written(marked, "kept").withColumnRenamed("_one", mark)
    hashed = docs.withColumn(own, F.xxhash64("text"))
    got = hashed.join(marked, F.col("doc_id").eqNullSafe(F.col(named["doc_id"])) & F.col(own).eqNullSafe(F.col(named["text_hash"])))
    if found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").head(1):
        got = got.where(F.col(mark)).dropDuplicates(["doc_id", own]).unionByName(got.where(~F.col(mark)))
    return got.select(*docs.columns)
