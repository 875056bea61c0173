"""Embedding operators: near-duplicates by sign hashing, exact top-k by score bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, written

#: Rows of a block; a task compares two blocks at most.
BLOCK = 1024
#: Expected part of the pairs exactly at the threshold that some table brings together.
RECALL = 0.995
#: Rows that share a bucket by chance, about, from which the number of bits follows.
BY_CHANCE = 64
SEED = 20240229


def usable(vector: str) -> F.Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def planes_for(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a table and number of tables for so many rows of a label.

    Two vectors at the threshold fall on one side of a random hyperplane with probability
    p = 1 - arccos(threshold) / pi, and share a table of k bits with p^k.
    """
    bits = max(6, math.ceil(math.log2(max(1, rows) / BY_CHANCE)) if rows > BY_CHANCE else 0)
    bits = min(bits, 30)
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - p)))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs out of (a, b) that join the same of n items as all of them do."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((i, j))
    return kept


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Links between vectors of one label with a cosine of at least ``threshold``: one row per vector.

    Columns: vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    reachable), kept (vec_id is that). Random hyperplanes give each vector one bucket in each of
    several tables; their number follows from the rows and the threshold, see `planes_for`.
    Vectors alike in all components are one class, compared once, whose copies count. Classes of a bucket are compared exactly, in double precision, a pair of blocks of at most
    ``BLOCK`` rows in a task at a time. A pair is counted in the first table that has it in one
    bucket, so tasks return counts and a spanning forest, never pairs.

    Null, zero, or non-finite vectors and those without a label have no links and stand alone;
    vectors of different lengths don't link. Rows that repeat are rows of their own and link with
    each other. An empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding"))
    rows = rows.withColumn("_ok", F.col("label").isNotNull() & usable("embedding") & F.exists("embedding", lambda x: x != 0))
    # Vectors alike in all components are one class; 128 bits name it.
    same = [F.when(F.col("_ok"), F.xxhash64(F.lit(salt), "label", "embedding")) for salt in ("a", "b")]
    rows = written(rows.select("*", *(h.alias(f"_h{i}") for i, h in enumerate(same)), F.monotonically_increasing_id().alias("row")), "vectors")
    copies = rows.where("_ok").groupBy("_h0", "_h1").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    live = written(copies.withColumn("dim", F.size("embedding")), "classes")
    most = live.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = planes_for(most, threshold)

    def sign(batches):
        drawn: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                if dim not in drawn:
                    drawn[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))
                sides = np.stack(part["embedding"].to_numpy()).astype(np.float64) @ drawn[dim] > 0
                part = part.assign(codes=list((sides.reshape(len(part), tables, bits) * weights).sum(2)))
                yield part[["row", "copies", "label", "dim", "embedding", "codes"]]

    label, kind = (live.schema[x].dataType.simpleString() for x in ("label", "embedding"))
    signed = live.select("row", "copies", "label", "dim", "embedding").mapInPandas(sign, f"row long, copies long, label {label}, dim int, embedding {kind}, codes array<long>")
    signed = written(signed, "signed")

    # Buckets of more than a block are dealt to blocks; each row goes to the pairs its block is in.
    member = signed.select("row", "label", "dim", F.posexplode("codes").alias("table", "code"))
    key = ["label", "dim", "table", "code"]
    sizes = member.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    member = member.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("row", "table"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
    member = member.withColumn("pair", F.explode(pair)).select("row", *key, "block", "pair.i", "pair.j")
    work = member.join(signed.select("row", "copies", "embedding", "codes"), "row")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        vectors /= np.abs(vectors).max(1, keepdims=True)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        codes = np.stack(pdf["codes"].to_numpy())
        linked = vectors @ vectors.T >= threshold
        for t in range(int(pdf["table"].iloc[0])):  # counted in an earlier table
            linked &= codes[:, t][:, None] != codes[:, t][None, :]
        np.fill_diagonal(linked, False)
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:  # pairs within a block are compared where i = j
            block = pdf["block"].to_numpy()
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(linked))
        forest = _forest(len(pdf), a, b)
        ids = pdf["row"].to_numpy()
        n = linked @ pdf["copies"].to_numpy()
        some = n > 0
        out = [pd.DataFrame({"row": ids[some], "n": n[some], "other": pd.array([pd.NA] * int(some.sum()), "Int64")})]
        if forest:
            x, y = np.array(forest).T
            out.append(pd.DataFrame({"row": ids[x], "n": 0, "other": pd.array(ids[y], "Int64")}))
        return pd.concat(out)

    found = written(work.groupBy(*key, "i", "j").applyInPandas(compare, "row long, n long, other long"), "links")
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("other IS NOT NULL"), "row", "other")
    # A class's copies link with each other too.
    classes = live.select("_h0", "_h1", "row", "copies").join(counts, "row", "left").join(roots, F.col("row") == F.col("node"), "left")
    classes = classes.select(F.col("_h0").alias("_c0"), F.col("_h1").alias("_c1"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "row").alias("root"))
    out = rows.select("vec_id", "_h0", "_h1").join(classes, (F.col("_h0") == F.col("_c0")) & (F.col("_h1") == F.col("_c1")), "left")
    least = out.where("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least")).withColumnRenamed("root", "_root")
    out = out.join(least, out["root"] == least["_root"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: Candidates of a shard and queries of a block, at most: what a task holds.
SHARD, QUERIES = 16384, 16384
#: Non-essential terms that are probed before the bounds are looked at again.
STEP = 4
LONG = (1 << 63) - 1


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for each query: query_id, rank, vec_id, score.

    Components count as floor(scale * x). Queries are the rows whose vec_id is divisible by
    ``every``, candidates all rows but the query's own; ties go to the smaller vec_id. Each
    dimension is a term; its posting list in a shard is the shard's column of values, as dense
    vectors are in all lists.

    MaxScore: each query first meets one shard in full; its k-th best score there is the
    threshold for all others. In these, the terms with the smallest bounds that can't lift a
    candidate to the threshold together are non-essential. The essential postings are traversed
    and added up; the other terms are probed, those with high bounds first, only for candidates
    whose sum plus the bounds of the rest is still competitive. A shard without essential terms is
    left out. Bounds are whole numbers, so no candidate is lost. The shards' best rows are merged.

    Null vectors and those with null or non-finite components take no part; vectors of different
    lengths have no product. Components and scores beyond 64 bits count as the nearest number that
    has them. Rows that repeat take part each; a query row isn't its own candidate, its repeats
    are. A null vec_id is no query and comes last among ties. An empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable("embedding"))
    # No nulls: pandas would turn ids beside them into doubles.
    none = F.col("vec_id").isNull()
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(0).cast("long")).alias("vec_id"), none.alias("none"), F.transform("embedding", lambda x: F.floor(x * float(scale))).alias("v"))
    rows = written(rows, "integers")
    asked = rows.where((F.col("vec_id") % every == 0) & ~F.col("none"))
    shards, blocks = max(1, math.ceil(rows.count() / shard)), max(1, math.ceil(asked.count() / queries))
    dealt = lambda n, *salt: F.pmod(F.xxhash64("row", *map(F.lit, salt)), F.lit(n)).cast("int")
    cand = rows.withColumn("s", dealt(shards))
    # Names of their own: both sides of a cogroup come from one table.
    asked = asked.select(*(F.col(c).alias(c) for c in rows.columns), dealt(shards, "home").alias("home"), dealt(blocks).alias("b"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            c = c.assign(dim=c["v"].map(len))
            for dim, part in c.groupby("dim"):
                own = q[q["v"].map(len) == dim]
                if len(own):
                    out += _search(own, part, k)
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "none", "score"])

    schema = "query_row long, query_id long, vec_id long, none boolean, score long"
    unknown = [F.lit(0).cast("long").alias("least"), F.lit(False).alias("known")]
    first = asked.select("row", "vec_id", "v", *unknown, F.col("home").alias("s")).groupBy("s").cogroup(cand.groupBy("s")).applyInPandas(search, schema)
    first = written(first, "first")
    least = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).select(F.col("query_row").alias("_row"), F.col("least").alias("_least"))
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    others = asked.join(least, asked["row"] == least["_row"], "left").withColumns({"known": F.col("_least").isNotNull(), "least": F.coalesce("_least", F.lit(0).cast("long"))}).withColumn("s", F.explode(numbers(shards))).where("s != home")
    rest = others.select("row", "vec_id", "v", "least", "known", "s", "b").groupBy("s", "b").cogroup(cand.withColumn("b", F.explode(numbers(blocks))).groupBy("s", "b")).applyInPandas(search, schema)
    # Spark keeps k rows of a query in each task before the shuffle.
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "none", "vec_id")
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), "score")


def _search(q: pd.DataFrame, c: pd.DataFrame, k: int) -> list[tuple]:
    """The best ``k`` candidates of a shard for each query, of those that reach the query's ``least``."""
    c = c.sort_values(["none", "vec_id"], kind="stable")
    ids, none, own = c["vec_id"].to_numpy(), c["none"].to_numpy(), c["row"].to_numpy()
    postings = np.stack(c["v"].to_numpy()).astype(np.int64).T
    asked = np.stack(q["v"].to_numpy()).astype(np.int64)
    # Sums that doubles hold exactly go through them, as their products are fast; Python's numbers hold any.
    most = sum(x * y for x, y in zip(_widest(asked.T), _widest(postings), strict=True))
    kind = np.float64 if most < 1 << 53 else object
    postings, asked = np.ascontiguousarray(postings.astype(kind)), asked.astype(kind)
    low, high = postings.min(1), postings.max(1)
    out = []
    for row, query_id, least, known, v in zip(q["row"], q["vec_id"], q["least"], q["known"], asked, strict=True):
        upper, lower = np.maximum(v * low, v * high), np.minimum(v * low, v * high)
        bounds = upper - lower
        terms = np.argsort(bounds, kind="stable")
        least = int(least) if known else None
        outside = int((np.cumsum(bounds[terms]) + lower.sum() < least).sum()) if known else 0
        probed, essential = terms[:outside][::-1], terms[outside:]
        if known and not len(essential):
            continue
        score = v[essential] @ postings[essential]
        alive = np.flatnonzero(own != row)
        score = score[alive]
        up, down = ([*np.cumsum(x[probed][::-1])[::-1], 0] for x in (upper, lower))
        for at in range(0, outside + 1, STEP):
            at = min(at, outside)
            if len(alive) > k:
                best = np.partition(score, len(score) - k)[len(score) - k] + down[at]
                competitive = score + up[at] >= (max(least, best) if known else best)
            else:
                competitive = score + up[at] >= least if known else np.ones(len(alive), bool)
            competitive = np.asarray(competitive, bool)
            if not competitive.all():
                alive, score = alive[competitive], score[competitive]
            now = probed[at : at + STEP]
            if len(now):
                score = score + v[now] @ postings[np.ix_(now, alive)]
        if known:
            reached = np.asarray(score >= least, bool)
            alive, score = alive[reached], score[reached]
        if len(score) > k:
            worst = np.partition(score, len(score) - k)[len(score) - k]
            top = np.asarray(score >= worst, bool)
            alive, score = alive[top], score[top]
        best = sorted(range(len(alive)), key=lambda i: (-score[i], alive[i]))[:k]
        out += [(row, query_id, ids[alive[i]], none[alive[i]], max(-LONG - 1, min(LONG, int(score[i])))) for i in best]
    return out


def _widest(columns: np.ndarray) -> list[int]:
    return [max(abs(int(x.min())), abs(int(x.max()))) for x in columns]
