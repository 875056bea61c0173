"""Language identification by n-gram filters that answer with bitmasks of languages."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import free_names, release, written

UNKNOWN = "und"
#: Slots of the filter, a power of two. With its masks it is what a worker holds and the driver sends.
SLOTS = 1 << 20
#: At most about so many labelled documents of each language are learned from, by a hash of doc_id.
LEARNED_DOCUMENTS = 6000
#: An n-gram belongs to a language if at least this share of the language's n-grams is it,
#: and at least ``NEAR_BEST`` of its share in the language where it is most frequent.
LEAST_SHARE, NEAR_BEST = 2e-6, 0.2
#: Characters, and rows, that are worked on at once.
SLICE, ROWS = 1 << 18, 1024
SPACE = 32


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the third that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the 3- and 4-grams of words, a space at each end, and the text each is of.

    Letters count in lower case; all else separates words.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    owner = np.append(owner, len(low) - 1)
    letter = letters()[codes]
    # Only one separator stands between words, so that each word has the same n-grams everywhere.
    keep = letter | np.append(letter[1:], True) | (np.arange(len(codes)) == 0)
    c = np.where(letter, codes, SPACE).astype(np.uint64)[keep]
    letter, owner = letter[keep], owner[keep]
    found, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for n in (3, 4):
        if len(c) < n:
            continue
        m = len(c) - n + 1
        inner = letter[1 : 1 + m].copy()
        for i in range(2, n - 1):
            inner &= letter[i : i + m]
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + m]
        h = h[inner]
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        found.append(h ^ (h >> np.uint64(31)))
        owners.append(owner[1 : 1 + m][inner])
    return np.concatenate(found), np.concatenate(owners)


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Filter:
    """A Bloom filter with a bitmask of languages in each slot, 64 languages to a plane.

    The masks of an n-gram's two slots and-ed together name all languages that have it, besides
    false positives: a language that fills the share f of its bits is named for nothing at f^2.
    """

    def __init__(self, languages: list[str], planes: np.ndarray):
        self.languages, self.planes = languages, planes
        bit = lambda i: planes[i // 64] >> np.uint64(i % 64) & np.uint64(1)
        self.false = np.array([float(bit(i).mean()) ** 2 for i in range(len(languages))])

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its n-grams, and the share of them that each language has, corrected for false positives."""
        h, owner = ngrams(texts)
        total = np.bincount(owner, minlength=len(texts))
        low = np.uint64(SLOTS - 1)
        a, b = (h & low).astype(np.int64), (h >> np.uint64(32) & low).astype(np.int64)
        hits = np.zeros((len(texts), len(self.languages)))
        for p, plane in enumerate(self.planes):
            masks = plane[a] & plane[b]
            for i in range(64 * p, min(64 * p + 64, len(self.languages))):
                hits[:, i] = np.bincount(owner, (masks >> np.uint64(i % 64) & np.uint64(1)).astype(float), len(texts))
        n = np.maximum(total, 1)[:, None]
        return total, np.clip((hits - n * self.false) / (n * np.maximum(1 - self.false, 1e-9)), 0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language with the highest share, the first of equal ones; that share is the score."""
        said, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return said, scores
        given = [i for i, t in enumerate(texts) if t]
        for start, end in _slices([len(texts[i]) for i in given]):
            rows = given[start:end]
            total, shares = self.shares([texts[i] for i in rows])
            best = shares.argmax(1)
            for i, n, k, s in zip(rows, total, best, shares[np.arange(len(rows)), best], strict=True):
                if n:
                    said[i], scores[i] = self.languages[k], s
        return said, scores


def learn(docs: DataFrame, per_language: int = LEARNED_DOCUMENTS) -> Filter:
    """Learn from doc_id, text and lang of documents that aren't held out and have a lang.

    The sample is bounded: where a language has more than ``per_language`` such documents, those
    with the smallest hashes are taken, about that many. Statistics of n-grams are aggregated on
    Spark; the driver gets the filter's slots, at most ``SLOTS`` rows, and the languages.
    """
    seen = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Filter([], np.zeros((1, SLOTS), np.uint64))
    spread = 1 << 32
    limits = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(int(spread * min(1.0, per_language / counts[k]))))))
    few = seen.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(spread)) < F.element_at(limits, F.col("lang")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch[batch["text"].notna()].groupby("lang"):
                texts = part["text"].tolist()
                for start, end in _slices([len(t) for t in texts]):
                    grams, n = np.unique(ngrams(texts[start:end])[0].view(np.int64), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})
        release()

    grams = few.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A language's n-grams are many, a gram's languages few: only totals go by language.
    totals = docs.sparkSession.createDataFrame([(k, i) for i, k in enumerate(languages)], "lang string, bit int")
    grams = written(grams, "grams")
    totals = totals.join(grams.groupBy("lang").agg(F.sum("n").alias("total")), "lang")
    grams = grams.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    grams = grams.withColumn("best", F.max("share").over(Window.partitionBy("gram")))
    kept = grams.where((F.col("n") > 1) & (F.col("share") >= LEAST_SHARE) & (F.col("share") >= NEAR_BEST * F.col("best")))
    low = F.lit(SLOTS - 1).cast("long")
    slot = F.explode(F.array(F.col("gram").bitwiseAND(low), F.shiftrightunsigned("gram", 32).bitwiseAND(low)))
    planes = (len(languages) + 63) // 64
    mask = lambda p: F.bit_or(F.when(F.floor(F.col("bit") / 64) == p, F.expr(f"shiftleft(1L, bit - {64 * p})")).otherwise(F.lit(0).cast("long"))).alias(f"m{p}")
    slots = kept.select(slot.alias("slot"), "bit").groupBy("slot").agg(*(mask(p) for p in range(planes))).toArrow()
    table = np.zeros((planes, SLOTS), np.uint64)
    for p in range(planes):
        table[p, slots["slot"].to_numpy()] = slots[f"m{p}"].to_numpy().view(np.uint64)
    return Filter(languages, table)


def with_language(docs: DataFrame, model: Filter, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two columns more, from ``text`` alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            said, scores = sent.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, pred, score])
        release()

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def identify_languages(docs: DataFrame, per_language: int = LEARNED_DOCUMENTS) -> DataFrame:
    """Language of every text: doc_id, held_out, lang_pred, score.

    lang_pred is a learned lang, or ``und`` where the text is null or has no letter, or nothing
    could be learned; its score is 0. Whole texts count; lang, source and doc_id take no part in
    a prediction. Repeated rows give repeated results.
    """
    model = learn(docs, per_language)
    rows = with_language(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.05, per_language: int = LEARNED_DOCUMENTS) -> DataFrame:
    """``docs`` without those whose language can't be told: ``und``, or a score below ``least``.

    All columns stay as they are, whatever their names.
    """
    pred, score = free_names(docs, "pred", "score")
    rows = with_language(docs, learn(docs, per_language), pred, score)
    return rows.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
