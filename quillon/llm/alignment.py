"""Alignment of the tokens of two vocabularies by the bytes that they stand for, over Arrow tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.chunks import column, in_chunks, pack, unpack
from quillon.llm.common import release, tokenizer_path, written
from quillon.llm.tokens import ByteIds, loaded

#: Bytes of text whose pairs of ids are counted together, and bytes that are aligned at once.
CHUNK, PART = 4 << 20, 1 << 20
SEPARATORS = (",", "|", ";", "")


def byte_alphabet() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: its own where that is printable, else the next beyond U+00FF."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Plain(ByteIds):
    """Ids by a byte-level vocabulary, special strings in a text being plain text; the bytes of each id."""

    def __init__(self, tokenizer: str):
        super().__init__(tokenizer)
        self.slow.encode_special_tokens = True
        with open(tokenizer_path(tokenizer), encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letter = byte_alphabet()
        of = {i: bytes(letter[c] for c in token) for token, i in vocab.items()}
        self.bytes = pa.array([of.get(i, b"") for i in range(max(of) + 1)], pa.large_binary())

    def encoded(self, texts: list[str]) -> pa.LargeListArray:
        ids = [np.frombuffer(self(t), np.uint32) if t else np.empty(0, np.uint32) for t in texts]
        return _lists(np.concatenate(ids) if ids else np.empty(0, np.uint32), [len(x) for x in ids])


class Pieces:
    """Ids by a vocabulary of pieces, which puts a space before a text; the bytes of each id."""

    def __init__(self, tokenizer: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(tokenizer))
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.large_binary())

    def encoded(self, texts: list[str]) -> pa.LargeListArray:
        ids = self.model.encode([t[1:] for t in texts], num_threads=1)
        return _lists(np.fromiter(chain.from_iterable(ids), np.uint32), [len(x) for x in ids])


def _lists(flat: np.ndarray, sizes: list[int]) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])), pa.array(flat.astype(np.int32)))


def _joined(lists: pa.LargeListArray, words: pa.Array) -> pa.Array:
    """Each list's ids as the words that they stand for, side by side."""
    taken = pa.LargeListArray.from_arrays(lists.offsets, words.take(lists.values))
    return pc.binary_join(taken, pa.scalar("" if pa.types.is_large_string(words.type) else b"", words.type))


class Side:
    """The tokens of one vocabulary, flattened: ids, their documents, where their bytes end."""

    def __init__(self, lists: pa.LargeListArray, words: pa.Array):
        self.ids = pc.list_flatten(lists)
        self.parent = pc.list_parent_indices(lists)
        self.sizes = pc.list_value_length(lists).to_numpy()
        self.lengths = pc.binary_length(words).take(self.ids)
        # Over all documents first, then less what earlier documents have: a sum within each.
        self.total = pc.cumulative_sum(self.lengths) if len(self.ids) else self.lengths
        first = np.cumsum(self.sizes) - self.sizes
        total = self.total.to_numpy()
        before = np.where(first > 0, total[np.maximum(first, 1) - 1], 0) if len(total) else np.zeros(len(first), np.int64)
        self.end = pc.subtract(self.total, pa.array(before).take(self.parent))

    def ends(self, name: str) -> pa.Table:
        return pa.table({"doc": self.parent, "end": self.end, name: np.arange(len(self.ids))})


def align(texts: pa.Array, a: Plain, b: Pieces, names: list[pa.Array]) -> tuple[pa.Table, pa.Table]:
    """For each text its numbers and digest; and its linked pairs of ids, ``doc``, ``a``, ``b``, ``m`` times each."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()))
    known = pc.greater(pc.binary_length(spaced), 1).to_numpy(zero_copy_only=False)
    plain = spaced.filter(pa.array(known))
    strings = plain.to_pylist()
    lists = [x.encoded(strings) for x in (a, b)]
    same = [pc.equal(_joined(ids, x.bytes), plain.cast(pa.large_binary())) for ids, x in zip(lists, (a, b), strict=True)]
    same = pc.and_(*same)
    doc = np.flatnonzero(known)[same.to_numpy(zero_copy_only=False)]
    sa, sb = (Side(ids.filter(same), x.bytes) for ids, x in zip(lists, (a, b), strict=True))
    # Where tokens of both end, a group ends.
    cuts = sa.ends("i").join(sb.ends("j"), keys=["doc", "end"], join_type="inner", use_threads=False)
    ca, cb = np.sort(cuts["i"].to_numpy()), np.sort(cuts["j"].to_numpy())
    ida, idb = sa.ids.to_numpy(), sb.ids.to_numpy()
    parent = sa.parent.to_numpy()
    na, nb = len(ida), len(idb)
    # Tokens of b from the one that holds a token's first byte to the one that holds its last.
    ends_a, ends_b = sa.total.to_numpy(), sb.total.to_numpy()
    low = np.searchsorted(ends_b, ends_a - sa.lengths.to_numpy(), "right")
    n = np.searchsorted(ends_b, ends_a, "left") - low + 1
    first = np.cumsum(n) - n
    j = np.arange(int(n.sum())) - np.repeat(first - low, n)
    links = pa.table({"doc": doc[np.repeat(parent, n)], "a": np.repeat(ida, n), "b": idb[j]})
    links = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["doc", "a", "b", "m"])
    # Digests: each group's ids of a, then of b, each with the sign that follows it.
    ga, gb = np.searchsorted(ca, np.arange(na)), np.searchsorted(cb, np.arange(nb))
    code = np.empty(na + nb, np.int64)
    va, vb = len(names[0]) // 4, len(names[1]) // 4
    last_b = np.zeros(nb, bool)
    if nb:
        last_b[np.cumsum(sb.sizes)[sb.sizes > 0] - 1] = True
    in_a, in_b = np.arange(na) == ca[ga] if na else np.empty(0, bool), np.arange(nb) == cb[gb] if nb else np.empty(0, bool)
    code[np.arange(na) + np.concatenate([[0], cb + 1])[ga]] = ida + va * np.where(in_a, 1, 0)
    code[np.arange(nb) + (ca + 1)[gb] if nb else np.empty(0, np.int64)] = idb + 4 * va + vb * np.where(last_b, 3, np.where(in_b, 2, 0))
    strings = _joined(_codes(code, sa.sizes + sb.sizes), pa.concat_arrays(names))
    out = {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    out["n_a"][doc], out["n_b"][doc] = sa.sizes, sb.sizes
    out["n_groups"][doc] = np.bincount(parent[ca], minlength=len(doc)) if len(doc) else 0
    out["n_links"][doc] = np.bincount(parent, n, len(doc)) if len(doc) else 0
    digest = np.full(len(texts), "", object)
    digest[doc] = [hashlib.sha256(s.as_buffer()).hexdigest() for s in strings]
    return pa.table({**out, "groups_sha256": pa.array(digest, pa.string())}), links


def _codes(code: np.ndarray, sizes: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])), pa.array(code))


def _signed(n: int) -> pa.Array:
    """Each id in decimal, with each sign that may follow."""
    return pa.array([f"{i}{s}" for s in SEPARATORS for i in range(n)], pa.large_string())


class Both:
    """Both vocabularies of a worker."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Plain(a), Pieces(b)
        self.names = [_signed(len(self.a.bytes)), _signed(len(self.b.bytes))]


def align_tokens(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """How the tokens of a byte-level vocabulary ``a`` and of pieces ``b`` lie over each other, for each row of ``docs``.

    A text with a space before it is encoded by both, without special tokens, whose strings are
    plain text. Byte offsets at which tokens of both end cut them into groups; tokens whose bytes
    overlap are linked. Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256: the count of a pair of ids is the number of rows in which it is linked;
    ``count_sum`` adds it up over links, ``n_best`` are links whose count is the highest that their
    a id has, ties included; the digest is that of ``a1,a2|b1;a3|b2,b3``. A text that is null,
    empty, or not given back by the tokens' bytes, has zeros and no digest, and counts for no pair.
    Rows that repeat count each; doc_id of any type and null is kept, other columns aren't read;
    an empty table gives an empty one.

    Arrow does the work: lists of ids are flattened, parent indices and cumulative sums of token
    lengths within each document give the ends, a hash join on (document, end) the groups,
    ``group_by`` the distinct pairs of each document and the partial counts of a chunk of 4 MB.
    Spark merges these, finds the best count of each a id (one row for each entry of the
    vocabulary, which is broadcast) and brings a chunk the counts of its own pairs. A pair that
    all documents have is one row for each chunk.
    """

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = loaded(Both, a, b)
        for number, chunk in in_chunks(batches, CHUNK):
            told, linked = [], []
            text = column(chunk, "text").cast(pa.large_string())
            sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy())
            at = 0
            while at < len(chunk):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART, "right")))
                numbers, links = align(text.slice(at, to - at), both.a, both.b, both.names)
                told.append(numbers)
                linked.append(links.set_column(0, "doc", pc.add(links["doc"], at)))
                at = to
            links = pa.concat_tables(linked).combine_chunks()
            pairs = links.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
            key = pc.bit_wise_or(pc.shift_left(pairs["a"].cast(pa.int64()), 32), pairs["b"].cast(pa.int64()))
            links = links.sort_by([("doc", "ascending"), ("a", "ascending"), ("b", "ascending")]).cast(pa.schema({"doc": pa.uint16(), "a": pa.int32(), "b": pa.int32(), "m": pa.int32()}))
            told = pa.concat_tables(told).combine_chunks().add_column(0, "doc_id", chunk["doc_id"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([pack(told)], pa.binary()), pa.array([pack(links)], pa.binary()), one(key.combine_chunks()), one(pairs["count_all"].combine_chunks())],
                ["chunk", "told", "links", "pair", "n"],
            )
        release()

    laid = written(docs.select("doc_id", "text").mapInArrow(lay, "chunk long, told binary, links binary, pair array<long>, n array<long>"), "aligned")
    partial = laid.select("chunk", F.explode(F.arrays_zip("pair", "n")).alias("p")).select("chunk", F.col("p.pair").alias("pair"), F.col("p.n").alias("n"))
    counts = written(partial.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32)), "pairs")
    # At most one row for each id of the vocabulary.
    best = counts.groupBy(F.col("a").alias("_a")).agg(F.max("count").alias("_best"))
    counts = counts.join(F.broadcast(best), counts["a"] == best["_a"]).select(F.col("pair").alias("_pair"), "count", (F.col("count") == F.col("_best")).alias("best"))
    known = partial.join(counts, partial["pair"] == counts["_pair"]).select(F.col("chunk").alias("to"), "pair", "count", "best")

    def sums(own: pa.Table, known: pa.Table) -> pa.Table:
        told, links = unpack(column(own, "told")[0]), unpack(column(own, "links")[0])
        pair, count, is_best = (column(known, k).to_numpy(zero_copy_only=False) for k in ("pair", "count", "best"))
        order = np.argsort(pair)
        key = (column(links, "a").to_numpy().astype(np.int64) << 32) | column(links, "b").to_numpy()
        at = order[np.searchsorted(pair[order], key)] if len(key) else np.empty(0, np.int64)
        doc, m = column(links, "doc").to_numpy(), column(links, "m").to_numpy().astype(np.int64)
        added = np.zeros((2, len(told)), np.int64)
        np.add.at(added[0], doc, m * is_best[at])
        np.add.at(added[1], doc, m * count[at])
        return told.add_column(5, "n_best", pa.array(added[0])).add_column(6, "count_sum", pa.array(added[1]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return laid.select("chunk", "told", "links").groupBy("chunk").cogroup(known.groupBy("to")).applyInArrow(sums, schema)
