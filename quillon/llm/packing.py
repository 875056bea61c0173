"""Best-fit packing of documents into sequences of bounded length by the sum of squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import release, written
from quillon.llm.tokens import ByteIds, loaded

#: Pieces that are packed together, on average. A group wastes about one sequence.
GROUP = 4096
#: Documents whose pieces leave a task together.
ROWS = 512


def tokenized_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Cut each document's ids, ``end_id`` last, into pieces of at most ``capacity``.

    The ids are those of ``tokenizers``; for plain Latin texts ``tiktoken`` gives them by the same
    merges (see ``ByteIds``, whose tests compare whole tables and random texts).

    Columns: doc_id, piece, start, length, ids_crc32 and, with ``keep_ids``, ids. Only longer
    documents are cut; their first piece takes what is over. A null text is an empty one: one
    piece that holds ``end_id`` alone. Repeated rows give repeated pieces. Other columns of
    ``docs`` are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = loaded(ByteIds, tokenizer)
        end = int(end_id).to_bytes(4, "little")
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            of, rows, parts = [], [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                ids = (ids_of(text) if text else b"") + end
                n = len(ids) // 4
                first = n % capacity if n > capacity else n
                at = [0, *range(first or capacity, n, capacity), n]
                for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    of.append(k)
                    rows.append((i, a, b - a, zlib.crc32(part)))
                    parts += [part] * keep_ids
            numbers = np.array(rows, np.int64).reshape(-1, 4)
            columns = [batch["doc_id"].take(pa.array(of, pa.int64())), pa.array(numbers[:, 0].astype(np.int32)), *(pa.array(numbers[:, i]) for i in (1, 2, 3))]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(numbers[:, 2])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])
        release()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, long items first.

    ``open_bins[g]`` counts the bins that have room for g more. An item goes where the sum of
    the squares of these counts becomes smallest; a new bin is opened only if no open one has
    room. Ties go to the smallest gap that is left.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    never = 1 << 60
    for i in order:
        n = int(lengths[i])
        change = np.where(open_bins[n:] > 0, open_bins[: capacity + 1 - n] - open_bins[n:] + 1, never) * 2
        if open_bins[n]:
            change[0] = 1 - 2 * open_bins[n]  # a full bin is no longer open
        left = int(change.argmin())
        if change[left] < never:
            gap = left + n
            where = stacks[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, where = capacity, made
            made += 1
            left = capacity - n
        bins[i], offsets[i] = where, capacity - gap
        if left:
            open_bins[left] += 1
            stacks[left].append(where)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length, ...), each at most ``capacity`` long.

    Full pieces are sequences of their own and aren't grouped. The others are dealt to groups of about ``group``
    by a hash of the whole piece and packed there; the number of groups follows the number of
    pieces, so that a group's size doesn't depend on the input, and a task holds one group. The
    written table of pieces is both counted and packed. Sequence ids are unique, with gaps.
    """
    cols = pieces.columns
    pieces = written(pieces, "pieces")
    groups = max(1, round(pieces.where(F.col("length") < capacity).count() / group))
    # Rows that repeat in full would meet in one group: the partition they are in tells them apart.
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(groups)))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        # Group numbers are below 2^31 and a group's bins too.
        ids = (rows["_group"].to_numpy().astype(np.int64) << 31) + bins
        release()
        return rows.select(cols).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    short = dealt.where(F.col("length") < capacity).groupBy("_group").applyInArrow(place, f"{types}, sequence_id long, offset long")
    full = pieces.where(F.col("length") >= capacity)
    # Negative ids: nothing else than the row's own number in its partition of the written table.
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return short.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Token sequences of at most ``capacity``: every document's pieces and their places.

    Columns: doc_id long, piece int, start long, length long, ids_crc32 long, [ids], sequence_id
    long, offset long. Within a sequence the offsets are gapless from 0. An empty table gives an
    empty one; null and repeated doc_ids are kept as they are.
    """
    return pack(tokenized_pieces(docs, tokenizer, capacity, end_id, keep_ids), capacity)
