"""Documents in chunks of bounded size: rows that tasks exchange statistics about, packed by Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Bytes of text of a chunk, at most (a longer text is one by itself), and rows.
CHUNK, ROWS = 2 << 20, 1 << 14


def pack(table: pa.Table) -> bytes:
    """A table as bytes, compressed."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def unpack(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a table as one array."""
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def in_chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK, rows: int = ROWS) -> Iterator[tuple[int, pa.Table]]:
    """Chunks of doc_id and text, each with a number that no other task gives.

    A number holds until the chunks are written; a task that runs again may number others.
    """
    number = TaskContext.get().partitionId() << 24
    held, held_bytes, held_rows = [], 0, 0
    for batch in batches:
        batch = pa.table({"doc_id": batch["doc_id"], "text": batch["text"].cast(pa.large_binary())})
        lengths = np.frombuffer(column(batch, "text").buffers()[1], np.int64)
        offset = column(batch, "text").offset
        lengths = np.diff(lengths[offset : offset + len(batch) + 1])
        at = 0
        while at < len(batch):
            fits = int(np.searchsorted(np.cumsum(lengths[at : at + rows - held_rows]) + held_bytes, size, "right"))
            take = fits if fits or held_rows else 1
            if take:
                held.append(batch.slice(at, take))
                held_bytes, held_rows, at = held_bytes + int(lengths[at : at + take].sum()), held_rows + take, at + take
            if at < len(batch) or held_bytes >= size or held_rows >= rows:
                yield number, pa.concat_tables(held).combine_chunks()
                number, held, held_bytes, held_rows = number + 1, [], 0, 0
    if held:
        yield number, pa.concat_tables(held).combine_chunks()


def texts_of(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a chunk's texts and where each begins and ends; none for null."""
    text = column(chunk, "text")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets

