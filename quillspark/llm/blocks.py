"""Documents in blocks: a stored table with one row for some megabytes of whole texts.

A block is what a worker handles at once. It asks a table that is too large for any worker about the distinct keys of
its texts, one row for each (block, key), and gets one answer for each; a key that a third of all texts hold is then
one row a block, and no text moves but with its compressed block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, small_batches, stored, tidy
from .words import arrow_bytes, spans

#: Of the compressed texts: blocks are written once and dealt once.
LEVEL = 9
SCHEMA = f"{P}block long, ids array<{{}}>, sizes array<int>, raw long, blob binary"


def _gather(most: int, encode: Callable[[bytes, np.ndarray], bytes] | None, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held, size, codec = [], 0, pa.Codec("zstd", compression_level=level)

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            raw = b"".join(h[2] for h in held)
            raw = raw if encode is None else encode(raw, sizes)
            row = [pa.array([first + made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sizes], pa.list_(pa.int32()))]
            row += [pa.array([len(raw)], pa.int64()), pa.array([codec.compress(raw, asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, [f"{P}block", "ids", "sizes", "raw", "blob"])

        for b in batches:
            data, offsets = arrow_bytes(b.column("text"))
            sizes = np.where(np.asarray(b.column("text").is_null()), -1, np.diff(offsets)).astype(np.int32)
            for lo, hi in spans(offsets, most):
                n = int(offsets[hi] - offsets[lo])
                if held and size + n > most:
                    yield block()
                    held, size, made = [], 0, made + 1
                held.append((b.column("id").slice(lo, hi - lo), sizes[lo:hi], data[offsets[lo] : offsets[hi]].tobytes()))
                size += n
        if held:
            yield block()

    return tidy(run)


def blocks(docs: DataFrame, id_col: str, text_col: str, most: int, encode: Callable[[bytes, np.ndarray], bytes] | None = None, level: int = LEVEL) -> DataFrame:
    """``__qs_block``, ids, sizes (bytes of each text, -1 for null), raw, blob: at most ``most`` bytes a block, or one text.
    ``encode`` makes of the texts end to end, and their sizes, what a block keeps instead of them."""
    kind = docs.schema[id_col].dataType.simpleString()
    with small_batches(docs.sparkSession, 1000):
        return stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_gather(most, encode, level), SCHEMA.format(kind)), "blocks")


def texts_of(sizes, raw: int, blob: bytes) -> tuple[pa.Array, np.ndarray]:
    """A block's texts as one Arrow array (null as empty), and which were null."""
    sizes = np.asarray(sizes, np.int64)
    offsets = np.r_[0, np.cumsum(np.maximum(sizes, 0))]
    data = pa.decompress(blob, int(raw), "zstd") if raw else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), data), sizes < 0


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray]]:
    """block, ids, texts, nulls of each block row."""
    for b in batches:
        for i in range(b.num_rows):
            block, sizes, raw, blob = (b.column(c)[i] for c in (f"{P}block", "sizes", "raw", "blob"))
            yield block.as_py(), b.column("ids")[i].values, *texts_of(sizes.values, raw.as_py(), blob.as_py())


def packed(rows: DataFrame, most: int = 1 << 19) -> DataFrame:
    """Rows with a column ``__qs_block`` as ``__qs_block``, blob: those of one block among ``most`` rows of a task, compressed by columns.

    What goes back to a block is many narrow rows; by columns they take about half the room in a shuffle.
    """

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        block = np.asarray(table.column(f"{P}block"), np.int64)
        order = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
        table, out = table.take(pa.array(order)).drop_columns([f"{P}block"]), []
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(block)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table.slice(lo, hi - lo).combine_chunks())
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[order][cut]), pa.array(out, pa.binary())], [f"{P}block", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= most:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    return rows.mapInArrow(tidy(run), f"{P}block long, blob binary")


def unpacked(table: pa.Table) -> pa.Table | None:
    """The rows of :func:`packed`, or None where there are none."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("blob")]
    return pa.concat_tables(parts) if parts else None
