"""Sparse rows packed into blocks for vectorised passes.

A block is one row of a written table: some of the matrix's rows with their
non-zeros as byte strings (offsets, indices, entries) beside byte strings of per-row
columns.  ``summed`` maps blocks to partial sums and adds them up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import write_and_reload

#: non-zeros of a block (a longer row is a block of its own); rows of sums in one piece
BLOCK_ENTRIES, PIECE = 1 << 16, 1 << 14
#: partial sums that may go to the driver unadded
DIRECT_BYTES = 32 << 20


def pack(rows: DataFrame, columns, names: list[str]) -> DataFrame:
    """Blocks of ``rows``: ``columns(batch)`` gives the per-row columns called ``names``, and the
    offsets, indices and values of the non-zeros."""
    every = [*names, "offsets", "indices", "entries"]

    def run(batches):
        for batch in batches:
            own, off, index, value = columns(batch)
            a, n = 0, batch.num_rows
            while a < n:
                b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_ENTRIES, side="right")) - 1))
                parts = [*[c[a:b] for c in own], off[a:b + 1] - off[a], index[off[a]:off[b]], value[off[a]:off[b]]]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], names=every)
                a = b

    return write_and_reload(rows.mapInArrow(run, ", ".join(f"{c} binary" for c in every)), "row_blocks")


def entries(raw: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, indices, values) of a block."""
    return np.frombuffer(raw["offsets"], np.int64), np.frombuffer(raw["indices"], np.int32), np.frombuffer(raw["entries"])


def rows_of(batches):
    """The blocks of Arrow batches, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(j)[k].as_py() for j, c in enumerate(batch.schema.names)}


def products(off, index, value, dense: np.ndarray) -> np.ndarray:
    """Block times ``dense`` (columns of the matrix x width)."""
    out = np.zeros((len(off) - 1, dense.shape[1]))
    some = np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.add.reduceat(value[:, None] * dense[index], off[some], axis=0)
    return out


def add_transposed(out: np.ndarray, off, index, value, dense: np.ndarray) -> None:
    """out += transposed block times ``dense`` (rows of the block x width)."""
    if len(index):
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        order = np.argsort(index, kind="stable")
        cut = np.flatnonzero(np.diff(index[order], prepend=-1))
        out[index[order][cut]] += np.add.reduceat((value[:, None] * dense[row])[order], cut, axis=0)


def summed(packed: DataFrame, one_block, size: int, width: int) -> np.ndarray:
    """Sum over all blocks of what ``one_block(out, block)`` adds to out (size, width)."""
    def part(batches):
        out = None
        for block in rows_of(batches):
            out = np.zeros((size, width)) if out is None else out
            one_block(out, block)
        for at in range(0, size if out is not None else 0, PIECE):
            piece = out[at:at + PIECE]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([piece.tobytes()], pa.binary())], names=["at", "sums"])

    return added(packed.mapInArrow(part, "at bigint, sums binary"), packed.rdd.getNumPartitions(), size, width)


def added(parts: DataFrame, partitions: int, size: int, width: int) -> np.ndarray:
    """Sum of partial results (at, sums): rows ``at`` and following of a (size, width) matrix; added up by an
    exchange first where ``partitions`` of them could be more than ``DIRECT_BYTES``."""
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[at] = sums.get(at, 0) + np.frombuffer(raw)
        for at, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], names=["at", "sums"])

    if partitions * size * width * 8 > DIRECT_BYTES:
        parts = parts.repartition("at").mapInArrow(add, "at bigint, sums binary")
    found = parts.toArrow()
    out = np.zeros((size, width))
    for at, raw in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        piece = np.frombuffer(raw).reshape(-1, width)
        out[at:at + len(piece)] += piece
    return out
