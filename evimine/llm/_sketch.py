"""Count-min sketches built per partition and merged cell by cell.

A partition's sketch is cut into blocks of cells; blocks meet in a tree of shuffles, at most FAN_IN partial blocks in one
task, so neither a task nor the driver ever holds more than a bounded number of bounded blocks. The merged sketch has a
fixed number of cells, whatever the input, and is what executors receive. It is written before the driver reads it, AT_ONCE
blocks at a time, so that the driver holds it once and not once more for each way that results take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimine.llm import _text
from evimine.llm._spark import cut, forget

#: Partial blocks merged by one task; names gathered before they are compressed.
FAN_IN, GATHERED = 64, 1 << 20
#: Merged blocks that the driver receives at a time.
AT_ONCE = 8
_SCHEMA = "slot long, level int, block int, payload binary"

Names = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def cells_of(names: np.ndarray, bits: int, row: int) -> np.ndarray:
    """The cell of each name in a row of 2**bits cells."""
    if row:
        names = _text.mix(names ^ np.uint64(0xD6E8FEB86659FD93 * row & (2**64 - 1)))
    return (names >> np.uint64(64 - bits)).astype(np.int64)


def _pack(cells: np.ndarray, again: np.ndarray) -> bytes:
    """Sorted distinct cells as gaps of one byte (255: so far and no cell yet), then one bit per cell."""
    gaps = np.diff(cells, prepend=0)
    skips, rest = np.divmod(gaps, 255)
    out = np.full(int(skips.sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(skips + 1) - 1] = rest
    return len(out).to_bytes(8, "little") + out.tobytes() + np.packbits(again).tobytes()


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(payload[:8], "little")
    gaps = np.frombuffer(payload, np.uint8, size, 8)
    cells = np.cumsum(gaps, dtype=np.int64)[gaps != 255]
    return cells, np.unpackbits(np.frombuffer(payload, np.uint8, offset=8 + size), count=len(cells)).astype(bool)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    slot, level, block, payload = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(level, pa.int32()), pa.array(block, pa.int32()), pa.array(payload, pa.binary())], names=["slot", "level", "block", "payload"])


def _tree(partials: DataFrame, merge: Callable[[list[bytes]], bytes], finish: Callable[[bytes], bytes], blocks: int) -> Iterator[tuple[int, int, bytes]]:
    """Row, block and merged payload, few at a time."""

    def merger(last: bool) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            merged = merge(t.column("payload").to_pylist())
            slot, row, block = (t.column(c)[0].as_py() for c in ("slot", "level", "block"))
            return pa.Table.from_batches([_rows([(slot // FAN_IN, row, block, finish(merged) if last else merged)])])

        return run

    slots = partials.rdd.getNumPartitions()
    while True:
        last = slots <= FAN_IN
        partials = partials.groupBy("level", "block", F.floor(F.col("slot") / FAN_IN).alias("up")).applyInArrow(merger(last), _SCHEMA)
        if last:
            break
        slots = -(-slots // FAN_IN)
    merged = cut(partials.select("level", "block", "payload"), "sketch")
    for low in range(0, blocks, AT_ONCE):
        for r in merged.where(F.col("block").between(low, low + AT_ONCE - 1)).collect():
            yield r["level"], r["block"], r["payload"]


def repeated(df: DataFrame, names: Names, bits: int, depth: int = 2, blocks: int = 64) -> list[np.ndarray]:
    """For each of depth rows, one bit per cell: whether two or more names of the input fell into it.

    names yields arrays of 64-bit names from a batch; a name counts as often as it is yielded. A name that occurs twice
    has its bit set in every row; one that occurs once may, through others in its cells.
    """
    blocks = min(blocks, 1 << bits)
    each = (1 << bits) // blocks

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        kept: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            gathered = np.concatenate(kept)
            for row in range(depth):
                cells = np.sort(cells_of(gathered, bits, row))
                first = np.flatnonzero(np.diff(cells, prepend=-1))
                again = np.diff(first, append=len(cells)) > 1
                cells = cells[first]
                edges = np.searchsorted(cells, np.arange(blocks + 1) * each)
                yield _rows([(slot, row, b, _pack(cells[low:high] - b * each, again[low:high])) for b, (low, high) in enumerate(zip(edges, edges[1:], strict=False)) if high > low])

        for batch in batches:
            for found in names(batch):
                kept.append(found)
                size += len(found)
                if size >= GATHERED:
                    yield from flush()
                    kept.clear()
                    size = 0
        if size:
            yield from flush()

    def merge(payloads: list[bytes]) -> bytes:
        seen = np.zeros(each, np.uint8)
        for p in payloads:
            cells, again = _unpack(p)
            seen[cells] = np.minimum(seen[cells] + 1 + again, 2)
        cells = np.flatnonzero(seen)
        return _pack(cells, seen[cells] > 1)

    def finish(payload: bytes) -> bytes:
        cells, again = _unpack(payload)
        seen = np.zeros(each, bool)
        seen[cells[again]] = True
        return np.packbits(seen).tobytes()

    out = [np.zeros((1 << bits) // 8 or 1, np.uint8) for _ in range(depth)]
    for row, block, bitmap in _tree(df.mapInArrow(partial, _SCHEMA), merge, finish, blocks):
        part = np.frombuffer(bitmap, np.uint8)
        if each >= 8:
            out[row][block * each // 8 : (block + 1) * each // 8] = part
    forget(df.sparkSession)
    return out


def maybe(bitmaps: list[np.ndarray], names: np.ndarray, bits: int) -> np.ndarray:
    """Whether each name may occur twice."""
    keep = np.ones(len(names), bool)
    for row, bitmap in enumerate(bitmaps):
        cells = cells_of(names, bits, row)
        keep &= ((bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).astype(bool)
    return keep


def _narrow(total: np.ndarray) -> bytes:
    """Saturated counts in the fewest bytes each; the first byte says how many."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if k is np.uint32 or int(total.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + np.minimum(total, 2**32 - 1).astype(kind).tobytes()


def _wide(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1)


def counts(df: DataFrame, names: Names, bits: int, blocks: int = 16) -> np.ndarray:
    """One row of 2**bits cells: how many names of the input fell into each, saturating at 2**32 - 1."""
    each = (1 << bits) // blocks

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for found in names(batch):
                total += np.bincount(cells_of(found, bits, 0), minlength=1 << bits)
        if total.any():
            slot = TaskContext.get().partitionId()
            total = total.reshape(blocks, each)
            yield _rows([(slot, 0, b, _narrow(total[b])) for b in range(blocks)])

    def merge(payloads: list[bytes]) -> bytes:
        total = np.zeros(each, np.int64)
        for p in payloads:
            total += _wide(p)
        return _narrow(total)

    out = np.zeros((blocks, each), np.uint32)
    for _, block, part in _tree(df.mapInArrow(partial, _SCHEMA), merge, lambda payload: payload, blocks):
        out[block] = _wide(part)
    forget(df.sparkSession)
    return out.reshape(-1)
