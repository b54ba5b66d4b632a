"""Wide manifests: vertical bitmaps of row blocks.

With many items nearly every row has a pattern of its own, and one number no longer holds it. Rows become blocks instead: for each
block and item a bitset of the rows that hit it. The index is written once, a bit per row and item; from then on a set of items is counted
by AND and popcount, block by block, and only counts leave a task.

Frequent sets take two passes over the index. Each block is searched depth first: a set is extended by later items while it stays
frequent in the block, as no superset can be more frequent. A set that is frequent in all rows is frequent in at least one block, so what the
blocks find holds every frequent set; the second pass counts those exactly. Sets to be counted are sent to the tasks: they are bounded by the
manifest and the support asked for, never by rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimine.operators.items import Item
from evimine.sources.scratch import ship, stored

#: Rows of a block at most: a bitset of 8 kB.
BLOCK = 1 << 16


def _packed(flags: np.ndarray) -> bytes:
    """Rows of flags as bitsets, each of whole 64-bit words."""
    wide = np.zeros((len(flags), -(-flags.shape[1] // 64) * 64), bool)
    wide[:, : flags.shape[1]] = flags
    return np.packbits(wide, axis=1).tobytes()


def index(rows: DataFrame, items: Sequence[Item], label: str, by: str = "split", block: int = BLOCK) -> DataFrame:
    """A written table of blocks: by, n (rows), ones (bitset of rows with the label) and hits (bitsets of the items, in order).

    by is a column of few values; null is one of them. A null label counts as 0. An empty table has no blocks.
    """
    ship(rows.sparkSession)
    flags = [f"_{i}" for i in range(len(items))]
    wide = rows.select(F.col(by), F.coalesce(F.col(label) == 1, F.lit(False)).alias("_y"), *(item.column().alias(f) for item, f in zip(items, flags, strict=True)))

    def blocks(key: object, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(columns[0])
        parts = max(1, ceil(n / block))  # of like size: a small rest would call everything frequent
        for i in range(parts):
            at = slice(n * i // parts, n * (i + 1) // parts)
            cut = [c[at] for c in columns]
            values = [pa.array([key], kind), pa.array([len(cut[0])], pa.int64()), pa.array([_packed(np.stack(cut[:1]))]), pa.array([_packed(np.stack(cut[1:])) if items else b""])]
            yield pa.RecordBatch.from_arrays(values, names=[by, "n", "ones", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[list[np.ndarray]]] = {}
        for batch in batches:
            keys = batch.column(by).dictionary_encode()
            codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            matrix = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", *flags)]
            for code in np.unique(codes):
                key = keys.dictionary[int(code)].as_py() if code >= 0 else None
                own = held.setdefault(key, [])
                own.append([c[codes == code] for c in matrix])
                if sum(len(c[0]) for c in own) >= 4 * block:
                    yield from blocks(key, [np.concatenate(c) for c in zip(*held.pop(key), strict=True)])
        for key, own in held.items():
            yield from blocks(key, [np.concatenate(c) for c in zip(*own, strict=True)])

    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[rows.schema[by].dataType.simpleString()]
    schema = T.StructType([rows.schema[by], *(T.StructField(n, t) for n, t in (("n", T.LongType()), ("ones", T.BinaryType()), ("hits", T.BinaryType())))])
    return stored(wide.mapInArrow(run, schema))


def _read(ones: bytes, hits: bytes) -> tuple[np.ndarray, np.ndarray]:
    label = np.frombuffer(ones, np.uint64)
    return label, np.frombuffer(hits, np.uint64).reshape(-1, len(label)) if len(label) else np.zeros((0, 0), np.uint64)


def _size(bitset: np.ndarray) -> int:
    return int(np.bitwise_count(bitset).sum(dtype=np.int64))


def _frequent(label: np.ndarray, hits: np.ndarray, least: int, most: int) -> Iterator[tuple[int, ...]]:
    """Sets of up to most items that at least so many rows with the label hit, depth first."""
    stack = [((), label, 0)]
    while stack:
        chosen, alive, start = stack.pop()
        for i in range(start, len(hits)):
            both = alive & hits[i]
            if _size(both) >= least:
                found = (*chosen, i)
                yield found
                if len(found) < most:
                    stack.append((found, both, i + 1))


def _counted(label: np.ndarray, hits: np.ndarray, sets: Sequence[tuple[int, ...]]) -> np.ndarray:
    """Rows, and rows with the label, that hit each of the sets; sets in order share what they begin with."""
    out, path, alive = np.zeros((len(sets), 2), np.int64), [], []
    for k, chosen in enumerate(sets):
        same = 0
        while same < min(len(path), len(chosen)) and path[same] == chosen[same]:
            same += 1
        del path[same:], alive[same:]
        for i in chosen[same:]:
            path.append(i)
            alive.append(alive[-1] & hits[i] if alive else hits[i])
        out[k] = _size(alive[-1]), _size(alive[-1] & label)
    return out


def frequent_sets(blocks: DataFrame, sizes: tuple[int, int], support: float) -> list[tuple[int, ...]]:
    """Sets of items (by place in the manifest) of these sizes that may have this support together with the label, and all that have."""
    low, high = sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, ...]] = set()
        for batch in batches:
            for n, ones, hits in zip(*(batch.column(c).to_pylist() for c in ("n", "ones", "hits")), strict=True):
                least = max(1, ceil(support * n - 1e-9))
                seen.update(s for s in _frequent(*_read(ones, hits), least, high) if len(s) >= low)
        yield pa.RecordBatch.from_arrays([pa.array([list(s) for s in seen], pa.list_(pa.int32()))], names=["chosen"])

    found = blocks.select("n", "ones", "hits").mapInArrow(run, "chosen array<int>").distinct()
    return sorted(tuple(r["chosen"]) for r in found.toLocalIterator())


def counts(blocks: DataFrame, sets: Sequence[tuple[int, ...]], by: str = "split") -> DataFrame:
    """by, k (place in sets), total and positives (of all rows of by), hit and hit_y; sets none of whose rows occur in by have zeros."""
    spark = blocks.sparkSession
    order = sorted(range(len(sets)), key=lambda k: sets[k])
    sent = spark.sparkContext.broadcast(([sets[k] for k in order], np.array(order, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, places = sent.value
        sums: dict[object, list] = {}
        for batch in batches:
            for key, n, ones, hits in zip(*(batch.column(c).to_pylist() for c in (by, "n", "ones", "hits")), strict=True):
                label, bits = _read(ones, hits)
                found = [_counted(label, bits, wanted), n, _size(label)]
                sums[key] = [a + b for a, b in zip(sums[key], found, strict=True)] if key in sums else found
        for key, (found, total, positives) in sums.items():
            m = len(wanted)
            columns = [pa.array([key] * m, batch.schema.field(by).type), *map(pa.array, (places, np.full(m, total, np.int64), np.full(m, positives, np.int64), found[:, 0].copy(), found[:, 1].copy()))]
            yield pa.RecordBatch.from_arrays(columns, names=[by, "k", "total", "positives", "hit", "hit_y"])

    schema = T.StructType([blocks.schema[by], *(T.StructField(n, T.LongType()) for n in ("k", "total", "positives", "hit", "hit_y"))])
    each = blocks.select(by, "n", "ones", "hits").mapInArrow(run, schema)
    return each.groupBy(by, "k").agg(*(F.sum(c).alias(c) for c in ("total", "positives", "hit", "hit_y")))


def all_sets(n_items: int, size: int) -> list[tuple[int, ...]]:
    return list(combinations(range(n_items), size))


def rule_table(spark: SparkSession, items: Sequence[Item], sets: Sequence[tuple[int, ...]]) -> DataFrame:
    """k, places (of the items in the manifest), items (sorted names), antecedent, families (sorted, distinct), n_items, clarity and continuous of each set: one row per set."""
    chosen = [sorted((items[i] for i in s), key=lambda i: i.name) for s in sets]
    columns = {
        "k": pa.array(np.arange(len(sets))),
        "places": pa.array([list(s) for s in sets], pa.list_(pa.int32())),
        "items": pa.array([[i.name for i in c] for c in chosen], pa.list_(pa.string())),
        "antecedent": pa.array(["||".join(i.name for i in c) for c in chosen], pa.string()),
        "families": pa.array([sorted({i.family for i in c}) for c in chosen], pa.list_(pa.string())),
        "n_items": pa.array([len(c) for c in chosen], pa.int32()),
        "clarity": pa.array([sum(i.clarity for i in c) / len(c) for c in chosen], pa.float64()),
        "continuous": pa.array([max(int(i.continuous) for i in c) for c in chosen], pa.int32()),
    }
    return spark.createDataFrame(pa.table(columns), "k long, places array<int>, items array<string>, antecedent string, families array<string>, n_items int, clarity double, continuous int")


def evaluate(blocks: DataFrame, items: Sequence[Item], sets: Sequence[tuple[int, ...]], by: str = "split") -> DataFrame:
    """The sets as rules, with by, total, positives, hit and hit_y: what items.evaluate gives, for manifests of any width."""
    return counts(blocks, sets, by).join(rule_table(blocks.sparkSession, items, sets), "k")
