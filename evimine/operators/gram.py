"""Correlations of thousands of columns from one scan: a blocked Gram matrix.

A task keeps the centred cross products of all columns over the rows that it reads, by matrix products, and sends them block by block with the
means they are centred on. Blocks of the same pair of column ranges meet in one task, which merges them one after the other, so that
neither sums of large numbers cancel nor a task holds more than its own blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimine.sources.scratch import ship

#: Columns of a block (32 kB of cross products), and rows that are multiplied at once.
BLOCK, ROWS = 64, 1024


class _Moments:
    """Rows, means and centred cross products of a number of columns, or of two ranges of them."""

    def __init__(self, rows: int, a: np.ndarray, b: np.ndarray, cross: np.ndarray, ss_a: np.ndarray, ss_b: np.ndarray):
        self.n, self.a, self.b, self.cross, self.ss_a, self.ss_b = rows, a, b, cross, ss_a, ss_b

    def add(self, n: int, a: np.ndarray, b: np.ndarray, cross: np.ndarray, ss_a: np.ndarray, ss_b: np.ndarray) -> None:
        share, da, db = self.n * n / (self.n + n), a - self.a, b - self.b
        self.cross += cross + share * np.outer(da, db)
        self.ss_a += ss_a + share * da * da
        self.ss_b += ss_b + share * db * db
        self.a += da * (n / (self.n + n))
        self.b += db * (n / (self.n + n))
        self.n += n


def correlations(df: DataFrame, columns: Sequence[str] | Column, width: int | None = None, block: int = BLOCK) -> DataFrame:
    """a, b (places, a < b) and corr of all pairs of columns: a list of names, or one array column of so many (width) numbers.

    Nulls, NaN and infinities count as 0. corr is null where a column does not vary. No rows give no pairs.
    """
    ship(df.sparkSession)
    if isinstance(columns, Column):
        values, k = columns, int(width or 0)
    else:
        values, k = F.array(*(F.col(c).cast("double") for c in columns)), len(columns)
    ranges = [(low, min(k, low + block)) for low in range(0, k, block)]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            flat = np.nan_to_num(batch.column("x").flatten().fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64), posinf=0.0, neginf=0.0)
            rows = flat.reshape(-1, k)
            for low in range(0, len(rows), ROWS):
                x = rows[low : low + ROWS]
                mean = x.mean(0)
                x = x - mean
                product = x.T @ x
                if total is None:
                    total = [len(x), mean, product]
                    continue
                share, d = total[0] * len(x) / (total[0] + len(x)), mean - total[1]
                total[2] += product + share * np.outer(d, d)
                total[1] = total[1] + d * (len(x) / (total[0] + len(x)))
                total[0] += len(x)
        if total is not None:
            n, mean, product = total
            ss = np.diag(product)
            for i, (a, b) in enumerate(ranges):
                for j, (c, d) in enumerate(ranges[i:], i):
                    packed = np.concatenate([mean[a:b], mean[c:d], ss[a:b], ss[c:d], product[a:b, c:d].ravel()]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([n], pa.int64()), pa.array([packed])], names=["i", "j", "n", "parts"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], _Moments] = {}
        for batch in batches:
            for i, j, n, parts in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "n", "parts")), strict=True):
                p, q = ranges[i][1] - ranges[i][0], ranges[j][1] - ranges[j][0]
                a, b, ss_a, ss_b, product = np.split(np.frombuffer(parts, np.float64).copy(), np.cumsum([p, q, p, q]))
                if (i, j) in held:
                    held[i, j].add(n, a, b, product.reshape(p, q), ss_a, ss_b)
                else:
                    held[i, j] = _Moments(n, a, b, product.reshape(p, q), ss_a, ss_b)
        for (i, j), m in held.items():
            scale = np.sqrt(np.outer(m.ss_a, m.ss_b))
            corr = np.clip(np.divide(m.cross, scale, out=np.full(m.cross.shape, np.nan), where=scale > 0), -1, 1)
            at_a, at_b = np.meshgrid(np.arange(*ranges[i]), np.arange(*ranges[j]), indexing="ij")
            keep = at_a < at_b
            found = corr[keep]
            yield pa.RecordBatch.from_arrays([pa.array(at_a[keep].astype(np.int32)), pa.array(at_b[keep].astype(np.int32)), pa.array(found, mask=np.isnan(found))], names=["a", "b", "corr"])

    blocks = df.select(values.cast("array<double>").alias("x")).mapInArrow(cross, "i int, j int, n long, parts binary")
    return blocks.repartition("i", "j").mapInArrow(merged, "a int, b int, corr double")
