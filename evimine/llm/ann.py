"""Approximate nearest neighbours by a permutation index.

Method: a bounded, seeded sample of vectors serves as pivots. Every vector is represented by its nearest pivots in order and
posted in the inverted files of the first POSTS of them, so the index is partitioned by pivot. A query is sent only to the
files of its own PREFIX nearest pivots. A file ranks what it holds by Spearman's footrule over the two prefixes (absent
pivots at the place past the end), and the vectors at a small enough distance are reranked by exact cosine. A vector that a
query meets in several files is looked at in the first one only.

Files are cut into blocks of bounded size by the counted number of their vectors, and the queries of a file too, so a dense family of
vectors under one pivot is many tasks. Each block gives its best few per query, which then meet in one aggregation. There
is no cap on reranked candidates: all within the footrule radius are, and at least the FEW nearest of each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimine.llm._spark import cut, ship

#: Pivots, how many of them represent a vector, and how many of those it is posted under.
PIVOTS, PREFIX, POSTS = 512, 48, 8
#: Share of the greatest agreement of two prefixes from which a vector is reranked; at least so many of each block.
AGREEMENT, FEW = 0.08, 16
BLOCK, QUERY_BLOCK = 4096, 1024


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and v (array of float, if it was that, or double) of the rows that take part."""
    single = vectors.schema[embedding].dataType == T.ArrayType(T.FloatType())
    v = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    ok = F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(ok & finite & F.exists(v, lambda x: x != 0)).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    once = rows.groupBy("id").agg(F.min("v").alias("v"))
    if single:
        return once
    # a power of two off the length changes no cosine, and squares of what is left neither overflow nor vanish
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", F.abs)))))
    return once.withColumn("scale", scale).select("id", F.transform("v", lambda x: x / F.col("scale")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(1))


def prefixes(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots (of unit length) of each vector in order, ties by number."""
    near = vectors / _norms(vectors)[:, None] @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int16)


class Block:
    """Vectors of one pivot's file."""

    def __init__(self, file: int, ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, pivots: int):
        self.file, self.ids, self.vectors, self.near, self.pivots = file, ids, vectors, near, pivots
        self.norms = _norms(vectors)
        self.prefix = near.shape[1]
        self.early = self.prefix - np.arange(self.prefix)

    def agreement(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors that this query meets here first, and how far their prefixes agree with its own; the footrule distance is prefix * (prefix + 1) - 2 * agreement."""
        early = np.zeros(self.pivots, np.int64)
        early[near] = self.early
        own = np.flatnonzero(early[self.near[:, :POSTS]].max(1) == early[self.file])
        return own, np.minimum(early[self.near[own]], self.early).sum(1)

    def search(self, query_id: int, query: np.ndarray, near: np.ndarray, k: int, share: float, few: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best k candidates but the query itself."""
        own, total = self.agreement(near)
        own, total = own[self.ids[own] != query_id], total[self.ids[own] != query_id]
        least = share * self.prefix * (self.prefix + 1) / 2
        if len(total) > few:
            least = min(least, np.partition(total, len(total) - few)[len(total) - few])
        some = own[total >= least]
        norm = np.sqrt((query * query).sum())
        score = (self.vectors[some] * query).sum(1) / (self.norms[some] * norm)
        best = np.lexsort((self.ids[some], -score))[:k]
        return self.ids[some][best], score[best]


def _pivots(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """The first distinct vectors in a seeded order, of unit length; only rows below a threshold of that order reach the driver."""
    order = F.xxhash64(F.lit(seed), "id")
    share = min(1.0, 4 * PIVOTS / n)
    some = rows.where(F.pmod(order, F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).orderBy(order, "id").limit(8 * PIVOTS).collect()
    vectors = np.array([r["v"] for r in some], np.float64)
    _, first = np.unique(vectors, axis=0, return_index=True)
    vectors = vectors[np.sort(first)[:PIVOTS]]
    return vectors / _norms(vectors)[:, None]


def search(vectors: DataFrame, queries, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 11, share: float = AGREEMENT) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by cosine of each row for which queries(id) holds.

    queries: a function from the id column to a condition. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without id, take no part; nor do vectors of another length than most have (the shorter, if
    two lengths are as frequent). Of rows with one id the least vector counts. A query has all others as candidates; ties go to
    the smaller id. Fewer than k candidates give fewer rows, an empty table none. Other columns are ignored.
    """
    ship(vectors.sparkSession)
    rows = cut(valid(vectors, vec_id, embedding), "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum(queries(F.col("id")).cast("long")).alias("q"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if most is None or not most["q"]:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == most["dim"])
    pivots = _pivots(rows, most["n"], seed)

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = prefixes(_matrix(batch.column("v")), pivots, PREFIX)
                lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists], names=["id", "v", "near"])

    kind = rows.schema["v"].dataType.simpleString()
    rows = cut(rows.mapInArrow(represent, f"id long, v {kind}, near array<smallint>"), "prefixes")
    index = rows.select("*", F.explode(F.slice("near", 1, POSTS)).alias("file"))
    asked = rows.where(queries(F.col("id"))).select("*", F.explode("near").alias("file"))

    def pieces(of: DataFrame, size: int) -> tuple:
        """The number of blocks of each file, by its counted rows, as an expression of file."""
        counts = dict(of.groupBy("file").count().collect())
        return F.get(F.array(*(F.lit(max(1, -(-counts.get(f, 0) // size))) for f in range(len(pivots)))), F.col("file").cast("int"))

    blocks, query_blocks = pieces(index, BLOCK), pieces(asked, QUERY_BLOCK)
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    index = index.select("*", place(blocks, 1).alias("b"), every(query_blocks).alias("q"))
    asked = asked.select("*", every(blocks).alias("b"), place(query_blocks, 2).alias("q"))

    def run(held: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if held.num_rows and wanted.num_rows:
            block = Block(held.column("file")[0].as_py(), held.column("id").to_numpy(), _matrix(held.column("v")), _matrix(held.column("near"), np.int16), len(pivots))
            points, near = _matrix(wanted.column("v")), _matrix(wanted.column("near"), np.int16)
            for i, q in enumerate(wanted.column("id").to_pylist()):
                found, score = block.search(q, points[i], near[i], k, share, FEW)
                out.append((np.full(len(found), q), found, score))
        columns = [np.concatenate(c) if out else np.zeros(0) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    key = ("file", "b", "q")
    best = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
