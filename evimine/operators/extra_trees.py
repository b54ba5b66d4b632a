"""Extremely randomised trees, grown level by level for all trees at once.

A node tries a few features, each at one cut drawn evenly between the ends that the cuts above it leave (at first the feature's range), and
takes the one that lowers Gini impurity most. All rows serve every tree. A level is one job: each task walks its rows down the trees grown so far and
counts classes on both sides of every cut that is tried; what reaches the driver are those counts, bounded by trees, nodes and features, never by
rows. Draws come from a digest of seed, tree, node and try, so that a level that is computed again grows the same trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimine.sources.scratch import ship, stored


def draw(seed: int, tree: int, node: int, attempt: int) -> tuple[float, float]:
    """Two numbers in [0, 1)."""
    d = hashlib.md5(f"{seed}:{tree}:{node}:{attempt}".encode()).digest()
    return int.from_bytes(d[:6], "big") / 2**48, int.from_bytes(d[6:12], "big") / 2**48


def gini_gain(left: Sequence[float], right: Sequence[float]) -> float:
    """How much a split of (negatives, positives) lowers the impurity, times rows."""
    impurity = lambda n, p: 2 * n * p / (n + p) if n + p else 0.0
    return impurity(left[0] + right[0], left[1] + right[1]) - impurity(*left) - impurity(*right)


@dataclass
class Forest:
    """Nodes of each tree by heap number (root 1): (feature, cut), or the share of positives of a leaf."""

    features: list[str]
    splits: list[dict[int, tuple[int, float]]]
    leaves: list[dict[int, float]] = field(default_factory=list)
    gains: list[dict[int, tuple[int, float]]] = field(default_factory=list)

    def importances(self) -> dict[str, float]:
        """The mean over trees of each feature's share of all gain; trees that never split count as 0."""
        total = np.zeros(len(self.features))
        for tree in self.gains:
            own = np.zeros(len(self.features))
            for f, gain in tree.values():
                own[f] += gain
            total += own / own.sum() if own.sum() else 0
        return dict(zip(self.features, (total / max(1, len(self.gains))).tolist(), strict=True))


def _nodes(x: np.ndarray, splits: dict[int, tuple[int, float]]) -> np.ndarray:
    """The node that each row is in after all splits of a tree."""
    at, deepest = np.ones(len(x), np.int64), max(splits, default=0).bit_length()
    for _ in range(deepest):
        feature, cut = np.full(1 << deepest, -1), np.zeros(1 << deepest)
        for node, (f, c) in splits.items():
            feature[node], cut[node] = f, c
        inner = at < len(feature)
        f = np.where(inner, feature[np.minimum(at, len(feature) - 1)], -1)
        moves = f >= 0
        right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[np.minimum(at, len(feature) - 1)]
        at = np.where(moves, 2 * at + right, at)
    return at


def grow(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 8, tries: int | None = None, least: int = 2, seed: int = 42) -> Forest:
    """A forest on df; label is 0 or 1, rows without it take no part, null features count as 0.

    tries: features of a node, by default the root of their number. least: rows on each side of a split. An empty table, or one class, gives trees
    of one leaf.
    """
    ship(df.sparkSession)
    k, tries = len(features), tries or max(1, round(len(features) ** 0.5))
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)).alias("x"))
    table = stored(rows)
    ends = table.agg(F.array(*(F.min(F.col("x")[i]) for i in range(k))).alias("low"), F.array(*(F.max(F.col("x")[i]) for i in range(k))).alias("high"), F.count_if(F.col("y") == 0).alias("n"), F.count_if(F.col("y") == 1).alias("p")).first()
    forest = Forest(list(features), [{} for _ in range(trees)], [{} for _ in range(trees)], [{} for _ in range(trees)])
    share = lambda n, p: p / (n + p) if n + p else 0.0
    open_ = [{1: (ends["n"], ends["p"], list(zip(ends["low"], ends["high"], strict=True)))} for _ in range(trees)] if ends["n"] + ends["p"] else [{} for _ in range(trees)]
    for level in range(depth + 1):
        asked: list[tuple[int, int, int, float]] = []  # tree, node, feature, cut
        for tree, nodes in enumerate(open_):
            for node, (n, p, bounds) in nodes.items():
                if level == depth or not n or not p or n + p < 2 * least:
                    forest.leaves[tree][node] = share(n, p)
                    continue
                left = list(range(k))
                for attempt in range(tries):
                    a, b = draw(seed, tree, node, attempt)
                    f = left.pop(int(a * len(left)))
                    asked.append((tree, node, f, bounds[f][0] + b * (bounds[f][1] - bounds[f][0])))
        if not asked:
            break
        counted = _counts(table, forest.splits, asked)
        best: dict[tuple[int, int], tuple[float, int, float, np.ndarray]] = {}
        for (tree, node, f, cut), c in zip(asked, counted, strict=True):
            gain = gini_gain(c[0], c[1]) if min(c[0].sum(), c[1].sum()) >= least else 0.0
            if gain > best.get((tree, node), (1e-9,))[0]:
                best[tree, node] = gain, f, cut, c
        following: list[dict] = [{} for _ in range(trees)]
        for tree, nodes in enumerate(open_):
            for node, (n, p, bounds) in nodes.items():
                if (tree, node) in best:
                    gain, f, cut, c = best[tree, node]
                    forest.splits[tree][node], forest.gains[tree][node] = (f, cut), (f, gain)
                    for side in (0, 1):
                        inside = list(bounds)
                        inside[f] = (bounds[f][0], cut) if side == 0 else (cut, bounds[f][1])
                        following[tree][2 * node + side] = (int(c[side][0]), int(c[side][1]), inside)
                else:
                    forest.leaves[tree].setdefault(node, share(n, p))
        open_ = following
    return forest


def _counts(table: DataFrame, splits: list[dict], asked: list[tuple[int, int, int, float]]) -> np.ndarray:
    """[asked, side, class]: rows of the node on each side of the cut. One job."""
    sent = table.sparkSession.sparkContext.broadcast((splits, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, wanted = sent.value
        of_tree: dict[int, list[int]] = {}
        for i, (tree, *_) in enumerate(wanted):
            of_tree.setdefault(tree, []).append(i)
        total = np.zeros((len(wanted), 4), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(y), -1)
            for tree, places in of_tree.items():
                at = _nodes(x, grown[tree])
                order = np.argsort(at, kind="stable")
                ordered = at[order]
                for i in places:
                    _, node, f, cut = wanted[i]
                    own = order[np.searchsorted(ordered, node) : np.searchsorted(ordered, node, "right")]
                    total[i] += np.bincount(2 * (x[own, f] > cut) + y[own], minlength=4)
        yield pa.RecordBatch.from_arrays([pa.array(total.sum(1).nonzero()[0]), pa.array(total[total.sum(1) > 0].tolist(), pa.list_(pa.int64()))], names=["i", "c"])

    found = table.mapInArrow(run, "i long, c array<long>").groupBy("i").agg(*(F.sum(F.col("c")[j]).alias(f"c{j}") for j in range(4)))
    out = np.zeros((len(asked), 2, 2), np.int64)
    for r in found.collect():
        out[r["i"]] = [[r["c0"], r["c1"]], [r["c2"], r["c3"]]]
    return out


def score(df: DataFrame, forest: Forest, keep: Sequence[str]) -> DataFrame:
    """keep and score, the mean share of positives of the leaves that a row falls into."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((forest.splits, forest.leaves))
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in forest.features))
    rows = df.select(F.struct(*keep).alias("row"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, leaves = sent.value
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            total = np.zeros(batch.num_rows)
            for s, own in zip(splits, leaves, strict=True):
                at = _nodes(x, s)
                table = np.zeros(max([1, *own]) + 1)
                for node, value in own.items():
                    table[node] = value
                total += table[at]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(total / max(1, len(splits)))], names=["row", "score"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double"
    return rows.mapInArrow(run, schema).select("row.*", "score")
