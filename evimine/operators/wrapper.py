"""Subset search with a linear model: every subset of a generation is fitted and scored together.

Rows are written once, in blocks of one fold: labels and features packed column by column, so that a pass reads bytes and not values. A Newton
step of all subsets and folds is one job: a task adds up gradients and Hessians of each over the blocks that it reads, for all subsets in the same
few products of matrices, and what reaches the driver is their sum, bounded by the subsets and features, never by rows. Folds are stratified and keep groups whole; medians, means and spreads come from the rows that a fold trains on.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evimine.operators import folds as stratified
from evimine.operators import quantiles
from evimine.sources.scratch import FINE, ship, stored

#: Newton steps at most, and the step below which all have settled.
STEPS, SETTLED = 12, 1e-7
BETA = 1.5
#: Rows of a block, and pairs of features up to which the Hessians of all subsets are taken from the products of those pairs.
BLOCK, PAIRS = 1 << 13, 2048
#: Rows whose products are held at a time.
PIECE = 512


@dataclass
class Scale:
    """Per fold, what the rows outside of it say: medians, means, spreads and class weights."""

    folds: int
    medians: np.ndarray
    means: np.ndarray
    spreads: np.ndarray
    weights: np.ndarray

    def scaled(self, x: np.ndarray, fold: int) -> np.ndarray:
        return (np.where(np.isnan(x), self.medians[fold], x) - self.means[fold]) / self.spreads[fold]


@dataclass
class Matrix:
    """A table (fold, y, x), the same written as blocks (fold, n, payload), and its scale."""

    rows: DataFrame
    blocks: DataFrame
    scale: Scale


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of doubles, each as its number of distinct values (0: more than 256), these, and a byte per row; or as it is."""
    out = []
    for values in columns:
        few = np.unique(values[:2048])
        if len(few) <= 256:
            few, codes = np.unique(values, return_inverse=True)
        if len(few) <= 256:
            out += [len(few).to_bytes(8, "little"), few.tobytes(), codes.astype(np.uint8).tobytes()]
        else:
            out += [bytes(8), values.tobytes()]
    return b"".join(out)


def _unpack(payload: bytes, n: int, k: int) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(k):
        few, at = int.from_bytes(payload[at : at + 8], "little"), at + 8
        values = np.frombuffer(payload[at : at + 8 * (few or n)], np.float64)
        at += values.nbytes
        if few:
            values = values[np.frombuffer(payload, np.uint8, n, at)]
            at += n
        out.append(values)
    return out


def _blocks(wide: DataFrame, k: int) -> DataFrame:
    """A written table of blocks of one fold: y and x0 to x(k-1) of n rows; nulls are NaN."""
    names = ["y", *(f"x{i}" for i in range(k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def block(fold: int) -> pa.RecordBatch:
            rows = np.concatenate(held.pop(fold), axis=1)
            return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([rows.shape[1]], pa.int32()), pa.array([_pack(list(rows))])], names=["fold", "n", "payload"])

        for batch in batches:
            folds, rows = batch.column("fold").to_numpy(), np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names])
            for fold in np.unique(folds).tolist():
                held.setdefault(fold, []).append(rows[:, folds == fold])
                if sum(r.shape[1] for r in held[fold]) >= BLOCK:
                    yield block(fold)
        for fold in list(held):
            yield block(fold)

    ship(wide.sparkSession)
    return stored(wide.select("fold", *names).mapInArrow(run, "fold int, n int, payload binary"), FINE)


def matrix(df: DataFrame, features: Sequence[str], label: str, group: str, folds: int = 3, seed: int = 42) -> Matrix:
    """Nulls are imputed by the median of the rows outside a fold; a feature that does not vary there is constant 0. Rows without group or label take no part."""
    some = df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
    placed = some.join(stratified.assign(some, group, label, folds, seed), group)
    wide = stored(placed.select(F.col("fold").cast("int").alias("fold"), F.col(label).cast("double").alias("y"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features))))
    k = len(features)
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda t: t != F.col("fold"))).alias("without")
    long = wide.select(each, *(F.col(f"x{i}") for i in range(k))).unpivot(["without"], [f"x{i}" for i in range(k)], "feature", "value")
    medians = np.zeros((folds, k))
    for r in quantiles.quantiles(long, ["without", "feature"], [0.5]).collect():
        medians[r["without"], int(r["feature"][1:])] = r["quantile"]
    filled = lambda i: F.coalesce(F.nanvl(f"x{i}", F.lit(None).cast("double")), F.get(F.array(*(F.lit(float(m)) for m in medians[:, i])), F.col("without")))
    trained = wide.select(each, "y", *(F.col(f"x{i}") for i in range(k)))
    stats = trained.groupBy("without").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), *(f(filled(i)).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop))))
    means, spreads, weights = np.zeros((folds, k)), np.ones((folds, k)), np.ones((folds, 2))
    for r in stats.collect():
        t = r["without"]
        means[t], spreads[t] = [r[f"m{i}"] or 0.0 for i in range(k)], [r[f"s{i}"] or 1.0 for i in range(k)]
        weights[t] = [r["n"] / 2 / max(1.0, r["n"] - r["p"]), r["n"] / 2 / max(1.0, r["p"])]
    rows = wide.select("fold", "y", F.array(*(F.col(f"x{i}") for i in range(k))).alias("x"))
    return Matrix(rows, _blocks(wide, k), Scale(folds, medians, means, spreads, weights))


def _summed(m: Matrix, work) -> dict[int, np.ndarray]:
    """The sum over all rows of the vector that work (of a block: its fold, y and x) gives per key; keys are few."""
    k = m.scale.medians.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, n, payload in zip(*(batch.column(c) for c in ("fold", "n", "payload")), strict=True):
                y, *x = _unpack(payload.as_py(), n.as_py(), k + 1)
                for key, vector in work(fold.as_py(), y, np.column_stack(x)).items():
                    sums[key] = sums[key] + vector if key in sums else vector
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["key", "parts"])

    ship(m.blocks.sparkSession)
    parts = m.blocks.mapInArrow(run, "key int, parts array<double>").select("key", F.posexplode("parts").alias("at", "value"))
    out: dict[int, dict[int, float]] = {}
    for r in parts.groupBy("key", "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["key"], {})[r["at"]] = r["value"]
    return {key: np.array([v[i] for i in range(len(v))]) for key, v in out.items()}


def _places(chosen: tuple[int, ...]) -> list[int]:
    """Columns of a design that a subset uses: the first is the intercept."""
    return [0, *(i + 1 for i in chosen)]


def _design(scale: Scale, x: np.ndarray, fold: int) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), scale.scaled(x, fold)])


def _weights(scale: Scale, subsets: Sequence[tuple[int, ...]], found: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Weights of all subsets side by side, per fold; 0 for what a subset does not use."""
    out = np.zeros((scale.folds, scale.medians.shape[1] + 1, len(subsets)))
    for (s, t), weights in found.items():
        out[t, _places(subsets[s]), s] = weights
    return out


def _hessians(z: np.ndarray, weight: np.ndarray, subsets: Sequence[tuple[int, ...]]) -> Iterator[np.ndarray]:
    """The weighted products of the columns that each subset uses; weight has a column per subset.

    Subsets that share most of their columns share the products of these, summed for all at once; else each goes by itself.
    """
    used = sorted({i for s in subsets for i in _places(s)})
    pairs = len(used) * (len(used) + 1) // 2
    if pairs > PAIRS or pairs * len(subsets) > 8 * sum((len(s) + 1) ** 2 for s in subsets):
        for s, chosen in enumerate(subsets):
            own = z[:, _places(chosen)]
            yield (own * weight[:, s : s + 1]).T @ own
        return
    columns = np.ascontiguousarray(z[:, used].T)
    a, b = np.triu_indices(len(used))
    sums, held = np.zeros((pairs, len(subsets))), np.empty((pairs, PIECE))
    for low in range(0, len(z), PIECE):  # small enough to stay in the processor's cache
        piece, at = columns[:, low : low + PIECE], 0
        for i in range(len(used)):
            np.multiply(piece[i], piece[i:], out=held[at : at + len(used) - i, : piece.shape[1]])
            at += len(used) - i
        sums += held[:, : piece.shape[1]] @ weight[low : low + PIECE]
    full = np.zeros((len(used), len(used), len(subsets)))
    full[a, b] = full[b, a] = sums
    for s, chosen in enumerate(subsets):
        at = np.searchsorted(used, _places(chosen))
        yield full[np.ix_(at, at)][:, :, s]


def fit(m: Matrix, subsets: Sequence[tuple[int, ...]], strength: float = 1.0) -> dict[tuple[int, int], np.ndarray]:
    """Weights (intercept first) of a logistic model with balanced classes for every subset of features and fold, trained on the rows outside that fold.

    strength: of the quadratic penalty on all weights but the intercept, against the weighted sum over rows. One job per Newton step.
    """
    scale = m.scale
    found = {(s, t): np.zeros(len(subsets[s]) + 1) for s in range(len(subsets)) for t in range(scale.folds)}
    for _ in range(STEPS):
        beta = _weights(scale, subsets, found)

        def work(fold: int, y: np.ndarray, x: np.ndarray, beta=beta) -> dict[int, np.ndarray]:
            out = {}
            for t in range(scale.folds):
                if t != fold:
                    z = _design(scale, x, t)
                    weight = np.where(y == 1, scale.weights[t, 1], scale.weights[t, 0])[:, None]
                    p = 1 / (1 + np.exp(-np.clip(z @ beta[t], -500, 500)))
                    gradients = z.T @ (weight * (y[:, None] - p))
                    for s, hessian in enumerate(_hessians(z, weight * p * (1 - p), subsets)):
                        out[s * scale.folds + t] = np.concatenate([gradients[_places(subsets[s]), s], hessian.ravel()])
            return out

        largest = 0.0
        for key, vector in _summed(m, work).items():
            s, t = divmod(key, scale.folds)
            d = len(subsets[s]) + 1
            penalty = np.diag([1e-9, *[strength] * (d - 1)])
            step = np.linalg.solve(vector[d:].reshape(d, d) + penalty, vector[:d] - penalty @ found[s, t])
            found[s, t] = found[s, t] + np.clip(step, -5, 5)
            largest = max(largest, float(np.abs(step).max()))
        if largest < SETTLED:
            break
    return found


def fitness(m: Matrix, subsets: Sequence[tuple[int, ...]], strength: float = 1.0) -> list[float]:
    """The mean F1.5 over folds of every subset, each fold scored by the model that was trained without it. No features: 0."""
    own = [s for s in subsets if s]
    if not own:
        return [0.0] * len(subsets)
    scale = m.scale
    beta = _weights(scale, own, fit(m, own, strength))

    def work(fold: int, y: np.ndarray, x: np.ndarray) -> dict[int, np.ndarray]:
        hit, positive = _design(scale, x, fold) @ beta[fold] >= 0, (y == 1)[:, None]
        counts = np.array([(hit & positive).sum(0), (hit & ~positive).sum(0), (~hit & positive).sum(0)], float)
        return {s * scale.folds + fold: counts[:, s] for s in range(len(own))}

    cells, b = _summed(m, work), BETA * BETA
    score = lambda tp, fp, fn: (1 + b) * tp / ((1 + b) * tp + b * fn + fp) if tp else 0.0
    means = {chosen: float(np.mean([score(*cells[s * scale.folds + t]) if s * scale.folds + t in cells else 0.0 for t in range(scale.folds)])) for s, chosen in enumerate(own)}
    return [means[s] if s else 0.0 for s in subsets]


def search(m: Matrix, n_features: int, wolves: int = 12, iterations: int = 10, repeats: int = 1, penalty: float = 0.010, seed: int = 42) -> tuple[tuple[int, ...], float, list[float]]:
    """The best subset of a binary grey-wolf search, its value, and the share of repeats whose best wolf holds each feature.

    A wolf is a position in [0, 1] per feature, above one half is chosen (if none is, the highest is); wolves are drawn towards the three
    best of all so far. All new subsets of a generation are fitted and scored together; a chosen feature costs penalty / number of features.
    """
    r, known = random.Random(seed), {}
    recurrent = [0.0] * n_features

    def chosen(at: list[float]) -> tuple[int, ...]:
        return tuple(i for i, x in enumerate(at) if x > 0.5) or (max(range(n_features), key=at.__getitem__),)

    def learn(pack: list[list[float]]) -> None:
        new = sorted({chosen(w) for w in pack} - known.keys())
        if new:
            known.update((s, v - penalty * len(s) / n_features) for s, v in zip(new, fitness(m, new), strict=True))

    for _ in range(repeats):
        pack = [[r.random() for _ in range(n_features)] for _ in range(wolves)]
        leaders: list[tuple[float, list[float]]] = []
        for step in range(iterations):
            learn(pack)
            leaders = sorted([*leaders, *((known[chosen(w)], list(w)) for w in pack)], key=lambda x: -x[0])[:3]
            reach = 2 - 2 * step / max(1, iterations - 1)
            for wolf in pack:
                for i in range(n_features):
                    pull = 0.0
                    for _, leader in leaders:
                        a, c = 2 * reach * r.random() - reach, 2 * r.random()
                        pull += leader[i] - a * abs(c * leader[i] - wolf[i])
                    wolf[i] = 1 / (1 + np.exp(-pull / len(leaders)))
        for i in chosen(leaders[0][1]):
            recurrent[i] += 1 / repeats
    best = max(known, key=lambda s: (known[s], -len(s), s))
    return best, known[best], recurrent
