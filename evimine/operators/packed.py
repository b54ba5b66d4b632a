"""Models of many splits, subsets of features and shuffled columns over rows that are packed once.

Rows are written in blocks: label and features column by column, and a bit per split that says whether the row trains its models. A pass adds up,
for all models at once, what each needs (gradients and Hessians, histograms, counts), so a step of a fit is one job, whatever the number of
splits, and what reaches the driver is bounded by models, features, bins and tasks, never by rows. Linear models have balanced classes and unit
regularisation, as screening.fit; they are found by Newton's method, so they are the optimum of the same objective. Boosted trees are those of
Spark ML (logistic loss, 20 trees of depth 3, 32 bins), with cuts from all rows that train them instead of some thousands. Held-out rows are
ranked by ranges of scores of like size: distinct scores and their counts are dealt out, and no task holds more than a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimine.operators import quantiles
from evimine.operators.wrapper import _pack, _unpack
from evimine.sources.scratch import FINE, drop, ship, stored

#: Rows of a block, and of a piece of it whose products are held at a time.
BLOCK, PIECE = 1 << 15, 1 << 11
#: Newton steps at most, and the step (of a standardised weight) below which a model has settled.
STEPS, SETTLED = 100, 1e-7
#: Points of a sketch of values, scores that are held before they are dealt out, and scores of a range.
POINTS, HELD, RANGE = 512, 1 << 21, 1 << 19
#: Blocks on which a fit of many more takes its first steps.
FIRST = 64
#: Boosting: trees, depth, bins of a feature, and the weight of every tree but the first.
TREES, DEPTH, BINS, RATE = 20, 3, 32, 0.1
#: Combinations of bins up to which rows are summed up by them.
CELLS = 1 << 16


@dataclass
class Block:
    """Rows of a block: labels, features (one row each, NaN where there is no value), bits of the splits that they train, how often each row counts."""

    y: np.ndarray
    x: np.ndarray
    mask: np.ndarray
    times: np.ndarray | float

    def members(self, splits: Sequence[int], of: int) -> np.ndarray:
        """A row per split: which rows train it; split number `of` is trained by all."""
        out = np.empty((len(splits), len(self.mask)), bool)
        for i, t in enumerate(splits):
            out[i] = True if t == of else (self.mask >> self.mask.dtype.type(t)) & self.mask.dtype.type(1)
        return out


@dataclass
class Scale:
    """A common scale of all features, and per split (the last: all rows) what its training rows say, in that scale."""

    center: np.ndarray
    spread: np.ndarray
    medians: np.ndarray
    n: np.ndarray
    classes: np.ndarray  # weights of classes 0 and 1
    deviation: np.ndarray  # of the rows
    weighted: np.ndarray  # of the rows with the weights of their classes
    signal: np.ndarray  # absolute standardised difference between the classes, of given values

    def design(self, x: np.ndarray, split: int) -> np.ndarray:
        """An intercept and the features of a split's models in the common scale, nulls filled."""
        z = (x - self.center[:, None]) / self.spread[:, None]
        return np.vstack([np.ones((1, x.shape[1])), np.where(np.isnan(z), self.medians[split][:, None], z)])


@dataclass
class Rows:
    """Packed rows and their scale."""

    blocks: DataFrame
    features: list[str]
    splits: int
    scale: Scale


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            n, size, mask, times, payload = (batch.column(c)[i].as_py() for c in ("n", "size", "mask", "times", "payload"))
            y, *x = _unpack(payload, n, k + 1)
            yield Block(y == 1, np.stack(x) if x else np.empty((0, n)), np.frombuffer(mask, f"u{size}"), 1.0 if times is None else np.frombuffer(times, np.float64))


def _packed(wide: DataFrame, k: int, size: int, counted: bool) -> DataFrame:
    names = ["y", *(f"x{i}" for i in range(k))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            mask, times, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
            stats: list[float] = []
            for values in columns[1:]:
                some = values[~np.isnan(values)]
                weight = times[~np.isnan(values)]
                stats += [float(weight.sum()), float((some * weight).sum()), float(some.min(initial=np.inf)), float(some.max(initial=-np.inf))]
            parts = {"n": pa.array([len(mask)], pa.int32()), "size": pa.array([size], pa.int32()), "mask": pa.array([mask.astype(f"u{size}").tobytes()]), "times": pa.array([times.tobytes() if counted else None], pa.binary()), "payload": pa.array([_pack(columns)]), "stats": pa.array([stats], pa.list_(pa.float64()))}
            return pa.RecordBatch.from_arrays(list(parts.values()), names=list(parts))

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column("mask").to_numpy(), batch.column("times").to_numpy(), *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names)])
                n += batch.num_rows
            if n >= BLOCK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    ship(wide.sparkSession)
    return stored(wide.mapInArrow(run, "n int, size int, mask binary, times binary, payload binary, stats array<double>"), FINE)


def _summed(blocks: DataFrame, k: int, work: Callable[[Block], np.ndarray], length: int) -> np.ndarray:
    """The sum over all blocks of the vector that work gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for block in _blocks(batches, k):
            total += work(block)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["parts"])

    ship(blocks.sparkSession)
    found = blocks.drop("stats").mapInArrow(run, "parts binary").toArrow().column("parts")
    return sum((np.frombuffer(p.as_py(), np.float64) for p in found), np.zeros(length))


def rows(df: DataFrame, features: Sequence[str], label: str, trains: Sequence[Column], times: str | None = None) -> Rows:
    """df packed, with its scale. trains: per split, whether a row trains its models; the others are held out. times: a column that says how
    often a row counts. Rows without label take no part; nulls and NaN are no values and become the median of the rows that train the split."""
    if len(trains) > 63:
        raise ValueError("63 splits at most")
    k, size = len(features), next(s for s in (1, 2, 4, 8) if len(trains) <= 8 * s)
    some = df.where(F.col(label).isNotNull())
    bit = lambda t, c: F.when(c, F.lit(1 << t)).otherwise(F.lit(0)).cast("long")
    mask = sum((bit(t, c) for t, c in enumerate(trains)), F.lit(0).cast("long"))
    wide = some.select(F.col(label).cast("double").alias("y"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), mask.alias("mask"), (F.col(times) if times else F.lit(1)).cast("double").alias("times"))
    blocks = _packed(wide, k, size, times is not None)
    at = lambda i, j, fold: fold(F.get("stats", F.lit(4 * i + j)))
    found = blocks.agg(F.count(F.lit(1)), *(at(i, j, fold) for i in range(k) for j, fold in enumerate((F.sum, F.sum, F.min, F.max)))).first()[1:]
    given, total, low, high = (np.array([float(v) if v is not None else 0.0 for v in found[j::4]]) for j in range(4))
    center, spread = total / np.maximum(given, 1), np.where((given > 0) & (high > low), high - low, 4.0) / 4

    of = len(trains)

    def work(b: Block) -> np.ndarray:
        z = (b.x - center[:, None]) / spread[:, None]
        there = ~np.isnan(z)
        z[~there] = 0
        v = np.vstack([np.ones((1, len(b.y))), there, z, z * z])
        a = b.members(range(of + 1), of) * np.asarray(b.times)
        return np.stack([(a * ~b.y) @ v.T, (a * b.y) @ v.T]).ravel()

    sums = _summed(blocks, k, work, 2 * (of + 1) * (1 + 3 * k)).reshape(2, of + 1, 1 + 3 * k)
    n, there, first, second = sums[:, :, 0], sums[:, :, 1 : 1 + k], sums[:, :, 1 + k : 1 + 2 * k], sums[:, :, 1 + 2 * k :]
    lacks = [i for i in range(k) if there[:, of, i].sum() < n[:, of].sum()]
    medians = np.zeros((of + 1, k))
    for (t, i), m in _medians(wide, of, lacks, times is not None).items():
        medians[t, i] = (m - center[i]) / spread[i]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = first / there
        variance = np.where(there > 1, np.maximum(second - first * mean, 0), np.nan) / (there - 1)
        pooled = np.sqrt((variance[0] + variance[1]) / 2)
        signal = np.where(pooled * spread <= 1e-12, 0.0, np.abs(mean[1] - mean[0]) / pooled)
    # nulls as medians; an empty split has no model, whatever its scale
    first, second = first + (n[:, :, None] - there) * medians, second + (n[:, :, None] - there) * medians**2
    own, safe = n.sum(0), np.maximum(n.sum(0), 1)
    rate = n[1] / safe
    classes = np.stack([0.5 / np.maximum(1 - rate, 1e-9), 0.5 / np.maximum(rate, 1e-9)])
    deviation = np.sqrt(np.maximum(second.sum(0) - first.sum(0) ** 2 / safe[:, None], 0) / np.maximum(own - 1, 1)[:, None])
    weight, squared = (classes * n).sum(0), (classes**2 * n).sum(0)
    wfirst, wsecond = (classes[:, :, None] * first).sum(0), (classes[:, :, None] * second).sum(0)
    free = np.maximum(weight - squared / np.maximum(weight, 1e-300), 1e-300)
    weighted = np.sqrt(np.maximum(wsecond - wfirst**2 / np.maximum(weight, 1e-300)[:, None], 0) / free[:, None])
    still = deviation < 1e-9  # of a quarter of the range: no two values differ
    deviation[still] = weighted[still] = 0.0
    return Rows(blocks, list(features), of, Scale(center, spread, medians, n, classes, deviation, weighted, signal))


def _medians(wide: DataFrame, splits: int, lacks: list[int], counted: bool) -> dict[tuple[int, int], float]:
    """Exact medians of the features that lack values, per split and over all rows."""
    if not lacks:
        return {}
    member = lambda t: F.lit(True) if t == splits else F.shiftright("mask", t).bitwiseAND(F.lit(1)) == 1
    each = F.explode(F.filter(F.array(*(F.when(member(t), F.lit(t)) for t in range(splits + 1))), lambda t: t.isNotNull())).alias("split")
    table = stored(wide.select("mask", "times", *(f"x{i}" for i in lacks)), FINE)
    again = table.select(each, "times", *(f"x{i}" for i in lacks))
    long = again.unpivot(["split", "times"], [f"x{i}" for i in lacks], "feature", "value")
    if counted:
        long = long.select("split", "feature", "value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))).alias("copy"))
    out = {(r["split"], int(r["feature"][1:])): r["quantile"] for r in quantiles.quantiles(long, ["split", "feature"], [0.5]).collect()}
    drop(table)
    return out


# Linear models


@dataclass
class Linear:
    """A linear model of a split: its weights in the common scale, intercept first."""

    scale: Scale
    split: int
    weights: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.weights @ self.scale.design(x, self.split)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-self.margins(x)))

    def coefficients(self) -> np.ndarray:
        """Weights of the features, each by its standard deviation among the rows of the split."""
        return self.weights[1:] * self.scale.deviation[self.split]


def _evaluated(r: Rows, splits: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted log loss, its negative gradient and its Hessian at the weights of each model, over the rows that train its split."""
    scale, of, d = r.scale, r.splits, beta.shape[1]
    a, b = np.triu_indices(d)
    groups = {int(t): np.flatnonzero(splits == t) for t in np.unique(splits)}
    low, high = scale.classes[0][splits][:, None], scale.classes[1][splits][:, None]

    def add(z: np.ndarray, y: np.ndarray, weight: np.ndarray, own: np.ndarray, out: np.ndarray) -> None:
        for at in range(0, len(y), PIECE):
            zp, yp = z[:, at : at + PIECE], y[at : at + PIECE]
            e = beta[own] @ zp
            q = np.exp(-np.abs(e))
            p = np.where(e >= 0, 1, q) / (1 + q)
            w = weight[:, at : at + PIECE] * np.where(yp, high[own], low[own])
            out[own, 0] += (w * (np.log1p(q) + np.maximum(np.where(yp, -e, e), 0))).sum(1)
            out[own, 1 : 1 + d] += (w * (yp - p)) @ zp.T
            out[own, 1 + d :] += (w * p * (1 - p)) @ (zp[a] * zp[b]).T

    def work(block: Block) -> np.ndarray:
        out = np.zeros((len(splits), 1 + d + len(a)))
        weight = block.members(splits, of) * np.asarray(block.times)
        if np.isnan(block.x).any():
            for t, own in groups.items():
                add(scale.design(block.x, t), block.y, weight[own], own, out)
        else:
            add(scale.design(block.x, of), block.y, weight, np.arange(len(splits)), out)
        return out.ravel()

    found = _summed(r.blocks, d - 1, work, len(splits) * (1 + d + len(a))).reshape(len(splits), -1)
    hessian = np.empty((len(splits), d, d))
    hessian[:, a, b] = hessian[:, b, a] = found[:, 1 + d :]
    return found[:, 0], found[:, 1 : 1 + d], hessian


def _step(g: np.ndarray, h: np.ndarray, at: np.ndarray, penalty: np.ndarray, sparse: bool) -> np.ndarray:
    """From weights at to the least of the quadratic model with that penalty on the weights (0 for the intercept)."""
    if not sparse:
        h = h + np.diag(penalty**2)
        return np.linalg.solve(h + np.eye(len(g)) * 1e-12 * np.trace(h), g - penalty**2 * at)
    return _least(h, g + h @ at, penalty, at) - at


def _least(h: np.ndarray, b: np.ndarray, penalty: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where w @ h @ w / 2 - b @ w + penalty @ abs(w) is least, by search for the signs of w: exact, however alike the columns are."""
    h = h + np.eye(len(b)) * 1e-14 * np.trace(h)
    value = lambda w: w @ h @ w / 2 - b @ w + penalty @ np.abs(w)
    w, sign, active = start.copy(), np.sign(start), (start != 0) | (penalty == 0)
    for _ in range(100 * len(b)):
        own = np.flatnonzero(active)
        to = np.zeros(len(b))
        to[own] = np.linalg.solve(h[np.ix_(own, own)], b[own] - penalty[own] * sign[own])
        crossing = [i for i in own if penalty[i] and to[i] * sign[i] < 0]
        if crossing:
            tried = [to]
            for i in crossing:
                if w[i] != to[i]:
                    tried.append(w + (to - w) * (w[i] / (w[i] - to[i])))
                    tried[-1][i] = 0.0
            new = min(tried, key=value)
            if value(new) >= value(w):
                return w
            w, sign, active = new, np.sign(new), (new != 0) | (penalty == 0)
            continue
        w = to
        pull = b - h @ w
        beyond = np.where(active, -np.inf, np.abs(pull) - penalty * (1 + 1e-10))
        i = int(beyond.argmax())
        if beyond[i] <= 0:
            return w
        active[i], sign[i] = True, np.sign(pull[i])
    return w


def _descend(r: Rows, models: Sequence[tuple[int, tuple[int, ...]]], start: np.ndarray, sparse: bool, share: float = 1.0) -> np.ndarray:
    """The weights where the objective of each model is least. share: of all rows that r has, by which the penalty is less."""
    scale, beta = r.scale, start.copy()
    penalty = np.column_stack([np.zeros(len(models)), scale.weighted[[t for t, _ in models]]]) * (share if sparse else share**0.5)
    free = [np.array([0, *(i + 1 for i in chosen if penalty[m, i + 1] > 0)]) for m, (_, chosen) in enumerate(models)]
    cost = lambda m, w: np.abs(penalty[m] * w).sum() if sparse else ((penalty[m] * w) ** 2).sum() / 2
    best, sure, direction, factor = np.full(len(models), np.inf), beta.copy(), np.zeros_like(beta), np.ones(len(models))
    active = []
    for m, (t, _) in enumerate(models):
        if not scale.n[:, t].sum():
            raise ValueError("no rows to fit a model on")
        if not scale.n[:, t].all():  # one class: it is certain
            beta[m] = 0
            beta[m, 0] = np.inf if scale.n[1, t] else -np.inf
        else:
            active.append(m)
    for _ in range(STEPS):
        if not active:
            break
        loss, gradient, hessian = _evaluated(r, np.array([models[m][0] for m in active]), beta[active])
        going = []
        for m, value, g, h in zip(active, loss, gradient, hessian, strict=True):
            value += cost(m, beta[m])
            if value > best[m] * (1 + 1e-13):
                factor[m] /= 2
                beta[m] = sure[m] + factor[m] * direction[m]
                going += [m] if factor[m] > 1e-6 else []
                continue
            own, best[m], sure[m], factor[m] = free[m], value, beta[m], 1.0
            direction[m] = 0
            direction[m, own] = _step(g[own], h[np.ix_(own, own)], beta[m, own], penalty[m, own], sparse)
            beta[m] = sure[m] + direction[m]
            if np.abs(direction[m] * np.append(1.0, scale.weighted[models[m][0]])).max() > SETTLED:
                going.append(m)
        active = going
    return beta


def linear(r: Rows, models: Sequence[tuple[int, tuple[int, ...]]], sparse: bool = False, near: Sequence[Linear] | None = None) -> list[Linear]:
    """A logistic model for each split and subset of features; sparse: with an absolute instead of a quadratic penalty. All take their steps in the
    same passes until they settle, from models that are near theirs, or else from where a model of all rows leads. Of many blocks, some are enough for
    the first steps, which only choose where the passes over all rows begin."""
    k = len(r.features)
    if near and all(np.isfinite(m.weights).all() for m in near):
        found = _descend(r, models, np.stack([m.weights for m in near]), sparse)
        return [Linear(r.scale, t, w) for (t, _), w in zip(models, found, strict=True)]
    subsets = list(dict.fromkeys(chosen for _, chosen in models))
    start, every = np.zeros((len(subsets), k + 1)), [(r.splits, s) for s in subsets]
    if r.scale.n[:, r.splits].all():
        n = r.blocks.count()
        if n > 2 * FIRST:
            some = stored(r.blocks.where(F.rand(7) < FIRST / n), FINE)
            start = _descend(Rows(some, r.features, r.splits, r.scale), every, start, sparse, max(some.count(), 1) / n)
            start[~np.isfinite(start).all(1)] = 0
            drop(some)
        if len(models) > len(subsets):
            start = _descend(r, every, start, sparse)
    found = _descend(r, models, start[[subsets.index(s) for _, s in models]], sparse)
    return [Linear(r.scale, t, w) for (t, _), w in zip(models, found, strict=True)]


# Held-out rows


def condensed(values: np.ndarray, weights: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their weights; if they are more than points, those at the ends of so many parts of like weight."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    ends = np.flatnonzero(np.append(values[1:] != values[:-1], True)) if len(values) else np.empty(0, int)
    upto = np.cumsum(weights[order])[ends] if len(values) else np.empty(0)
    values = values[ends]
    if len(values) > points:
        at = np.unique(np.minimum(np.searchsorted(upto, upto[-1] * np.arange(1, points + 1) / points), len(values) - 1))
        values, upto = values[at], upto[at]
    return values, np.diff(upto, prepend=0.0)


def _sketched(parts: list[tuple[np.ndarray, np.ndarray]], points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    return condensed(np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts]), points) if parts else (np.empty(0), np.empty(0))


def _small(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them; the first byte tells how many."""
    size = next((s for s in (1, 2, 4) if counts.max(initial=0) < 1 << 8 * s), 8)
    return bytes([size]) + counts.astype(f"u{size}").tobytes()


def held_out(r: Rows, scorers: Sequence[Callable[[np.ndarray], np.ndarray]], splits: Sequence[int]) -> list[dict]:
    """Per model: auroc, average precision, recall, precision, balanced accuracy and F1.5 at one half, over the rows that its split holds out.

    scorers: scores of a block's features. Exact, with ties as in ranks.ranking_metrics.
    """
    k, of, m = len(r.features), r.splits, len(scorers)

    def scored(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        out = {t: np.flatnonzero(~own) for t, own in zip(set(splits), block.members(list(set(splits)), of), strict=True)}
        for i, (score, t) in enumerate(zip(scorers, splits, strict=True)):
            if len(out[t]):
                yield i, score(block.x[:, out[t]]), block.y[out[t]], np.broadcast_to(np.asarray(block.times, float), block.y.shape)[out[t]]

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, parts = np.zeros((m, 4)), [[] for _ in range(m)]
        for block in _blocks(batches, k):
            for i, s, y, times in scored(block):
                hit = s >= 0.5
                cells[i] += [times[c].sum() for c in (hit & y, hit & ~y, ~hit & y, ~hit & ~y)]
                parts[i].append(condensed(s, times))
                if len(parts[i]) >= 32:
                    parts[i] = [_sketched(parts[i])]
        for i in range(m):
            v, w = _sketched(parts[i])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x.tobytes()]) for x in (cells[i], v, w))], names=["model", "cells", "points", "weights"])

    ship(r.blocks.sparkSession)
    plain, array = r.blocks.drop("stats"), lambda b: np.frombuffer(b, np.float64)
    cells, parts = np.zeros((m, 4)), [[] for _ in range(m)]
    for row in plain.mapInArrow(survey, "model int, cells binary, points binary, weights binary").toArrow().to_pylist():
        cells[row["model"]] += array(row["cells"])
        parts[row["model"]].append((array(row["points"]), array(row["weights"])))
    bounds = [_sketched(p, max(1, round(c.sum() / RANGE)))[0][:-1] for p, c in zip(parts, cells, strict=True)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in range(m)], 0

        def records() -> Iterator[pa.RecordBatch]:
            for i in range(m):
                if not held[i]:
                    continue
                s, y, times = (np.concatenate(c) for c in zip(*held[i], strict=True))
                order = np.argsort(s)
                s, pos, all_ = s[order], (times * y)[order], times[order]
                starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                pos, all_, s = np.add.reduceat(pos, starts).astype(np.int64), np.add.reduceat(all_, starts).astype(np.int64), s[starts]
                cuts = [0, *np.searchsorted(s, bounds[i], "right").tolist(), len(s)]
                found = [(i, part, s[a:b].tobytes(), _small(pos[a:b]), _small((all_ - pos)[a:b]), int(pos[a:b].sum()), int((all_ - pos)[a:b].sum())) for part, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["model", "part", "scores", "pos", "neg", "n_pos", "n_neg"])

        for block in _blocks(batches, k):
            for i, *found in scored(block):
                held[i].append(found)
                n += len(found[0])
            if n >= HELD:
                yield from records()
                held, n = [[] for _ in range(m)], 0
        yield from records()

    dealt = stored(plain.mapInArrow(deal, "model int, part int, scores binary, pos binary, neg binary, n_pos long, n_neg long"), FINE)
    totals = {(t["model"], t["part"]): (t["p"], t["n"]) for t in dealt.groupBy("model", "part").agg(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("n")).collect()}
    before, above = {}, np.zeros((m, 2))
    for i, part in sorted(totals, key=lambda x: (x[0], -x[1])):  # from the greatest scores
        before[i, part] = tuple(above[i])
        above[i] += totals[i, part]

    def ranked(table: pa.Table) -> pa.Table:
        i, part = table.column("model")[0].as_py(), table.column("part")[0].as_py()
        s = np.concatenate([np.frombuffer(b.as_py(), np.float64) for b in table.column("scores")])
        pos, neg = (np.concatenate([np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.float64) for b in table.column(c).to_pylist()]) for c in ("pos", "neg"))
        order = np.argsort(-s)
        s, pos, neg = s[order], pos[order], neg[order]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        pos, neg = np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
        tp, fp = before[i, part][0] + np.cumsum(pos), before[i, part][1] + np.cumsum(neg)
        return pa.table({"model": pa.array([i], pa.int32()), "wins": [float((neg * (tp - pos / 2)).sum())], "area": [float((pos * (tp / (tp + fp))).sum())]})

    sums = np.zeros((m, 2))
    for row in dealt.groupBy("model", "part").applyInArrow(ranked, "model int, wins double, area double").toArrow().to_pylist():
        sums[row["model"]] += row["wins"], row["area"]
    drop(dealt)
    return [_metrics(c, *s) for c, s in zip(cells.tolist(), sums.tolist(), strict=True)]


def _metrics(cells: Sequence[float], wins: float, area: float) -> dict:
    tp, fp, fn, tn = cells
    ratio = lambda a, b: a / b if b else 0.0
    recall = ratio(tp, tp + fn)
    return {
        "auroc": wins / ((tp + fn) * (fp + tn)) if (tp + fn) * (fp + tn) else None, "average_precision": area / (tp + fn) if tp + fn else None, "recall": recall, "precision": ratio(tp, tp + fp),
        "balanced_accuracy": (recall + ratio(tn, tn + fp)) / 2, "f_beta": ratio(3.25 * tp, 3.25 * tp + 2.25 * fn + fp),
    }


# Boosted trees


@dataclass
class Tree:
    """A tree of DEPTH levels, in the order of a heap: at a node, codes of a feature above an edge go right; a node that is not split sends all left."""

    features: np.ndarray
    edges: np.ndarray
    leaves: np.ndarray

    def places(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """Which node of a level each row comes to."""
        at = np.zeros(codes.shape[1], np.uint8)
        for level in range(depth):
            right = np.zeros(len(at), bool)
            for i in range(1 << level):
                node = (1 << level) - 1 + i
                right |= (at == i) & (codes[self.features[node]] > self.edges[node])
            at = 2 * at + right
        return at


@dataclass
class Boosted:
    """Boosted trees of a split over some features, and the cuts that make codes of these."""

    scale: Scale
    split: int
    chosen: tuple[int, ...]
    cuts: list[np.ndarray]
    trees: list[Tree]

    def margins(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(codes.shape[1])
        for i, tree in enumerate(self.trees):
            out += np.take(tree.leaves * (RATE if i else 1.0), tree.places(codes, DEPTH))
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * self.margins(_codes(self.scale, self.split, x, self.chosen, self.cuts))))


def _codes(scale: Scale, split: int, x: np.ndarray, chosen: Sequence[int], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each value of the chosen features, of which each has its cuts: how many of them are below it."""
    out = np.empty((len(chosen), x.shape[1]), np.uint8)
    for i, (f, c) in enumerate(zip(chosen, cuts, strict=True)):
        values = np.where(np.isnan(x[f]), scale.center[f] + scale.spread[f] * scale.medians[split, f], x[f])
        out[i] = np.searchsorted(c, values)
    return out


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between distinct values in order: all if they are few, or where bins of like weight end, as Spark ML makes them of its sample."""
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    stride, upto = weights.sum() / bins, np.cumsum(weights)
    target, out = stride, []
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(out[: bins - 1])


def _trained(scale: Scale, splits: int, split: int, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows of a block that train a split, and their weights."""
    own = np.flatnonzero(b.members([split], splits)[0])
    return own, scale.classes[b.y[own].astype(int), split] * np.broadcast_to(np.asarray(b.times, float), b.y.shape)[own]


def _cuts(r: Rows, split: int, chosen: Sequence[int]) -> list[np.ndarray]:
    """The cuts of each chosen feature, from sketches of all rows that train the split."""
    plain, k, scale, splits = r.blocks.drop("stats"), len(r.features), r.scale, r.splits

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = [[] for _ in chosen]
        for b in _blocks(batches, k):
            own, weight = _trained(scale, splits, split, b)
            for i, f in enumerate(chosen):
                values = np.where(np.isnan(b.x[f, own]), scale.center[f] + scale.spread[f] * scale.medians[split, f], b.x[f, own])
                parts[i].append(condensed(values, weight))
                if len(parts[i]) >= 32:
                    parts[i] = [_sketched(parts[i])]
        for i in range(len(chosen)):
            v, w = _sketched(parts[i])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([v.tobytes()]), pa.array([w.tobytes()])], names=["at", "points", "weights"])

    ship(plain.sparkSession)
    parts: list[list] = [[] for _ in chosen]
    for row in plain.mapInArrow(survey, "at int, points binary, weights binary").toArrow().to_pylist():
        parts[row["at"]].append((np.frombuffer(row["points"], np.float64), np.frombuffer(row["weights"], np.float64)))
    return [thresholds(*_sketched(p, 1 << 16)) for p in parts]


def boosted(r: Rows, split: int, subsets: Sequence[tuple[int, ...]]) -> list[Boosted]:
    """Boosted trees of a split for each subset of features. A row is a byte per feature, written once; a level of a tree of all subsets is one job,
    in which the margins of the trees before are worked out anew. Subsets with few combinations of bins are summed up by these in one job."""
    scale, splits, k = r.scale, r.splits, len(r.features)
    if not scale.n[:, split].sum():
        raise ValueError("no rows to fit a model on")
    every = sorted({f for s in subsets for f in s})
    cuts = _cuts(r, split, every)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, k):
            own, weight = _trained(scale, splits, split, b)
            if len(own):
                few, at = np.unique(weight, return_inverse=True)
                weights = few.tobytes() + at.astype(np.uint8).tobytes() if len(few) <= 255 else weight.tobytes()
                payload = np.vstack([b.y[own].astype(np.uint8)[None], _codes(scale, split, b.x[:, own], every, cuts)]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int32()), pa.array([len(few) if len(few) <= 255 else 0], pa.int32()), pa.array([weights]), pa.array([payload])], names=["n", "few", "weights", "payload"])

    coded = stored(r.blocks.drop("stats").mapInArrow(code, "n int, few int, weights binary, payload binary"), FINE)
    models = [Boosted(scale, split, s, [cuts[every.index(f)] for f in s], []) for s in subsets]
    cells = _cells(coded, models, every)
    for _ in range(TREES):
        nodes = (1 << DEPTH) - 1
        growing = [Tree(np.zeros(nodes, int), np.full(nodes, 255), np.zeros(nodes + 1)) for _ in models]
        for level in range(DEPTH):
            for m, tree, sums in zip(models, growing, _histograms(coded, models, growing, every, level, cells), strict=True):
                for i in range(1 << level):
                    node, (f, edge, left, right) = (1 << level) - 1 + i, _best(sums[:, i], m.cuts)
                    tree.features[node], tree.edges[node] = f, edge
                    if level == DEPTH - 1:
                        tree.leaves[2 * i : 2 * i + 2] = left, right
        for m, tree in zip(models, growing, strict=True):
            m.trees.append(tree)
    drop(coded)
    return models


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Labels, weights and codes of each block."""
    for batch in batches:
        for n, few, weights, payload in zip(*(batch.column(c).to_pylist() for c in ("n", "few", "weights", "payload")), strict=True):
            y, *codes = np.frombuffer(payload, np.uint8).reshape(-1, n)
            weight = np.frombuffer(weights, np.float64, few)[np.frombuffer(weights, np.uint8, n, 8 * few)] if few else np.frombuffer(weights, np.float64)
            yield y, weight, codes


def _cells(coded: DataFrame, models: Sequence[Boosted], every: Sequence[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, weights and codes of all combinations of bins and labels that occur, for the models (by number) that have few."""
    shapes = {i: (2, *(len(c) + 1 for c in m.cuts)) for i, m in enumerate(models) if 2 * np.prod([float(len(c) + 1) for c in m.cuts]) <= CELLS}
    if not shapes:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros(int(np.prod(shape))) for i, shape in shapes.items()}
        for y, weight, codes in _coded(batches):
            for i, shape in shapes.items():
                at = np.ravel_multi_index((y, *(codes[every.index(f)] for f in models[i].chosen)), shape)
                sums[i] += np.bincount(at, weight, len(sums[i]))
        for i, values in sums.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype(np.int64).tobytes()]), pa.array([values[at].tobytes()])], names=["model", "at", "weights"])

    total = {i: np.zeros(int(np.prod(shape))) for i, shape in shapes.items()}
    for row in coded.mapInArrow(run, "model int, at binary, weights binary").toLocalIterator():
        total[row["model"]][np.frombuffer(row["at"], np.int64)] += np.frombuffer(row["weights"], np.float64)
    out = {}
    for i, values in total.items():
        at = np.flatnonzero(values)
        y, *codes = np.unravel_index(at, shapes[i])
        out[i] = y == 1, values[at], np.stack(codes).astype(np.uint8) if codes else np.empty((0, len(at)), np.uint8)
    return out


def _add(own: np.ndarray, m: Boosted, tree: Tree, level: int, y: np.ndarray, weight: np.ndarray, codes: np.ndarray) -> None:
    """Add to a model's sums (2, nodes of the level, features, bins) of the weights, and of the weighted residuals, of the rows that come there."""
    sign = np.where(y, 1.0, -1.0)
    with np.errstate(over="ignore"):
        residual = 4 * sign / (1 + np.exp(2 * sign * m.margins(codes))) if m.trees else sign
    pull, base = weight * residual, tree.places(codes, level).astype(np.intp) * BINS
    for i in range(len(codes)):
        at = base + codes[i]
        own[0, :, i] += np.bincount(at, weight, BINS << level).reshape(-1, BINS)
        own[1, :, i] += np.bincount(at, pull, BINS << level).reshape(-1, BINS)


def _histograms(coded: DataFrame, models: Sequence[Boosted], growing: Sequence[Tree], every: Sequence[int], level: int, cells: dict) -> list[np.ndarray]:
    """The sums of a level, per model: from its cells, or from all rows."""
    out = [np.zeros((2, 1 << level, len(m.chosen), BINS)) for m in models]
    for i, found in cells.items():
        _add(out[i], models[i], growing[i], level, *found)
    rest = [i for i in range(len(models)) if i not in cells]
    if not rest:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(out[i]) for i in rest]
        for y, weight, codes in _coded(batches):
            for i, own in zip(rest, sums, strict=True):
                _add(own, models[i], growing[i], level, y, weight, np.stack([codes[every.index(f)] for f in models[i].chosen]))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in sums]).tobytes()])], names=["parts"])

    found = coded.mapInArrow(run, "parts binary").toArrow().column("parts")
    total = sum((np.frombuffer(p.as_py(), np.float64) for p in found), np.zeros(sum(out[i].size for i in rest)))
    for i, values in zip(rest, np.split(total, np.cumsum([out[i].size for i in rest])[:-1]), strict=True):
        out[i] = values.reshape(out[i].shape)
    return out


def _best(sums: np.ndarray, cuts: Sequence[np.ndarray]) -> tuple[int, int, float, float]:
    """The feature, edge and means of both sides of the split of a node (2, features, bins) that lowers the variance most; edge 255 and the mean if none does."""
    if not len(cuts):
        return 0, 255, 0.0, 0.0
    upto = sums.cumsum(-1)
    w, s = upto[:, 0, -1]
    best, out = 1e-12 * (s / w) ** 2 if w > 0 else np.inf, (0, 255, s / w if w > 0 else 0.0, 0.0)
    for f, c in enumerate(cuts):
        (wl, sl), (wr, sr) = upto[:, f, : len(c)], (np.array([[w], [s]]) - upto[:, f])[:, : len(c)]
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = np.where((wl > 0) & (upto[0, f, -1] - wl > 1e-12 * w), (sl * sl / wl + sr * sr / wr - s * s / w) / w, -np.inf)
        edge = int(gain.argmax()) if len(c) else 0
        if len(c) and gain[edge] > best:
            best, out = gain[edge], (f, edge, sl[edge] / wl[edge], sr[edge] / wr[edge])
    return out
