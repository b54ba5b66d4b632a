"""Language identification by a bidirectional gated recurrent network over bytes.

Method: two gated recurrent layers read a text's bytes forwards and backwards; at every position a softmax over the joined
states labels that byte, and a document's probabilities are the mean over all its bytes. Trained in numpy by backpropagation
through time on a bounded, seeded sample of labelled rows: of each language its share of SAMPLE rows, and EACH rows at least if
it has so many, at most SAMPLE_CHARS characters of each. Rows are drawn by a threshold on their seeded order from the
counted rows of their language, so tasks send the driver little more than the sample in all. The network has a fixed
size and is all that executors receive. Every byte of every text is read, in segments of SEGMENT bytes, a bounded number
of segments at a time; a state starts anew with each segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimine.llm import _text
from evimine.llm._spark import ship

#: The bound on training rows, and the part of each that is read.
SAMPLE, SAMPLE_CHARS = 3000, 400
#: Rows of each language, if it has so many.
EACH = 100
HIDDEN, SEGMENT, STEPS, BATCH, RATE = 12, 128, 250, 64, 0.01
#: Segments read together.
TOGETHER = 2048
UNKNOWN = "und"


def _squash(x: np.ndarray) -> np.ndarray:
    """A rational tanh, exactly -1 and 1 beyond -3 and 3."""
    x = np.clip(x, -3, 3)
    s = x * x
    return x * (27 + s) / (27 + 9 * s)


def _slope(x: np.ndarray) -> np.ndarray:
    """The derivative of _squash at x."""
    s = np.minimum(x * x, 9)
    return ((9 - s) / (9 + 3 * s)) ** 2


class Network(NamedTuple):
    """Per direction: byte embeddings already multiplied into the gates, and recurrent weights; then the output layer."""

    languages: list[str]
    inputs: np.ndarray  # 2, 256, 3 hidden
    states: np.ndarray  # 2, hidden, 3 hidden
    output: np.ndarray  # 2 hidden, languages
    bias: np.ndarray


def _forward(net: Network, data: np.ndarray, real: np.ndarray, keep: bool = False):
    """States (time, rows, 2 hidden) and, if wanted, what the way back needs. data, real: time, rows."""
    steps, rows = data.shape
    hidden = net.states.shape[1]
    states = np.empty((steps, rows, 2 * hidden), net.states.dtype)
    trace = []
    for way in (0, 1):
        h = np.zeros((rows, hidden), net.states.dtype)
        part = slice(way * hidden, (way + 1) * hidden)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            x = net.inputs[way].take(data[t], 0)
            u = h @ net.states[way]
            open_ = 0.5 * (x[:, : 2 * hidden] + u[:, : 2 * hidden])
            gates = 0.5 + 0.5 * _squash(open_)
            z, r = gates[:, :hidden], gates[:, hidden:]
            fresh = x[:, 2 * hidden :] + r * u[:, 2 * hidden :]
            n = _squash(fresh)
            new = (n + z * (h - n)) * real[t][:, None]
            if keep:
                trace.append((way, t, h, z, r, n, u[:, 2 * hidden :], 0.25 * _slope(open_), _slope(fresh)))
            h = new
            states[t, :, part] = h
    return states, trace


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def label_positions(net: Network, data: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Probabilities of the languages at every byte: time, rows, languages."""
    states, _ = _forward(net, data, real)
    return _softmax(states @ net.output + net.bias)


def _gradients(net: Network, data: np.ndarray, real: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over all real positions."""
    hidden = net.states.shape[1]
    states, trace = _forward(net, data, real, keep=True)
    error = _softmax(states @ net.output + net.bias)
    error[:, np.arange(len(label)), label] -= 1
    error *= (real / max(1.0, float(real.sum())))[:, :, None]
    d_output = np.tensordot(states, error, ((0, 1), (0, 1)))
    d_bias = error.sum((0, 1))
    d_states = error @ net.output.T
    d_inputs, d_recurrent = np.zeros_like(net.inputs), np.zeros_like(net.states)
    carried = [np.zeros((data.shape[1], hidden), states.dtype) for _ in (0, 1)]
    for way, t, h, z, r, n, u, gate_slope, slope in reversed(trace):
        dh = (d_states[t, :, way * hidden : (way + 1) * hidden] + carried[way]) * real[t][:, None]
        dn = dh * (1 - z) * slope
        dz = dh * (h - n) * gate_slope[:, :hidden]
        dr = dn * u * gate_slope[:, hidden:]
        pre = np.concatenate([dz, dr, dn], 1)
        np.add.at(d_inputs[way], data[t], pre)
        pre[:, 2 * hidden :] *= r
        d_recurrent[way] += h.T @ pre
        carried[way] = dh * z + pre @ net.states[way].T
    return [d_inputs, d_recurrent, d_output, d_bias]


def segments(texts: list[bytes], length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and mask (time, segments) of all texts cut into segments, and each segment's text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    parts = -(-sizes // length)
    starts = np.concatenate([[0], np.cumsum(parts)])
    flat = np.zeros(int(starts[-1]) * length, np.uint8)
    for t, s in zip(texts, starts.tolist(), strict=False):
        flat[s * length : s * length + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), parts)
    left = sizes[owner] - (np.arange(len(owner)) - starts[owner]) * length
    real = np.arange(length)[None, :] < left[:, None]
    return np.ascontiguousarray(flat.reshape(-1, length).T), np.ascontiguousarray(real.T).astype(np.float32), owner


def train(texts: list[bytes], labels: list[str], seed: int = 5, steps: int = STEPS, hidden: int = HIDDEN) -> Network:
    """Languages are drawn equally often; Adam with a falling rate."""
    rng = np.random.Generator(np.random.PCG64(seed))
    languages = sorted(set(labels))
    data, real, owner = segments(texts)
    code = np.array([languages.index(x) for x in labels])[owner]
    by_label = [np.flatnonzero(code == i) for i in range(len(languages))]
    by_label = [x for x in by_label if len(x)]
    scale = 1 / np.sqrt(hidden)
    draw = lambda *shape: rng.uniform(-scale, scale, shape).astype(np.float32)
    weights = [draw(2, 256, 3 * hidden), draw(2, hidden, 3 * hidden), draw(2 * hidden, len(languages)), np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(steps if by_label else 0):
        rows = np.array([rng.choice(by_label[i]) for i in rng.integers(0, len(by_label), BATCH)])
        for w, m, v, g in zip(weights, first, second, _gradients(Network(languages, *weights), data[:, rows], real[:, rows], code[rows]), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= RATE * (1 - step / steps) * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-8)
    return Network(languages, *weights)


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """The mean over all bytes of each text."""
    total = np.zeros((len(texts), len(net.languages)))
    data, real, owner = segments(texts)
    for low in range(0, len(owner), TOGETHER):
        part = slice(low, low + TOGETHER)
        each = label_positions(net, data[:, part], real[:, part])
        np.add.at(total, owner[part], (each * real[:, part][:, :, None]).sum(0))
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def learn(docs: DataFrame, allowed: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", seed: int = 5) -> Network:
    """A network trained on a sample of the rows with a letter in text and a lang for which allowed holds.

    Null texts, null langs and rows for which allowed is null teach nothing; repeated rows may be drawn each; without any row nothing
    is learned. The number of languages, not of rows, bounds what is counted on the driver.
    """
    ship(docs.sparkSession)
    usable = docs.where(F.coalesce(allowed, F.lit(False)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in usable.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    quota = {x: min(n, max(EACH, -(-SAMPLE * n // total))) for x, n in counts.items()}
    # twice the quota and some more lie below the threshold, so that a full quota is all but certain
    parts = 1 << 30
    below = [(x, min(parts, parts * (2 * quota[x] + 50) // n), quota[x]) for x, n in counts.items()]
    place = F.pmod(F.xxhash64(F.lit(seed + 1), doc_id), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS)) + 1
    piece = F.substring(F.col(text), place.cast("int"), F.lit(SAMPLE_CHARS))
    order = F.xxhash64(F.lit(seed), doc_id, F.hash(text))
    limits = F.broadcast(docs.sparkSession.createDataFrame(below, "l string, below long, quota long"))
    drawn = usable.select(piece.alias("t"), F.col(lang).alias("l"), order.alias("o")).join(limits, "l").where(F.pmod("o", F.lit(parts)) < F.col("below"))
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("o", "t"))).where("k <= quota")
    rows = sorted(ranked.select("o", "l", "t").collect())
    return train([r["t"].encode() for r in rows], [r["l"] for r in rows], seed)


def predict(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the mean probability of that language over all bytes of the text.

    Null texts and texts without a letter are `und` with score 0, as is everything if nothing was learned. Ties go to the
    first language in order. Rows and other columns stay; columns named lang_pred or score are replaced.
    """
    ship(docs.sparkSession)
    kept = docs.drop("lang_pred", "score").withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    fields = [f for f in kept.schema.fields if f.name != "_letters"]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [f.name for f in fields]
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            languages, best, score = sent.value.languages, np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for chunk in _text.chunks(batch.column(text)) if languages else ():
                rows = np.flatnonzero(letters[chunk.low : chunk.high])
                each = document_probabilities(sent.value, [_text.text_at(chunk, r) for r in rows])
                best[chunk.low + rows] = each.argmax(1)
                score[chunk.low + rows] = np.clip(each.max(1), 0, 1) if len(rows) else 0
            said = [languages[b] if ok and languages else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            columns = [*(batch.column(n) for n in names), pa.array(said, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
