"""Language-model scoring with a weighted backoff automaton.

Method: word bigrams of the training texts, smoothed by absolute discounting, become an automaton. Each frequent word
(and the start of a text) is a state; a kept bigram is a weighted arc from its first word's state; every state has a
failure arc to the root, weighted with the probability mass that its arcs leave; the root emits any word by the add-half
unigram distribution. A text is scored in one pass from left to right that carries the state: the arc if there is one,
else the failure arc and the root. Probabilities after every state sum to one.

All training words are counted exactly, and so is every bigram seen LEAST times or more: a count-min sketch drops pairs that
occur once before they are counted, and none that occurs twice. Executors receive the automaton only: its states and arcs
are bounded by HEAD and ARCS (those above a power of two that leaves at most so many), its failure weights come from all
arcs. What is beyond it is looked up by shuffle: the count and failure weight of words that are no state, and per
remaining bigram its gain over the failure arc and the root. A stretch of text asks each part for its names once, keeps
the places where they occur, and adds up what it is told; so what moves follows the text, and the score is that of the
whole model, whatever the bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimine.llm import _packed, _sketch, _text
from evimine.llm._spark import cut, forget, ship

#: Most states and arcs of the automaton; fewest occurrences of an arc; discount.
HEAD, ARCS, LEAST, DISCOUNT = 1 << 19, 1 << 20, 2, 0.75
COUNT_BYTES, STRETCH_BYTES, STRETCH_TEXTS, GROUP_WORDS, SENT_BYTES = 8 << 20, 4 << 20, 50_000, 2_500_000, 2 << 20
_START = 1 << 20  # a state beyond any word's
_END = _START + 1
#: Cells of a row of the sketch are 2**bits.
LEAST_BITS, MOST_BITS, DEPTH = 16, 28, 2
#: What stands for the start and the end of a text where words are named by hash.
START_NAME, END_NAME = np.uint64(0x5BF0A8B1457695FB), np.uint64(0xA3EC647659359ACD)


class Automaton(NamedTuple):
    """Words of the states in order of name, and what a traversal adds up (log10)."""

    names: np.ndarray
    root: np.ndarray  # of each state's word, then of the end of a text
    failure: np.ndarray  # of each state, then of the start of a text
    arcs: np.ndarray  # sorted: state << 21 | word
    weight: np.ndarray
    tokens: int
    kinds: int

    def states(self, names: np.ndarray) -> np.ndarray:
        """The state of each word, -1 if it has none."""
        if not len(self.names):
            return np.full(len(names), -1, np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, -1)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


def _sequence(states: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's state before it and its own state, over all texts of a chunk, each closed by an end; and its row."""
    rows = len(first) - 1
    counts = np.diff(first)
    out = np.full(len(states) + rows, _END, np.int64)
    ends = first[1:] + np.arange(rows)  # place of each text's end
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = states
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[ends - counts] = _START
    return before, out, np.repeat(np.arange(rows), counts + 1)


def _named(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _sequence, by the names of the words."""
    counts = np.diff(first)
    ends = first[1:] + np.arange(len(first) - 1)
    now = np.full(len(names) + len(ends), END_NAME)
    inside = np.ones(len(now), bool)
    inside[ends] = False
    now[inside] = names
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[ends - counts] = START_NAME
    return before, now


def _pair(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Name of a bigram."""
    return _text.mix(before * np.uint64(0x9E3779B97F4A7C15) + now)


def traverse(model: Automaton, states: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: log10 of its tokens at the root, and by the automaton, words that are no state left out of both; and the tokens on an arc."""
    before, now, row = _sequence(states, first)
    n = len(model.names)
    from_ = np.where(before == _START, n, before)
    to = np.where(now == _END, n, now)
    root = np.where(now >= 0, model.root[to], 0.0)
    failure = np.where(before >= 0, model.failure[from_], 0.0)
    score, arc = failure + root, np.zeros(len(now), bool)
    if len(model.arcs):
        key = from_ << 21 | to
        at = np.minimum(np.searchsorted(model.arcs, key), len(model.arcs) - 1)
        arc = (before >= 0) & (now >= 0) & (model.arcs[at] == key)
        score = np.where(arc, model.weight[at], score)
    rows = len(first) - 1
    return np.bincount(row, root, rows), np.bincount(row, score, rows), arc


def _words(batch: pa.RecordBatch) -> Iterator[tuple[_text.Chunk, _text.Words, np.ndarray]]:
    for chunk in _text.chunks(batch.column("text")):
        found = _text.words(chunk)
        yield chunk, found, _text.hashes(chunk, found, lower=True)


def _some(made: Iterator, size) -> Iterator[list]:
    """Lists of what is made, a bounded number of bytes (or one of them) at a time."""
    held, total = [], 0
    for one in made:
        held.append(one)
        total += size(one)
        if total >= SENT_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def _in_batches(made: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for held in _some(made, lambda r: len(r[1])):
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.int32()), pa.array([x for _, x in held], pa.binary())], names=["part", "payload"])


def _counted(texts: DataFrame, keys, parts: int, least: int) -> DataFrame:
    """part, names and counts (packed) of all keys, an array per chunk of text, that occur at least so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            names, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            order = np.argsort(mixed := _text.mix(names), kind="stable")
            yield from _in_batches((p, _packed.pack(names[order[r]], counts[order[r]].astype(np.uint32))) for p, r in _packed.runs(mixed[order], parts))

        for batch in batches:
            for chunk, found, names in _words(batch):
                held.append(keys(found, names))
                size += len(chunk.data)
                if size >= COUNT_BYTES:
                    yield from rows()
                    size = 0
        if held:
            yield from rows()

    def merge(t: pa.Table) -> pa.Table:
        pieces = _packed.unpack_all(t.column("payload").to_pylist(), (np.uint64, np.uint32))
        names, counts = _packed.summed(np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]).astype(np.int64))
        names, counts = names[counts >= least], counts[counts >= least]
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "names": [names.tobytes()], "counts": [counts.tobytes()], "total": pa.array([int(counts.sum())], pa.int64()), "kinds": pa.array([len(names)], pa.int64())})

    return texts.mapInArrow(run, "part int, payload binary").groupBy("part").applyInArrow(merge, "part int, names binary, counts binary, total long, kinds long")


def _names_and_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for names, counts in zip(batch.column("names").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            yield np.frombuffer(names, np.uint64), np.frombuffer(counts, np.int64)


def _largest(counted: DataFrame, most: int, each) -> tuple[np.ndarray, np.ndarray]:
    """Names and counts (each: of batches of counted) from the smallest power of two that leaves at most so many, by name.

    Two passes of one Python step each: steps in a row would hold a worker of their own per task.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65, np.int64)
        for _, counts in each(batches):
            total += np.bincount(np.frexp(counts)[1], minlength=65)  # by power of two
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["sizes"])

    sizes = counted.mapInArrow(tally, "sizes array<long>").select(F.posexplode("sizes").alias("power", "n")).groupBy("power").agg(F.sum("n").alias("n")).collect()
    by_power, power, left = {r["power"]: r["n"] for r in sizes}, 65, 0
    while power > 0 and left + by_power.get(power - 1, 0) <= most:
        power -= 1
        left += by_power.get(power, 0)
    least = 2 ** (power - 1) if power else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, counts in each(batches):
            yield pa.RecordBatch.from_arrays([pa.array([names[counts >= least].tobytes()]), pa.array([counts[counts >= least].tobytes()])], names=["names", "counts"])

    rows = counted.mapInArrow(run, "names binary, counts binary").collect()
    names = np.frombuffer(b"".join(bytes(r["names"]) for r in rows), np.uint64)
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in rows), np.int64)
    order = np.argsort(names, kind="stable")
    return names[order], counts[order]


_SENT_PAIRS = (np.uint64, np.uint32, np.uint64, np.uint64, np.uint32)


def _counted_pairs(texts: DataFrame, bitmaps, head, bits: int, parts: int) -> DataFrame:
    """part, both names and counts (packed) of all bigrams that occur LEAST times or more, and their number.

    Bigrams of two states (head: their names, sent) travel as the states' numbers, others as two names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            before, now = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            names, at, counts = np.unique(_pair(before, now), return_index=True, return_counts=True)
            before, now, counts = before[at], now[at], counts.astype(np.uint32)
            n = len(head.value)
            from_ = np.where(before == START_NAME, n, _at(head.value, before))
            to = np.where(now == END_NAME, n, _at(head.value, now))
            short, key = (from_ >= 0) & (to >= 0), (from_ << 21 | to).astype(np.uint64)
            pick = lambda r: (key[r][short[r]], counts[r][short[r]], before[r][~short[r]], now[r][~short[r]], counts[r][~short[r]])
            yield from _in_batches((p, _packed.pack(*pick(r))) for p, r in _packed.runs(names, parts))

        for batch in batches:
            for chunk, found, names in _words(batch):
                before, now = _named(names, found.first)
                may = _sketch.maybe(bitmaps.value, _pair(before, now), bits)
                held.append((before[may], now[may]))
                size += len(chunk.data)
                if size >= COUNT_BYTES:
                    yield from rows()
                    size = 0
        if held:
            yield from rows()

    def merge(t: pa.Table) -> pa.Table:
        pieces = _packed.unpack_all(t.column("payload").to_pylist(), _SENT_PAIRS)
        key, often, before, now, each = (np.concatenate(x) for x in zip(*pieces, strict=True))
        key = key.astype(np.int64)
        before = np.concatenate([before, np.append(head.value, START_NAME)[key >> 21]])
        now = np.concatenate([now, np.append(head.value, END_NAME)[key & ((1 << 21) - 1)]])
        each = np.concatenate([each, often])
        _, at, back = np.unique(_pair(before, now), return_index=True, return_inverse=True)
        counts = np.bincount(back, each, len(at)).astype(np.int64)
        keep = counts >= LEAST
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "befores": [before[at][keep].tobytes()], "nows": [now[at][keep].tobytes()], "counts": [counts[keep].tobytes()], "kinds": pa.array([int(keep.sum())], pa.int64())})

    return texts.mapInArrow(run, "part int, payload binary").groupBy("part").applyInArrow(merge, "part int, befores binary, nows binary, counts binary, kinds long")


def _each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for b, n, c in zip(*(batch.column(x).to_pylist() for x in ("befores", "nows", "counts")), strict=True):
            yield np.frombuffer(b, np.uint64), np.frombuffer(n, np.uint64), np.frombuffer(c, np.int64)


def _payloads(made: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([p for p, _ in made], pa.int32()), "payload": pa.array([x for _, x in made], pa.binary())})


def _at(names: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each asked name in sorted names, -1 if it is not there."""
    if not len(names):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    return np.where(names[at] == asked, at, -1)


def _with_arcs(vocabulary: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """vocabulary, and the discounted counts (kept) of all arcs from each word and (start) from the start of a text."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, _, counts in _each_pair(batches):
            names, back = np.unique(before, return_inverse=True)
            kept = np.bincount(back, counts - DISCOUNT, len(names))
            order = np.argsort(mixed := _text.mix(names), kind="stable")
            yield from _in_batches((p, _packed.pack(names[order[r]], kept[order[r]])) for p, r in _packed.runs(mixed[order], parts))

    def run(key: tuple, counted: pa.Table, sent: pa.Table) -> pa.Table:
        names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if counted.num_rows:
            names, counts = np.frombuffer(counted.column("names")[0].as_py(), np.uint64), np.frombuffer(counted.column("counts")[0].as_py(), np.int64)
        kept = np.zeros(len(names) + 1)
        start = 0.0
        for who, much in _packed.unpack_all(sent.column("payload").to_pylist(), (np.uint64, np.float64)):
            np.add.at(kept, _at(names, who), much)
            start += float(much[who == START_NAME].sum())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "names": [names.tobytes()], "counts": [counts.tobytes()], "kept": [kept[:-1].tobytes()], "start": pa.array([start], pa.float64())})

    sent = pairs.mapInArrow(sums, "part int, payload binary")
    return vocabulary.select("part", "names", "counts").groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(run, "part int, names binary, counts binary, kept binary, start double")


_STEPS = (np.uint64, np.uint64, np.uint64, np.float64) + (np.uint64, np.uint64, np.float64) + (np.uint64, np.float64)


def _gains(pairs: DataFrame, words: DataFrame, sent, parts: int) -> DataFrame:
    """part, names and gains (packed) of all bigrams that are no arc of the automaton.

    A gain is log10 of a bigram's probability over that by the failure arc and the root. What it takes from a word that
    is no state comes from the part of that word, first of the two words and then of the second.
    """

    def route(opened, half, done) -> list[tuple[int, bytes]]:
        """Bigrams that wait for the first word (first, second, name, discounted count), for the second (second, name, ratio), and finished ones (name, gain)."""
        model, left = sent.value
        n = len(model.names)
        state = _at(model.names, opened[0])
        from_ = np.where(opened[0] == START_NAME, n, state)
        known = from_ >= 0
        half = [np.concatenate([a, b]) for a, b in zip(half, (opened[1][known], opened[2][known], opened[3][known] / left[from_[known]]), strict=True)]
        opened = [x[~known] for x in opened]
        to = np.where(half[0] == END_NAME, n, _at(model.names, half[0]))
        known = to >= 0
        done = [np.concatenate([a, b]) for a, b in zip(done, (half[1][known], np.log10(1 + half[2][known] / 10 ** model.root[to[known]])), strict=True)]
        half = [x[~known] for x in half]
        sections = []
        for key, columns in ((_text.mix(opened[0]), opened), (_text.mix(half[0]), half), (_text.mix(done[0]), done)):
            order = np.argsort(key, kind="stable")
            sections.append((dict(_packed.runs(key[order], parts)), [c[order] for c in columns]))
        none = slice(0, 0)
        return [(p, _packed.pack(*(c[runs.get(p, none)] for runs, columns in sections for c in columns))) for p in sorted(set().union(*(runs for runs, _ in sections)))]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = sent.value
        empty = [np.zeros(0, k) for k in _STEPS]
        for before, now, counts in _each_pair(batches):
            from_ = np.where(before == START_NAME, len(model.names), _at(model.names, before))
            to = np.where(now == END_NAME, len(model.names), _at(model.names, now))
            rest = (from_ < 0) | (to < 0) | (_at(model.arcs, from_ << 21 | to) < 0)
            before, now = before[rest], now[rest]
            yield from _in_batches(route([before, now, _pair(before, now), counts[rest] - DISCOUNT], empty[4:7], empty[7:]))

    def resolve(counted: pa.Table, waiting: pa.Table) -> pa.Table:
        model, _ = sent.value
        names, counts, kept = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        if counted.num_rows:
            names, counts, kept = (np.frombuffer(counted.column(c)[0].as_py(), k) for c, k in (("names", np.uint64), ("counts", np.int64), ("kept", np.float64)))
        pieces = _packed.unpack_all(waiting.column("payload").to_pylist(), _STEPS)
        if not pieces:
            return _payloads([])
        first, second, name, much, now, key, ratio, found, gain = (np.concatenate(x) for x in zip(*pieces, strict=True))
        found, gain = np.append(found, key), np.append(gain, np.log10(1 + ratio / 10 ** model.unigram(counts[_at(names, now)].astype(np.float64))) if len(now) else gain[:0])
        ratio = much / (counts - kept)[_at(names, first)] if len(first) else much
        return _payloads(route([x[:0] for x in (first, second, name, much)], [second, name, ratio], [found, gain]))

    def merge(t: pa.Table) -> pa.Table:
        pieces = _packed.unpack_all(t.column("payload").to_pylist(), _STEPS)
        names, gains = np.concatenate([p[7] for p in pieces]), np.concatenate([p[8] for p in pieces])
        order = np.argsort(names, kind="stable")
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "pairs": [names[order].tobytes()], "gains": [gains[order].tobytes()]})

    words = words.select("part", "names", "counts", "kept")
    moved = pairs.mapInArrow(begin, "part int, payload binary")
    for _ in range(2):
        moved = words.groupBy("part").cogroup(moved.groupBy("part")).applyInArrow(resolve, "part int, payload binary")
    return moved.groupBy("part").applyInArrow(merge, "part int, pairs binary, gains binary")


def learn(training: DataFrame, parts: int, bits: int) -> tuple[Automaton, DataFrame, DataFrame | None, object]:
    """The automaton of training (column text), all words, the gains of bigrams beyond it if there are any, and the sketch (sent)."""
    ship(training.sparkSession)
    context = training.sparkSession.sparkContext
    texts = training.count()
    vocabulary = cut(_counted(training, lambda found, names: names, parts, 1), "vocabulary")
    names, counts = _largest(vocabulary.select("names", "counts"), HEAD, _names_and_counts)
    total, kinds = (int(x or 0) for x in vocabulary.agg(F.sum("total"), F.sum("kinds")).first())
    empty = np.zeros(0)
    model = Automaton(names, empty, empty, empty, empty, total + texts, kinds + (texts > 0))

    def seen(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, found, words in _words(batch):
            yield _pair(*_named(words, found.first))

    bitmaps = context.broadcast(_sketch.repeated(training, seen, bits, DEPTH))
    head = context.broadcast(names)
    pairs = cut(_counted_pairs(training, bitmaps, head, bits, parts), "bigrams")
    words = cut(_with_arcs(vocabulary, pairs, parts), "words")

    def of_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, much, start in zip(*(batch.column(c).to_pylist() for c in ("names", "kept", "start")), strict=True):
                who, much = np.frombuffer(who, np.uint64), np.frombuffer(much, np.float64)
                at = _at(head.value, who)
                yield pa.RecordBatch.from_arrays([pa.array([at[at >= 0].astype(np.int32).tobytes()]), pa.array([much[at >= 0].tobytes()]), pa.array([start], pa.float64())], names=["at", "kept", "start"])

    def between_states(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(head.value)
        for before, now, often in _each_pair(batches):
            from_ = np.where(before == START_NAME, n, _at(head.value, before))
            to = np.where(now == END_NAME, n, _at(head.value, now))
            both = (from_ >= 0) & (to >= 0)
            yield (from_ << 21 | to)[both].astype(np.uint64), often[both]

    kept = np.zeros(len(names) + 1)
    for r in words.select("names", "kept", "start").mapInArrow(of_states, "at binary, kept binary, start double").collect():
        kept[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["kept"], np.float64)
        kept[-1] += r["start"]
    arcs, often = _largest(pairs, ARCS, between_states)
    arcs = arcs.astype(np.int64)
    from_, to = arcs >> 21, arcs & ((1 << 21) - 1)
    state_count = np.append(counts, texts).astype(np.float64)
    left = state_count - kept
    share = np.where(state_count > 0, left / np.maximum(state_count, 1), 1.0)
    root = model.unigram(state_count)
    weight = np.log10((often - DISCOUNT) / state_count[from_] + share[from_] * 10 ** root[to]) if len(arcs) else empty
    model = model._replace(root=root, failure=np.log10(share), arcs=arcs, weight=weight)
    beyond = int(pairs.agg(F.sum("kinds")).first()[0] or 0) - len(arcs)
    sent = context.broadcast((model, left))
    gains = cut(_gains(pairs, words, sent, parts), "gains") if beyond else None
    for b in (head, sent):
        b.unpersist()
    return model, words, gains, bitmaps


def fit(training: DataFrame, parts: int, bits: int = LEAST_BITS) -> tuple[Automaton, DataFrame]:
    """The automaton of training (column text), and the counts of all words."""
    return learn(training, parts, bits)[:2]


#: What a stretch keeps: entries per name, documents and times of words, then of bigrams; ids, flags, tokens, known, base and score of its rows.
_HELD = (np.uint32, np.uint16, np.uint32) * 2 + (np.int64, np.uint8, np.int64, np.int64, np.float64, np.float64)
_ASKED, _TOLD = (np.uint64, np.uint64), (np.int64, np.float64, np.float64)
_NO_ID, _HELD_OUT = 1, 2


class _Stretch:
    """Scores so far of some rows, and the words and bigrams that are still to be looked up."""

    def __init__(self) -> None:
        self.names, self.docs, self.pairs, self.pair_docs, self.done, self.count, self.bytes = [], [], [], [], [], 0, 0

    def rows(self, parts: int, home: int) -> Iterator[tuple[int, bool, bytes]]:
        """part, whether it is a question, and payload: what is asked of each part, every name once, and what the stretch keeps until it is told.

        What is kept passes through a part that only the stretch's own number (home) chooses, so that neither null nor evenly spaced ids gather in one.
        """
        asked, held = [], []
        for names, docs in ((self.names, self.docs), (self.pairs, self.pair_docs)):
            names, docs = np.concatenate(names), np.concatenate(docs)
            mixed = _text.mix(names)
            order = np.lexsort((docs, mixed))  # parts rise with the mixed name
            names, docs, mixed = names[order], docs[order], mixed[order]
            new = np.append(True, mixed[1:] != mixed[:-1])[: len(mixed)]
            first = np.flatnonzero(new | np.append(True, docs[1:] != docs[:-1])[: len(docs)])
            times = np.diff(np.append(first, len(docs))).astype(np.uint32)
            names, docs, new = names[first], docs[first], np.flatnonzero(new[first])
            held += [np.diff(np.append(new, len(docs))).astype(np.uint32), docs.astype(np.uint16), times]
            asked.append((names[new], dict(_packed.runs(mixed[first][new], parts))))
        (words, in_words), (pairs, in_pairs) = asked
        none = slice(0, 0)
        for p in sorted(in_words.keys() | in_pairs.keys()):
            yield p, True, _packed.pack(words[in_words.get(p, none)], pairs[in_pairs.get(p, none)])
        done = [np.concatenate(x) for x in zip(*self.done, strict=True)]
        yield int(_text.mix(np.array([home + 1], np.uint64))[0]) % parts, False, _packed.pack(*held, *done)


def _look_up(counted: pa.Table, wanted: pa.Table) -> pa.Table:
    """Answers to all questions of a part: counts and failure weights of words, and gains of bigrams; what stretches keep passes through (part -1)."""
    columns = [np.frombuffer(b"".join(x or b"" for x in counted.column(c).to_pylist()), k) for c, k in (("names", np.uint64), ("counts", np.int64), ("kept", np.float64), ("pairs", np.uint64), ("gains", np.float64))]
    # the last of each stands for what is not there
    names, pairs = columns[0], columns[3]
    counts, kept, gains = (np.append(c, 0) for c in (columns[1], columns[2], columns[4]))
    failure = np.log10(np.where(counts > 0, (counts - kept) / np.maximum(counts, 1), 1.0))
    part, out = [], []
    for p, question, payload in zip(*(wanted.column(c).to_pylist() for c in ("part", "question", "payload")), strict=True):
        if question:
            asked, asked_pairs = _packed.unpack(payload, _ASKED)
            at = _at(names, asked)
            payload = _packed.pack(counts[at], failure[at], gains[_at(pairs, asked_pairs)])
        part.append(p if question else -1)
        out.append(payload)
    return pa.table({"home": wanted.column("home"), "part": pa.array(part, pa.int32()), "payload": pa.array(out, pa.binary())})


def _finish(model_scale: tuple[int, int]):
    tokens, kinds = model_scale
    unigram = Automaton(*[np.zeros(0)] * 5, tokens, kinds).unigram

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("part").to_pylist(), t.column("payload").to_pylist(), strict=True), key=lambda r: r[0])
        times, docs, often, pair_times, pair_docs, pair_often, ids, flags, n_tokens, known, base, score = _packed.unpack(rows[0][1], _HELD)
        told = [_packed.unpack(payload, _TOLD) for _, payload in rows[1:]]
        counts, failure, gains = (np.concatenate([x[i] for x in told]) if told else np.zeros(0, k) for i, k in enumerate(_TOLD))
        n, each = len(ids), np.repeat(np.arange(len(times)), times)
        more = np.bincount(docs, unigram(counts.astype(np.float64))[each] * often, n)
        less = np.bincount(docs, failure[each] * often, n) + np.bincount(pair_docs, gains[np.repeat(np.arange(len(pair_times)), pair_times)] * pair_often, n)
        there = np.bincount(docs, (counts > 0)[each] * often.astype(np.int64), n).astype(np.int64)
        columns = {
            "doc_id": pa.array(ids, pa.int64(), mask=(flags & _NO_ID) > 0),
            "held_out": pa.array((flags & _HELD_OUT) > 0),
            "n_tokens": pa.array(n_tokens),
            "n_known": pa.array(known + there),
            "train_tokens": pa.array(np.full(n, tokens, np.int64)),
            "base_score": pa.array(base + more),
            "score": pa.array(score + more + less),
        }
        return pa.table(columns)

    return run


_ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Learns from the rows for which held_out is false or null. Words have A-Z in lower case; every text ends with one end
    token, so null and empty texts have one token. Scores are log10 probabilities: base_score by the add-half unigram
    distribution alone, score by the automaton. n_known counts tokens seen in training. Repeated rows and rows of one doc_id are scored
    each; a null doc_id stays null. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    flags = F.when(F.col(doc_id).isNull(), _NO_ID).otherwise(0) + F.when(held, _HELD_OUT).otherwise(0)
    read = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"), flags.cast("byte").alias("flags"), F.col(text).alias("text"), held.alias("held"))
    words = int(read.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    parts = max(1, -(-3 * words // GROUP_WORDS))  # a token is looked up as a word, as what comes before, and in a bigram
    bits = min(MOST_BITS, max(LEAST_BITS, words.bit_length()))
    model, vocabulary, gains, bitmaps = learn(read.where(~F.col("held")).select("text"), parts, bits)
    beyond = gains is not None
    forget(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, home = _Stretch(), TaskContext.get().partitionId() << 32

        def rows() -> Iterator[pa.RecordBatch]:
            for made in _some(stretch.rows(parts, home), lambda r: len(r[2])):
                part, question, payload = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([home] * len(part), pa.int64()), pa.array(question), pa.array(payload, pa.binary())], names=["part", "home", "question", "payload"])

        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "flags"))
            for chunk, found, names in _words(batch):
                automaton = sent.value
                states = automaton.states(names)
                base, total, arc = traverse(automaton, states, found.first)
                rest = np.flatnonzero(states < 0)
                stretch.names.append(names[rest])
                stretch.docs.append((found.rows[rest] + stretch.count).astype(np.uint32))
                pairs, look = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if beyond:
                    pairs = _pair(*_named(names, found.first))
                    look = np.flatnonzero(~arc & _sketch.maybe(bitmaps.value, pairs, bits))
                    pairs = pairs[look]
                stretch.pairs.append(pairs)
                stretch.pair_docs.append((np.repeat(np.arange(len(found.counts)), found.counts + 1)[look] + stretch.count).astype(np.uint32))
                seen = _text.per_row(states >= 0, found.first) + (automaton.tokens > 0)
                own = slice(chunk.low, chunk.high)
                stretch.done.append((ids[own], marks[own].astype(np.uint8), found.counts + 1, seen, base, total))
                stretch.count += chunk.high - chunk.low
                stretch.bytes += len(chunk.data)
                if stretch.bytes >= STRETCH_BYTES or stretch.count >= STRETCH_TEXTS:
                    yield from rows()
                    stretch, home = _Stretch(), home + 1
        if stretch.count:
            yield from rows()

    wanted = read.select("id", "flags", "text").mapInArrow(run, "part int, home long, question boolean, payload binary")
    none = F.lit(None).cast("binary")
    known = vocabulary.select("part", "names", "counts", "kept", none.alias("pairs"), none.alias("gains"))
    if beyond:
        known = known.union(gains.select("part", none, none, none, "pairs", "gains"))
    told = known.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(_look_up, "home long, part int, payload binary")
    return told.groupBy("home").applyInArrow(_finish((model.tokens, model.kinds)), _ROW)
