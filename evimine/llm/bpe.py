"""Byte-level BPE encoding and decoding with a given rank file.

Method: a segment tree over byte positions holds the rank of the pair that starts at each live position; its root is the
leftmost minimum. A merge changes three leaves (the merged position, the live neighbour before it, the position that
went), each a logarithmic point update. Short pieces that a batch has not met before are merged together, one merge of
each per step, over trees stored as rows of one matrix; long pieces go through a tree of their own.

Encoding and decoding run per partition with no shuffle. Texts are read whole. The memory of pieces already encoded is
bounded and emptied when full, so it cannot grow with the data. The rank file is read where the job is planned and sent with it.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimine.llm._spark import ship

#: Unicode White_Space, which is what \s of the pattern means.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the split pattern of which every match lies inside one match of _COARSE. Texts are split by any other alone.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_COARSE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same inside and outside of a set of the pattern.
_SPACE_ESCAPE = r"\p{White_Space}"
_NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this are merged alone.
LONG_PIECE = 256
#: Encoded pieces remembered by a worker (about 50 MB), and the longest of them in characters.
REMEMBERED, REMEMBERED_LENGTH = 200_000, 64
#: Pieces merged together; characters of text split at once; bytes of text in one batch of results.
ROWS, SPLIT, BATCH = 1 << 12, 1 << 20, 4 << 20


class Vocabulary:
    """Ranks of a tiktoken-style file, and which pairs of tokens merge into which."""

    def __init__(self, lines: Iterable[bytes], pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks, self.pattern = ranks, regex.compile(pattern.replace(r"\s", _SPACE_ESCAPE))
        self.coarse = _COARSE if pattern == _SPLIT else None
        self.bytes = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._place_pairs()

    @cached_property
    def pairs(self) -> dict[int, int]:
        """What each pair of tokens (left << 32 | right) merges into."""
        ranks, pairs = self.ranks, {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        return pairs

    def _place_pairs(self) -> None:
        """Open addressing: at most a few probes instead of a binary search."""
        pairs = self.pairs
        self._keys = np.array(sorted(pairs), np.int64)
        self._merged = np.array([pairs[k] for k in self._keys.tolist()], np.int32)
        self._bits = max(4, int(len(pairs) * 4 - 1).bit_length())
        self._slots, self._values = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, _NONE, np.int32)
        todo = np.arange(len(self._keys))
        place = self._slot(self._keys)
        while len(todo):
            free = self._slots[place] < 0
            self._slots[place[free]] = self._keys[todo[free]]
            won = self._slots[place] == self._keys[todo]
            self._values[place[won]] = self._merged[todo[won]]
            todo, place = todo[~won], (place[~won] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of tokens merges into, _NONE where there is none."""
        keys = left.astype(np.int64) << 32 | right
        place = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self._slots[place]
            hit = there == keys[todo]
            out[todo[hit]] = self._values[place[hit]]
            more = ~hit & (there >= 0)
            todo, place = todo[more], (place[more] + 1) & ((1 << self._bits) - 1)
        return out


#: Bytes of a long piece whose first pairs are looked up at once.
LOOK_UP = 1 << 20


def merge_long(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one piece of any length."""
    return merged_array(piece, vocabulary).tolist()


def merged_array(piece: bytes, vocabulary: Vocabulary) -> array:
    """One piece of any length through its own segment tree, in arrays of four bytes an entry: 20 to 28 bytes for each byte of the piece."""
    pairs, none = vocabulary.pairs, int(_NONE)
    first = vocabulary.of_byte[np.frombuffer(piece, np.uint8)].astype(np.int32)
    n = len(first)
    size = 1 << max(0, (n - 1).bit_length())
    levels = np.full(2 * size, _NONE, np.int32)
    for low in range(0, n - 1, LOOK_UP):
        high = min(low + LOOK_UP, n - 1)
        levels[size + low : size + high] = vocabulary.pair_ranks(first[low:high], first[low + 1 : high + 1])
    low = size
    while low > 1:
        levels[low // 2 : low] = np.minimum(levels[low : 2 * low : 2], levels[low + 1 : 2 * low : 2])
        low //= 2
    tree, tokens, after, before = array("i"), array("i"), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    tree.frombytes(levels.view(np.uint8))
    tokens.frombytes(first.view(np.uint8))
    del levels, first

    def put(at: int, rank: int) -> None:
        node = at + size
        tree[node] = rank
        while node > 1:
            node //= 2
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    while (rank := tree[1]) != none:
        node = 1
        while node < size:
            node = 2 * node if tree[2 * node] == rank else 2 * node + 1
        at = node - size
        gone = after[at]
        tokens[at], tokens[gone], after[at] = rank, -1, after[gone]
        put(gone, none)
        if after[at] < n:
            before[after[at]] = at
            put(at, pairs.get(rank << 32 | tokens[after[at]], none))
        else:
            put(at, none)
        if before[at] >= 0:
            put(before[at], pairs.get(tokens[before[at]] << 32 | rank, none))
    return array("I", (t for t in tokens if t >= 0))


def merge_rows(pieces: list[bytes], size: int, vocabulary: Vocabulary) -> list[bytes]:
    """Packed ids of pieces of at most size bytes (a power of two); each row of the matrices is one piece and its tree."""
    count = len(pieces)
    length = np.array([len(p) for p in pieces], np.int64)
    flat = vocabulary.of_byte[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8)]
    tokens = np.full((count, size + 1), -1, np.int32)
    tokens[:, :size] = flat.reshape(count, size)
    tokens[:, :size][np.arange(size) >= length[:, None]] = -1
    after = np.tile(np.arange(1, size + 2, dtype=np.int32), (count, 1))
    before = np.tile(np.arange(-1, size, dtype=np.int32), (count, 1))
    tree = np.full((count, 2 * size), _NONE, np.int32)
    row, at = np.nonzero(np.arange(size) < length[:, None] - 1)
    tree[row, size + at] = vocabulary.pair_ranks(tokens[row, at], tokens[row, at + 1])
    levels = size.bit_length() - 1
    for level in range(levels - 1, -1, -1):
        low = 1 << level
        tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])

    def put(rows: np.ndarray, place: np.ndarray, rank: np.ndarray) -> None:
        node = place + size
        tree[rows, node] = rank
        for _ in range(levels):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        rank = tree[rows, 1]
        node = np.ones(len(rows), np.int64)
        for _ in range(levels):
            node *= 2
            node += tree[rows, node] != rank
        at = node - size
        gone = after[rows, at].astype(np.int64)
        follow = after[rows, gone].astype(np.int64)
        tokens[rows, at], tokens[rows, gone], after[rows, at] = rank, -1, follow
        put(rows, gone, _NONE)
        last = follow >= length[rows]
        new = np.full(len(rows), _NONE, np.int32)
        new[~last] = vocabulary.pair_ranks(rank[~last], tokens[rows[~last], follow[~last]])
        before[rows[~last], follow[~last]] = at[~last]
        put(rows, at, new)
        lead = before[rows, at].astype(np.int64)
        some = lead >= 0
        if some.any():
            put(rows[some], lead[some], vocabulary.pair_ranks(tokens[rows[some], lead[some]], rank[some]))
        rows = rows[tree[rows, 1] != _NONE]
    live = tokens >= 0
    ids, ends = tokens[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Encodes texts of a partition; remembers a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def _learn(self, coarse: set[str]) -> None:
        """Adds packed ids of coarse pieces to what is known."""
        known, ranks = self.known, self.vocabulary.ranks
        order = list(coarse)
        split = list(map(self.vocabulary.pattern.findall, order))
        parts: set[str] = set()
        for p in split:
            parts.update(p)
        ids: dict[str, bytes] = {}
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for part in parts:
            if (there := known.get(part)) is not None:
                ids[part] = there
                continue
            piece = part.encode()
            if (rank := ranks.get(piece)) is not None:
                ids[part] = rank.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                ids[part] = merged_array(piece, self.vocabulary).tobytes()
            else:
                names, pieces = by_size.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), ([], []))
                names.append(part)
                pieces.append(piece)
        for size, (names, pieces) in by_size.items():
            for low in range(0, len(pieces), ROWS):
                ids.update(zip(names[low : low + ROWS], merge_rows(pieces[low : low + ROWS], size, self.vocabulary), strict=True))
        for c, p in zip(order, split, strict=True):
            known[c] = ids[p[0]] if len(p) == 1 else b"".join(map(ids.__getitem__, p))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        split = (self.vocabulary.coarse or self.vocabulary.pattern).findall
        for low, high in _groups(texts, SPLIT):
            pieces = [split(t) for t in texts[low:high]]
            new: set[str] = set()
            for p in pieces:
                new.update(p)
            new -= self.known.keys()
            if len(self.known) + len(new) > REMEMBERED:
                self.known = {}
                new = {x for p in pieces for x in p}
            self._learn(new)
            out += [b"".join(map(self.known.__getitem__, p)) for p in pieces]
            for piece in new:
                if len(piece) > REMEMBERED_LENGTH:
                    del self.known[piece]
            if len(self.known) > REMEMBERED:
                self.known = {}
        return out


def _groups(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    low = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


_VOCABULARIES: dict[tuple[int, str], Vocabulary] = {}


def _sent(docs: DataFrame, path: str) -> Broadcast:
    """The rank file, read where the job is planned."""
    ship(docs.sparkSession)
    with open(path, "rb") as lines:
        return docs.sparkSession.sparkContext.broadcast(lines.read())


def _vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    """One per worker process."""
    key = (hash(lines), pattern)
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(lines.splitlines(), pattern)
    return _VOCABULARIES[key]


def _slices(batch: pa.RecordBatch, column: str, limit: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about limit bytes in a column."""
    size = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    low = 0
    while low < batch.num_rows:
        high = min(batch.num_rows, max(low + 1, int(np.searchsorted(size, size[low] + limit, "right")) - 1))
        yield batch.slice(low, high - low)
        low = high


def _encoded(batch: pa.RecordBatch, encoder: Encoder, text: str, ids: str, n_tokens: str) -> pa.RecordBatch:
    packed = encoder.encode([t or "" for t in batch.column(text).to_pylist()])
    columns = [*batch.columns, pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, ids, n_tokens])


def _decoded(batch: pa.RecordBatch, vocabulary: Vocabulary, ids: str, decoded: str) -> pa.RecordBatch:
    token = vocabulary.bytes.__getitem__
    out = [b"".join(map(token, np.frombuffer(p or b"", "<u4").tolist())) for p in batch.column(ids).to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, decoded])


def _counting_only(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """made with the cycle collector at rest: millions of short-lived lists and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield from made
    finally:
        if was:
            gc.enable()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """docs with the ids of every whole text, packed as little-endian unsigned 32-bit integers, and their number.

    path: the rank file, on the machine that plans the job. pattern: how texts are split, as the regex module reads it.
    Null and empty texts have no ids. Rows, repeated ones too, and all other columns stay as they are; columns that are
    already named ids or n_tokens are replaced. An empty table stays empty.
    """
    kept = docs.drop(ids, n_tokens)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())])
    sent = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            encoder = encoder or Encoder(_vocabulary(sent.value, pattern))
            for batch in _slices(whole, text):
                yield _encoded(batch, encoder, text, ids, n_tokens)

    return kept.mapInArrow(lambda batches: _counting_only(run(batches)), schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with the bytes that its packed ids stand for; null ids decode to no bytes. An unknown id is an error.

    Repeated rows are decoded each; an empty table stays empty; a column already named decoded is replaced.
    """
    kept = encoded.drop(decoded)
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.BinaryType())])
    sent = _sent(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, ids):
                yield _decoded(batch, _vocabulary(sent.value, pattern), ids, decoded)

    return kept.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document.

    The two operators above in one pass, so that a worker holds one vocabulary and ids need not go back and forth. Null
    texts count as empty; repeated rows are coded each; an empty table gives no rows.
    """
    sent = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            encoder = encoder or Encoder(_vocabulary(sent.value, pattern))
            for batch in _slices(whole, "text"):
                coded = _encoded(batch, encoder, "text", "ids", "n_tokens")
                yield _decoded(coded.select(["doc_id", "n_tokens", "ids"]), encoder.vocabulary, "ids", "decoded")

    narrow = docs.select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    coded = narrow.mapInArrow(lambda batches: _counting_only(run(batches)), schema)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
