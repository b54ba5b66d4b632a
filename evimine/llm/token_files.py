"""Token ids of a corpus as files: encoded, in order of doc_id, in coded blocks, and read back.

Method: adaptive context-mixing range coder (idcoder). Texts are encoded by the tokenizers library, written once as they are,
dealt out by range of doc_id so that every task has a stretch of the order, and each task packs its stretch into frames of whole
documents. Files are Parquet: a row is a frame, whose payload holds documents, block table and checksums, so that Spark's own
commits, splits and column pruning serve writers and readers, on any store. Rows of one doc_id are spread by their place in
the input, so that a range may begin and end within them.

Encoding repeats itself: a piece of text, a word or the signs after it, has the same ids wherever it stands, so the library encodes a piece
once, and a worker remembers it, with all its bytes, in a table of fixed size; a piece that is not there any more is encoded again. Texts are
cut only where the byte-level pattern's matches surely have a border: before a blank and on both sides of a line feed, where these
stand between two characters that surely are no white space, and between a letter or digit and a sign of ASCII.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evimine.llm import _text, idcoder
from evimine.llm._spark import cut, ship

#: Ids of a frame, unless one document has more, and bytes of text that are looked up at a time.
FRAME_IDS, SLICE_BYTES = 2 * idcoder.BLOCK, 1 << 21
#: Bytes of a piece that is remembered, pieces that are at most, and ids above which all are forgotten.
KEY_BYTES, SLOTS, HELD_IDS = 24, 1 << 21, 1 << 23

_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
_SIGN = np.array([0x20 < i < 0x7F for i in range(256)])
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # so many bytes of eight


def _safe(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a character that ends, or begins, at each byte surely is no white space: ASCII signs, and letters of two bytes."""
    sign = (data > 0x20) & (data < 0x7F)
    lead = (data >= 0xC3) & (data <= 0xDF)
    ends = sign.copy()
    ends[1:] |= lead[:-1]
    return ends, sign | lead


class Encoder:
    """Ids of texts as the tokenizers library gives them, without special tokens, whose strings are ordinary text.

    The vocabulary is one of byte-level BPE: the bytes of its tokens, one after the other, are the text. Pieces are looked up if the
    texts are cut by the byte-level pattern and by nothing else; the library encodes whole texts otherwise.
    """

    def __init__(self, config: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.encode_special_tokens = True
        spec, vocabulary = json.loads(config), self.tokenizer.get_vocab()
        cuts = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and not spec.get("truncation") and all(t["special"] for t in spec.get("added_tokens") or [])
        self.in_pieces = plain and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space", True)
        if max(vocabulary.values()) >= idcoder.IDS:
            raise ValueError(f"more than {idcoder.IDS} ids")
        self.bytes = np.zeros(idcoder.IDS, np.int64)  # a token's characters stand for one byte each
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self._forget()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers; null is the empty text."""
        if not self.in_pieces:
            return [ids.tobytes() for ids in self._ids([t or "" for t in texts.to_pylist()])]
        return [ids for chunk in _text.chunks(texts, SLICE_BYTES) for ids in self._encode(chunk)]

    def _forget(self) -> None:
        self.table = np.zeros((SLOTS, KEY_BYTES // 8 + 1), np.uint64)  # bytes of a piece; its size, ids, and their place in what is held
        self.held, self.used = np.zeros(0, np.uint16), 0

    @staticmethod
    def _names(keys: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        name = sizes.astype(np.uint64)
        for key in keys:
            name = (name ^ key) * np.uint64(0x9E3779B97F4A7C15)
            name ^= name >> np.uint64(29)
        return name

    @staticmethod
    def _pieces(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces start and stop, which begin with a blank and then a character, and which may stand after a line feed as well; both end in a character."""
        ends, begins = _safe(data)
        border = np.zeros(len(data) + 1, bool)
        border[edges] = True
        inside = np.zeros(len(data), bool)
        inside[1:-1] = ends[:-2] & begins[2:]
        inside &= ~(border[:-1] | border[1:])
        line = inside & (data == 0x0A)
        cut = border
        cut[:-1] |= line | inside & (data == 0x20)
        cut[1:] |= line
        cut[1:-1] |= _ALNUM[data[:-1]] & (_SIGN & ~_ALNUM)[data[1:]]
        starts = np.flatnonzero(cut[:-1])
        stops = np.append(starts[1:], len(data)).astype(np.int64)[: len(starts)]
        firm = ends[stops - 1]
        blank = (data[starts] == 0x20) & (stops - starts > 1) & firm
        blank[blank] = begins[starts[blank] + 1]
        return starts, stops, blank, firm & begins[starts]

    def _encode(self, chunk: _text.Chunk) -> list[bytes]:
        data, edges = chunk.data, chunk.offsets
        if not len(data):
            return [b""] * (len(edges) - 1)
        if self.used > HELD_IDS:
            self._forget()
        starts, stops, blank, lone = self._pieces(data, edges)
        first, many = self._looked_up(data, starts, stops - starts, blank, lone)
        place = np.append(0, np.cumsum(many))
        coded = self.held[np.repeat(first - place[:-1], many) + np.arange(place[-1])]
        row = place[np.searchsorted(starts, edges)]
        return [coded[a:b].tobytes() for a, b in zip(row[:-1], row[1:], strict=True)]

    def _looked_up(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, blank: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece where its ids begin in what is held, and how many they are."""
        padded = np.append(data, np.zeros(KEY_BYTES + 8, np.uint8))
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        keys = []
        for low in range(0, KEY_BYTES, 8):
            key, longer = np.zeros(len(starts), np.uint64), np.flatnonzero(sizes > low) if low else slice(None)
            key[longer] = eight[starts[longer] + low] & _FIRST[np.minimum(sizes[longer] - low, 8)]
            keys.append(key)
        names = self._names(keys, sizes)
        slots = (names & np.uint64(SLOTS - 1)).astype(np.int64)
        rows = self.table.take(slots, axis=0)
        about = rows[:, -1].astype(np.int64)
        known = about & 0xFF == sizes  # none is longer than a key, nor of no bytes
        for i, key in enumerate(keys):
            known &= rows[:, i] == key
        first, many = about >> 16, about >> 8 & 0xFF
        short = sizes <= KEY_BYTES
        new, long = np.flatnonzero(~known & short), np.flatnonzero(~short)
        order = new[np.argsort(names[new])]  # equal pieces side by side, unless others of their name lie between
        other = np.ones(len(order), bool)
        other[1:] = sizes[order[1:]] != sizes[order[:-1]]
        for key in keys:
            other[1:] |= key[order[1:]] != key[order[:-1]]
        shown = order[other]
        ids, first[shown], many[shown] = self._encoded(data, starts[shown], sizes[shown], blank[shown], lone[shown])
        first[order], many[order] = first[shown][np.cumsum(other) - 1], many[shown][np.cumsum(other) - 1]
        more, at, many[long] = self._encoded(data, starts[long], sizes[long], blank[long], lone[long])
        first[new] += self.used
        first[long] = at + self.used + len(ids)
        self.held = np.concatenate([self.held[: self.used], ids, more])  # what is long is not kept
        self.used += len(ids)
        about = sizes[shown] | many[shown] << 8 | first[shown] << 16
        self.table[slots[shown]] = np.stack([*(key[shown] for key in keys), about.astype(np.uint64)], axis=1)
        return first, many

    def _encoded(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, blank: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, and for each where its own begin there and how many they are."""
        first, many = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        together, others = np.flatnonzero(blank | lone), np.flatnonzero(~(blank | lone))
        ahead = lone[together].astype(np.int64)  # one line feed
        length = sizes[together] + ahead
        until = np.cumsum(length)
        text = data[np.repeat(starts[together] - ahead - (until - length), length) + np.arange(length.sum())]
        text[(until - length)[ahead > 0]] = 0x0A
        found = self._ids([text.tobytes().decode()])[0]
        reached = np.cumsum(self.bytes[found])
        first[together] = np.searchsorted(reached, until - sizes[together], "right")
        many[together] = np.searchsorted(reached, until, "right") - first[together]
        each = self._ids([data[a : a + n].tobytes().decode() for a, n in zip(starts[others], sizes[others], strict=True)])
        many[others] = [len(e) for e in each]
        first[others] = len(found) + np.cumsum(many[others]) - many[others]
        return np.concatenate([found, *each]), first, many


@lru_cache(maxsize=1)
def _encoder(config: str) -> Encoder:
    return Encoder(config)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES of text."""
    size = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    low = 0
    while low < batch.num_rows:
        high = min(batch.num_rows, max(low + 1, int(np.searchsorted(size, size[low] + SLICE_BYTES, "right")) - 1))
        yield batch.slice(low, high - low)
        low = high


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 16-bit integers) of every whole text of docs, end_id last.

    tokenizer: the file, on the machine that plans the job. Null and empty texts have the end id only. Repeated rows and rows without
    doc_id are encoded each; other columns are not read; an empty table stays empty.
    """
    ship(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                ids = [i + end for i in _encoder(config.value).encode(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) // 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def write(encoded: DataFrame, path: str) -> None:
    """Write documents (doc_id, n_tokens, ids as encode gives them) to files in ascending order of doc_id, null first.

    Rows of one doc_id are neighbours, in any order. Documents are never divided between frames. A document may have no ids.
    """
    kept = cut(encoded.select("doc_id", "n_tokens", "ids", F.monotonically_increasing_id().alias("seq")), "ids")
    total = kept.agg(F.sum("n_tokens")).first()[0] or 0

    def frame(part: int, number: int, first: int, rows: list[tuple]) -> pa.RecordBatch:
        doc_ids, seqs, ids = zip(*rows, strict=True)
        arrays = [np.frombuffer(i or b"", "<u2") for i in ids]
        lengths = np.array([len(a) for a in arrays], np.int64)
        data = idcoder.pack(np.array([d or 0 for d in doc_ids], np.int64), lengths, np.concatenate(arrays))
        without = sum(d is None for d in doc_ids)
        columns = ([part], [number], [first], [int(lengths.sum())], [without], [doc_ids[0]], [seqs[0]], [data])
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "frame", "first", "n_ids", "n_null", "doc_id", "seq", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first, rows, held = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in batches:
            for row, n in zip(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "seq", "ids")), strict=True), batch.column("n_tokens").to_pylist(), strict=True):
                if rows and held + n > FRAME_IDS:
                    yield frame(part, number, first, rows)
                    number, first, rows, held = number + 1, first + held, [], 0
                rows.append(row)
                held += n
        if rows:
            yield frame(part, number, first, rows)

    order = ["doc_id", "seq"]
    sorted_ = kept.repartitionByRange(max(1, -(-total // FRAME_IDS)), *order).sortWithinPartitions(*order)
    frames = sorted_.select("doc_id", "seq", "n_tokens", "ids").mapInArrow(run, "part int, frame int, first long, n_ids long, n_null long, doc_id long, seq long, data binary")
    frames.write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, at, doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every document in the files.

    at: ids of the part before the document; placed() makes it their number in all files. Raises idcoder.BrokenBlock if a block does not
    match its checksum. Files without frames give no rows.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, without, data in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "n_null", "data")), strict=True):
                doc_ids, lengths, ids = idcoder.unpack(data)
                ends, raw = np.cumsum(lengths), ids.astype("<u4")
                null = np.arange(len(doc_ids)) < without
                for low in range(0, len(doc_ids), 1000):
                    rows = slice(low, low + 1000)
                    each = [raw[e - n : e].tobytes() for e, n in zip(ends[rows], lengths[rows], strict=True)]
                    columns = [pa.array(np.full(len(each), part, np.int32)), pa.array(first + ends[rows] - lengths[rows]), pa.array(doc_ids[rows], mask=null[rows]), pa.array(lengths[rows]), pa.array(each, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "doc_id", "n_tokens", "ids"])

    frames = spark.read.parquet(path).select("part", "first", "n_null", "data")
    return frames.mapInArrow(run, "part int, at long, doc_id long, n_tokens long, ids binary")


def placed(documents: DataFrame, path: str) -> DataFrame:
    """documents (part, at, and anything else, small) with start, the ids of all documents before, instead of part and at.

    Parts are put in order by the key of their first document. There is a part per FRAME_IDS ids; their sizes go through one task.
    """
    parts = documents.sparkSession.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n"), F.min(F.struct("doc_id", "seq")).alias("key"))
    before = W.orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    rest = [c for c in documents.columns if c not in ("part", "at")]
    return documents.join(base, "part").select((F.col("_base") + F.col("at")).alias("start"), *rest)
