"""Substring dedup: words in windows that a document with a smaller id also has.

Method: a count-min prefilter. One pass builds sketches of window counts per partition and merges them; a sketch never
underestimates, so a window whose cells were hit once occurs in one document only. The second pass groups exactly
the windows that the sketch calls repeated, by 80-bit names, and finds the smallest document of each.

Groups are formed where the text is read first: of a window that occurs in several documents of one stretch of text only
the smallest document's places are sent on, the others are settled there. So a window that a third of all documents
share costs one entry per stretch, not one per document. Entries travel packed, a few dozen bytes per window; the number
of groups of the exact pass follows the input, so that each holds a bounded number of entries.

The sketch's cells follow the input up to MOST_BITS; beyond that it lets more windows through, and the exact pass,
which loses none, takes more of the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimine.llm import _sketch, _text
from evimine.llm._spark import cut, ship

WIDTH = 13
#: Cells of a row of the sketch are 2**bits: at most 2**30 (a bitmap of 128 MB).
LEAST_BITS, MOST_BITS, DEPTH = 16, 30, 2
#: Text read before windows are grouped, windows meant for one task of the exact pass, and its least number of tasks.
STRETCH_BYTES, GROUP_WINDOWS, LEAST_GROUPS = 8 << 20, 4_000_000, 32
_KEY = "_text_hash"


def _distinct_names(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Window names of a chunk, each once per row."""
    for chunk in _text.chunks(column):
        found = _text.words(chunk)
        _, names, rows = _text.windows(_text.hashes(chunk, found, lower=False), found.first, width)
        if len(names):
            per_text = _text.mix(names + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield names[np.unique(per_text, return_index=True)[1]]


class _Stretch:
    """Windows of some documents that may be repeated."""

    def __init__(self) -> None:
        self.names, self.checks, self.places, self.docs = [], [], [], []
        self.ids, self.keys, self.count, self.bytes = [], [], 0, 0

    def add(self, names: np.ndarray, checks: np.ndarray, places: np.ndarray, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, size: int) -> None:
        self.names.append(names)
        self.checks.append(checks)
        self.places.append(places.astype(np.uint32))
        self.docs.append((rows + self.count).astype(np.uint32))
        self.ids.append(ids)
        self.keys.append(keys)
        self.count += len(ids)
        self.bytes += size

    def payloads(self, groups: int) -> Iterator[tuple[int, bytes]]:
        names, checks, places, docs = map(np.concatenate, (self.names, self.checks, self.places, self.docs))
        ids, keys = np.concatenate(self.ids), np.concatenate(self.keys)
        smallest, order = _smallest(names, checks, ids[docs])
        names, checks, places, docs = names[order], checks[order], places[order], docs[order]
        open_ = ids[docs] == smallest
        group = ((names >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)  # rises with the name
        edges = np.searchsorted(group, np.arange(groups + 1))
        for g in np.flatnonzero(np.diff(edges)):
            part = slice(edges[g], edges[g + 1])
            which = np.argsort(~open_[part], kind="stable") + edges[g]
            n_open = int(open_[part].sum())
            used, doc = np.unique(docs[which], return_inverse=True)
            yield int(g), _join(names[which[:n_open]], checks[which[:n_open]], places[which], doc.astype(np.uint32), ids[used], keys[used])


def _smallest(names: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by window and id, and in that order the smallest id of each entry's window."""
    order = np.lexsort((ids, checks, names))
    n, c, i = names[order], checks[order], ids[order]
    new = np.ones(len(n), bool)
    new[1:] = (n[1:] != n[:-1]) | (c[1:] != c[:-1])
    return i[np.flatnonzero(new)[np.cumsum(new) - 1]], order


def _join(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _split(payload: bytes) -> list[np.ndarray]:
    kinds = (np.uint64, np.uint16, np.uint32, np.uint32, np.int64, np.int64)
    sizes, at, out = np.frombuffer(payload, np.int64, len(kinds)).tolist(), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(payload, kind, size, at))
        at += out[-1].nbytes
    return out


def _settle(t: pa.Table) -> pa.Table:
    """Places to remove, per document, from all entries of one group of windows."""
    parts = [_split(p) for p in t.column("payload").to_pylist()]
    names, checks = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    ids = np.concatenate([p[4][p[3]] for p in parts])
    keys = np.concatenate([p[5][p[3]] for p in parts])
    places = np.concatenate([p[2] for p in parts])
    is_open = np.concatenate([np.arange(len(p[2])) < len(p[0]) for p in parts])
    at = np.flatnonzero(is_open)
    smallest, order = _smallest(names, checks, ids[at])
    gone = ~is_open
    gone[at[order]] = ids[at[order]] > smallest
    ids, keys, places = ids[gone], keys[gone], places[gone]
    order = np.lexsort((keys, ids))
    ids, keys, places = ids[order], keys[order], places[order]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    starts = np.flatnonzero(first)
    offsets = np.append(starts, len(ids)).astype(np.int64) * 4
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(places.astype("<u4").tobytes())]).cast(pa.binary())
    return pa.table({"doc_id": pa.array(ids[starts]), _KEY: pa.array(keys[starts]), "places": packed})


def _estimated_windows(docs: DataFrame, text: str) -> int:
    """From the bytes of all texts."""
    return int((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 6)


def repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """doc_id, a hash of the text and packed places (unsigned 32-bit) of windows that also start in a smaller doc_id.

    A document may have several rows. Rows with a null doc_id take no part.
    """
    ship(docs.sparkSession)
    read = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias(_KEY))
    estimate = _estimated_windows(read, "text")
    bits = min(MOST_BITS, max(LEAST_BITS, (int(estimate * 1.5) or 1).bit_length()))
    groups = max(LEAST_GROUPS, -(-estimate // GROUP_WINDOWS))
    sketch = _sketch.repeated(read.select("text"), lambda batch: _distinct_names(batch.column("text"), width), bits, DEPTH)
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = _Stretch()

        def rows() -> pa.RecordBatch:
            made = list(stretch.payloads(groups))
            return pa.RecordBatch.from_arrays([pa.array([g for g, _ in made], pa.int32()), pa.array([p for _, p in made], pa.binary())], names=["g", "payload"])

        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column(_KEY).to_numpy(zero_copy_only=False)
            for chunk in _text.chunks(batch.column("text")):
                found = _text.words(chunk)
                names = _text.hashes(chunk, found, lower=False)
                starts, windows, in_row = _text.windows(names, found.first, width)
                keep = _sketch.maybe(sent.value, windows, bits)
                if keep.any():
                    starts, windows, in_row = starts[keep], windows[keep], in_row[keep]
                    checks = (_text.combine(names, width, salt=1)[starts] >> np.uint64(48)).astype(np.uint16)
                    stretch.add(windows, checks, starts - found.first[in_row], in_row, ids[chunk.low : chunk.high], keys[chunk.low : chunk.high], len(chunk.data))
                if stretch.bytes >= STRETCH_BYTES:
                    yield rows()
                    stretch = _Stretch()
        if stretch.count:
            yield rows()

    entries = read.mapInArrow(run, "g int, payload binary")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField(_KEY, T.LongType()), T.StructField("places", T.BinaryType())])
    return entries.groupBy("g").applyInArrow(_settle, schema)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, spaced: bool = False) -> DataFrame:
    """docs with n_words, n_removed and kept: its words that no repeated window covers, joined by one space.

    spaced: kept then leaves the text between kept words as it was (an untouched text stays equal to itself).
    Null and empty texts, and texts of fewer than width words, lose nothing; kept of a null text is empty (null if
    spaced). Rows with a null doc_id neither lose words nor make others lose them. Rows with one doc_id do not count
    against each other. All other columns stay, whatever their names; columns named n_words, n_removed or kept are replaced.
    """
    clean = docs.drop("n_words", "n_removed", "kept")
    # written, so that the entries are gone from disk before texts move
    found = cut(repeated_windows(docs, text, doc_id, width).groupBy("doc_id", _KEY).agg(F.collect_list("places").alias("_places")), "places")
    found = found.withColumnsRenamed({"doc_id": "_id", _KEY: "_k"})
    rows = clean.select(F.struct(*clean.columns).alias("row"), F.col(doc_id).cast("long").alias("own"), F.xxhash64(text).alias("own_text"))
    joined = rows.join(found, (F.col("own") == F.col("_id")) & (F.col("own_text") == F.col("_k")), "left").select("row", "_places")
    schema = T.StructType([joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column("row").field(text).cast(pa.binary()), batch.column("_places")
            out = [_cut(t.as_py(), p.as_py(), width, spaced) for t, p in zip(texts, places, strict=True)]
            n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, schema).select("row.*", "n_words", "n_removed", "kept")


def _cut(text: bytes | None, places: list[bytes] | None, width: int, spaced: bool) -> tuple[int, int, bytes | None]:
    """Number of words, of words removed, and what is kept."""
    words = (text or b"").split()
    if not places:
        return len(words), 0, text if spaced else b" ".join(words)
    starts = np.frombuffer(b"".join(places), "<u4").astype(np.int64)
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    keep = np.cumsum(change[:-1]) == 0
    gone = len(words) - int(keep.sum())
    if not spaced:
        return len(words), gone, b" ".join(compress(words, keep.tolist()))
    chunk = _text.Chunk(0, 1, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    found = _text.words(chunk)
    turns = np.flatnonzero(np.diff(keep, prepend=False, append=False))  # first word kept, first word not kept, ...
    parts = [text[found.starts[a] : found.ends[b - 1]] for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return len(words), gone, b"\n".join(parts)


def digest(docs: DataFrame) -> DataFrame:
    """Word counts and a digest of what is kept of every document."""
    done = dedup(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle(width: int = WIDTH) -> str:
    """What is left of `documents` in SQL."""
    last = width - 1
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - {last})) AS i FROM d),
k AS (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(list_slice(w, i, i + {last}), ' ')) AS first FROM p),
g AS (SELECT DISTINCT r, unnest(generate_series(i, i + {last})) AS place FROM k WHERE first < doc_id),
e AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS place FROM d),
h AS (SELECT r, string_agg(word, ' ' ORDER BY place) AS kept FROM e ANTI JOIN g USING (r, place) GROUP BY r),
m AS (SELECT r, count(*) AS n FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN m USING (r) LEFT JOIN h USING (r)"""
