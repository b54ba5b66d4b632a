"""N-gram Jaccard join of documents, and the classes that its links form.

Method: grouped prefix join. A document's set holds its distinct 5-word shingles (64-bit names). Shingles are put in one
global order, rarest first by a merged count sketch; two sets can reach the threshold only if they share a shingle
of their prefixes, the first n - ceil(0.75 n) + 1. Documents of equal prefix and size form one group and are posted
once; lists of groups that share a prefix shingle give group pairs, which size and position filters thin out; group
pairs are expanded to their members' distinct sets and verified by exact intersection.

No list or group is paired out in full. A long list (a shingle that thousands of near copies share) first yields a
number of pairs in proportion to its length: each against a few of its size band. Links found so are contracted to
components; pairs of sets already connected need no look, so only components that meet in a list are left. One link is all
that two of them can add: the sets of the smaller visit blocks of the larger, and a block answers each with its first
link, from exact intersections with all its sets at once. No link that could join two components is lost, and no pair of
sets is a row.

Sets are named by 64 bits and told apart by 64 more: should two have one name, all are named anew under another salt.

Postings travel packed and meet in groups of shingles whose number follows the input; copies are dropped where the text is
read, so a group of copies is posted once per stretch of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evimine.llm import _sketch, _text
from evimine.llm._spark import cut, ship
from evimine.llm.components import components

WIDTH = 5
#: Similarity of at least NUMERATOR / 100.
NUMERATOR = 75
#: Cells of the count sketch that orders shingles (a 16 MB table).
ORDER_BITS = 22
#: Lists up to this long are paired out at once.
SHORT = 16
#: In a longer list, each entry is paired with so many of its size band and of the band below.
LEADERS = 3
#: Stands for more shared shingles than any filter asks for.
ALWAYS = 1 << 40
#: Documents to look at again are marked in a table of this size (2 MB), so that their texts are found by a scan.
SLOTS = 1 << 21
STRETCH_BYTES, STRETCH_ROWS, GROUP_POSTINGS = 8 << 20, 30_000, 2_000_000
#: Shingles of a component's block, and of the sets that visit a block at once.
BLOCK, VISIT = 1 << 17, 1 << 20
#: Salt of the second fingerprint, which tells sets apart that have one fingerprint by chance.
CHECK = 1 << 32


def shingle_sets(chunk: _text.Chunk, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted set of shingle names of each row."""
    found = _text.words(chunk)
    names = _text.hashes(chunk, found, lower=True)
    _, shingles, rows = _text.windows(names, found.first, width)
    edges = np.searchsorted(rows, np.arange(len(found.first)))
    out = []
    for row, count in enumerate(found.counts.tolist()):
        if count >= width:
            out.append(np.unique(shingles[edges[row] : edges[row + 1]]))
        elif count:
            out.append(_text.combine(names[found.first[row] : found.first[row + 1]], count))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _fingerprint(shingles: np.ndarray, salt: int) -> int:
    total = np.array([_text.mix(shingles + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)
    return int(_text.mix(total).view(np.int64)[0])


def prefix(shingles: np.ndarray, order: np.ndarray, bits: int) -> np.ndarray:
    """The first n - ceil(0.75 n) + 1 shingles, rarest first, ties by name."""
    n = len(shingles)
    rank = order[_sketch.cells_of(shingles, bits, 0)]
    return shingles[np.argsort(rank, kind="stable")[: n - (NUMERATOR * n + 99) // 100 + 1]]


def _group(first: np.ndarray, n: int) -> int:
    """Name of the group of documents with this prefix and size."""
    names = _text.mix(first + np.arange(1, len(first) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(_text.mix(np.array([names.sum(dtype=np.uint64) ^ np.uint64(n)], np.uint64)).view(np.int64)[0])


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection with which sets of these sizes link: 100 i >= 75 (a + b - i)."""
    return -(-NUMERATOR * (a + b) // (100 + NUMERATOR))


class _Postings:
    """Prefix shingles of one stretch of text, each group once."""

    def __init__(self) -> None:
        self.seen: set[int] = set()
        self.tokens, self.places, self.groups, self.sizes = [], [], [], []
        self.bytes = 0

    def add(self, shingles: np.ndarray, order: np.ndarray, bits: int) -> None:
        first = prefix(shingles, order, bits)
        group = _group(first, len(shingles))
        if group not in self.seen:
            self.seen.add(group)
            self.tokens.append(first)
            self.places.append(np.minimum(np.arange(len(first)), 65535).astype(np.uint16))
            self.groups.append(group)
            self.sizes.append(len(shingles))

    def payloads(self, parts: int) -> Iterator[tuple[int, bytes]]:
        if not self.tokens:
            return
        docs = np.repeat(np.arange(len(self.tokens), dtype=np.uint16), [len(t) for t in self.tokens])
        tokens, places = np.concatenate(self.tokens), np.concatenate(self.places)
        groups, sizes = np.array(self.groups, np.int64), np.array(self.sizes, np.int32)
        order = np.argsort(tokens)
        tokens, places, docs = tokens[order], places[order], docs[order]
        part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(part, np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            cut_ = slice(edges[p], edges[p + 1])
            used, doc = np.unique(docs[cut_], return_inverse=True)
            arrays = (tokens[cut_], places[cut_], doc.astype(np.uint16), groups[used], sizes[used])
            yield int(p), np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)


_KINDS = (np.uint64, np.uint16, np.uint16, np.int64, np.int32)
_FOUND = "list long, a long, b long, na long, nb long, shared long, largest long"


def _unpack(payload: bytes) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(payload, np.int64, len(_KINDS)).tolist(), 8 * len(_KINDS), []
    for kind, size in zip(_KINDS, sizes, strict=True):
        out.append(np.frombuffer(payload, kind, size, at))
        at += out[-1].nbytes
    return out


def _largest(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The largest set that an entry at this place can link with through this list.

    Sets that share i shingles share one of the first n - i + 1 of either, so some list must hold both at places of at most
    n - i; the larger the other set, the larger the i that it takes.
    """
    place = np.where(place < 65535, place, 0)
    return (100 + NUMERATOR) * (n - place) // NUMERATOR - n


def _possible(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether entries i and j of one list (n[i] <= n[j]) pass the size and position filters."""
    small, large = n[i], n[j]
    rest = np.minimum(small - place[i], large - place[j]) + np.minimum(place[i], place[j])
    known = (place[i] < 65535) & (place[j] < 65535)
    return (100 * small >= NUMERATOR * large) & (~known | (rest >= _needed(small, large)))


def _pair(t: pa.Table) -> pa.Table:
    """Group pairs of all lists of one part with the prefix shingles they share (list is null), and the entries of its long lists (b is null).

    Pairs that a long list offers are not counted but always looked at: its other pairs are left to the contraction.
    """
    parts = [_unpack(p) for p in t.column("payload").to_pylist()]
    token = np.concatenate([p[0] for p in parts])
    place = np.concatenate([p[1] for p in parts]).astype(np.int64)
    group = np.concatenate([p[3][p[2]] for p in parts])
    n = np.concatenate([p[4][p[2]] for p in parts]).astype(np.int64)
    # lists of one entry are most; drop them before sorting by more than the token
    order = np.argsort(token)
    token = token[order]
    again = np.zeros(len(token), bool)
    same = token[1:] == token[:-1]
    again[1:][same] = again[:-1][same] = True
    order, token = order[again], token[again]
    place, group, n = place[order], group[order], n[order]
    band = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / NUMERATOR)).astype(np.int64)  # of sizes that can link
    order = np.lexsort((group, band, token))
    token, place, group, n, band = token[order], place[order], group[order], n[order], band[order]
    once = np.ones(len(token), bool)
    once[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
    token, place, group, n, band = token[once], place[once], group[once], n[once], band[once]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(token)))
    start_of, length_of = np.repeat(starts, lengths), np.repeat(lengths, lengths)
    index = np.arange(len(token))
    found = []
    for step in range(1, SHORT):
        i = index[length_of <= SHORT]
        j = i + step
        ok = j < start_of[i] + length_of[i]
        found.append((i[ok], j[ok]))
    long_ = index[length_of > SHORT]
    if len(long_):
        t, bands = token[long_], band[long_]
        first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (bands[1:] != bands[:-1])))
        size = np.diff(np.append(first, len(long_)))
        own = np.repeat(np.arange(len(first)), size)
        # the least names of a band are the same ones in most lists of a family of near copies
        for back in (0, 1):
            of = own - back
            near = (of >= 0) & (t[first[of]] == t) & (bands[first[of]] == bands - back)
            for leader in range(LEADERS):
                ok = np.flatnonzero(near & (leader < size[of]))
                found.append((long_[first[of[ok]] + leader], long_[ok]))
    weight = np.concatenate([np.full(len(x[0]), 1 if k < SHORT - 1 else ALWAYS, np.int64) for k, x in enumerate(found)])
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    i, j = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
    ok = (i != j) & _possible(n, place, i, j)
    i, j, weight = i[ok], j[ok], weight[ok]
    swap = group[i] > group[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.lexsort((group[j], group[i]))
    i, j, weight = i[order], j[order], weight[order]
    first = np.flatnonzero(np.append(True, (group[i][1:] != group[i][:-1]) | (group[j][1:] != group[j][:-1]))) if len(i) else np.zeros(0, np.int64)
    shared = np.add.reduceat(weight, first) if len(first) else weight
    i, j = i[first], j[first]
    none, empty = (lambda k: pa.nulls(k, pa.int64())), len(long_)
    return pa.table(
        {
            "list": pa.concat_arrays([none(len(i)), pa.array(token[long_].view(np.int64))]),
            "a": pa.concat_arrays([pa.array(group[i]), pa.array(group[long_])]),
            "b": pa.concat_arrays([pa.array(group[j]), none(empty)]),
            "na": pa.concat_arrays([pa.array(n[i]), pa.array(n[long_])]),
            "nb": pa.concat_arrays([pa.array(n[j]), none(empty)]),
            "shared": pa.concat_arrays([pa.array(shared), none(empty)]),
            "largest": pa.concat_arrays([none(len(i)), pa.array(_largest(n[long_], place[long_]))]),
        }
    )


def _enough() -> Column:
    """Whether two groups that share so many prefix shingles can link: what lies behind the prefixes adds at most the longer rest.

    Shingles of long lists are not counted in shared; they add at most as many as either group has.
    """
    rest = lambda n: (NUMERATOR * F.col(n) + 99) / 100
    needed = F.ceil(NUMERATOR * (F.col("na") + F.col("nb")) / (100 + NUMERATOR))
    long_ = F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    return F.col("shared") + long_ + F.greatest(F.floor(rest("na")), F.floor(rest("nb"))) - 1 >= needed


def _set_rows(batch: pa.RecordBatch) -> Iterator[tuple[_text.Chunk, list[np.ndarray]]]:
    for chunk in _text.chunks(batch.column("text")):
        yield chunk, shingle_sets(chunk)


def members(read: DataFrame, order, bits: int, salt: int = 0) -> DataFrame:
    """doc_id, set (its fingerprint), check (another one), n_shingles and grp of every row of read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, part in _set_rows(batch) for s in part]
            groups = [_group(prefix(s, order.value, bits), len(s)) if len(s) else 0 for s in sets]
            names, checks = ([_fingerprint(s, x) for s in sets] for x in (salt, CHECK + salt))
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (names, checks, [len(s) for s in sets], groups))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set", "check", "n_shingles", "grp"])

    return read.mapInArrow(run, "doc_id long, set long, check long, n_shingles long, grp long")


def _identified(read: DataFrame, order, bits: int) -> tuple[DataFrame, DataFrame, int]:
    """members, their distinct sets per group (set, grp, first_id, n), and a salt under which no two different sets have one fingerprint."""
    salt = 0
    while True:
        member = cut(members(read, order, bits, salt), "members")
        some = member.where("n_shingles > 0").groupBy("set", "grp")
        known = cut(some.agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")), "known")
        if known.groupBy("set").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").isEmpty():
            return member, known.drop("lo", "hi"), salt
        salt += 1


def candidates(read: DataFrame, order, bits: int, parts: int) -> DataFrame:
    """Group pairs, and entries of long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = _Postings()

        def rows() -> pa.RecordBatch:
            made = list(stretch.payloads(parts))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names=["part", "payload"])

        for batch in batches:
            for chunk, sets in _set_rows(batch):
                for s in sets:
                    if len(s):
                        stretch.add(s, order.value, bits)
                    if len(stretch.tokens) >= STRETCH_ROWS:
                        yield rows()
                        stretch = _Postings()
                stretch.bytes += len(chunk.data)
                if stretch.bytes >= STRETCH_BYTES:
                    yield rows()
                    stretch = _Postings()
        yield rows()

    packed = read.select("text").mapInArrow(run, "part int, payload binary")
    return packed.groupBy("part").applyInArrow(_pair, _FOUND)


def _sets(read: DataFrame, wanted: DataFrame, known: DataFrame, salt: int) -> DataFrame:
    """set and shingles of the wanted sets, and of a few more. known: set and the id of one of its documents."""
    ids = wanted.distinct().join(known, "set").select(F.col("first_id").alias("doc_id"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")
    marked = np.zeros(SLOTS, bool)
    marked[ids.select(slot.alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
    sent = read.sparkSession.sparkContext.broadcast(marked)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(sent.value[batch.column("slot").to_numpy(zero_copy_only=False)]))
            for _, part in _set_rows(some):
                yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s, salt) for s in part], pa.int64()), pa.array([s.tobytes() for s in part], pa.binary())], names=["set", "shingles"])

    # copies have the same set; the joins leave out what passed the slots by chance
    held = read.select("text", slot.alias("slot")).mapInArrow(sets, "set long, shingles binary")
    return cut(held.groupBy("set").agg(F.min("shingles").alias("shingles")), "sets")


def _verified(read: DataFrame, pairs: DataFrame, known: DataFrame, salt: int) -> DataFrame:
    """Those pairs (a, b: fingerprints) whose sets link. known: set and the id of one of its documents."""
    held = _sets(read, pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))), known, salt)
    both = pairs.join(held.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(held.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= NUMERATOR * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(linked, "a long, b long")


def _first_links(asking: pa.Table, block: pa.Table) -> pa.Table:
    """A link of each asking set into the block, if it has one: exact intersections with all sets of the block from one list of their shingles."""
    found: list[tuple[int, int]] = []
    if asking.num_rows and block.num_rows:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("has")]
        names, sizes = block.column("other").to_pylist(), np.array([len(x) for x in sets])
        shingles = np.concatenate(sets)
        order = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[order], np.repeat(np.arange(len(sets)), sizes)[order]
        for name, x in zip(asking.column("set").to_pylist(), asking.column("shingles"), strict=True):
            x = np.frombuffer(x.as_buffer(), np.uint64)
            low, high = np.searchsorted(shingles, x, "left"), np.searchsorted(shingles, x, "right")
            count = high - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            linked = 100 * common >= NUMERATOR * (len(x) + sizes - common)
            if linked.any():
                found.append((name, names[int(np.argmax(linked))]))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _across(read: DataFrame, meet: DataFrame, member_of: DataFrame, known: DataFrame, salt: int) -> DataFrame:
    """Links (a, b) that join the components rx and ry of meet wherever they have any, the sets of rx visiting blocks of ry.

    member_of: set, n, root and l, the largest set it can link with. Blocks and visits are of bounded size, however large
    the components; a set visits a block of another component once, not its members one by one.
    """
    of_y = member_of.groupBy(F.col("root").alias("ry")).agg(F.sum("n").alias("shingles"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("l").alias("reach"))
    x = member_of.select(F.col("root").alias("rx"), "set", "n", "l")
    fits = (F.col("hi") * 100 >= F.col("n") * NUMERATOR) & (F.col("n") * 100 >= F.col("lo") * NUMERATOR) & (F.col("lo") <= F.col("l")) & (F.col("n") <= F.col("reach"))
    blocks = F.ceil(F.col("shingles") / BLOCK)
    asking = cut(meet.join(of_y, "ry").join(x, "rx").where(fits).select("ry", "set", "n", blocks.alias("blocks")), "asking")
    load = asking.groupBy("ry").agg(F.ceil(F.sum("n") / VISIT).alias("visits"), F.max("blocks").alias("blocks"))
    some = lambda n: F.pmod(F.xxhash64("set"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = asking.join(load.select("ry", "visits"), "ry").select("ry", "set", some("visits").alias("visit"), each("blocks").alias("block"))
    holds = member_of.select(F.col("root").alias("ry"), "set").join(load, "ry").select("ry", "set", some("blocks").alias("block"), each("visits").alias("visit"))
    held = _sets(read, asked.select("set").union(holds.select("set")), known, salt)
    asked = asked.join(held, "set").groupBy("ry", "block", "visit")
    holds = holds.toDF("y", "other", "part", "turn").join(held.toDF("other", "has"), "other").groupBy("y", "part", "turn")
    return asked.cogroup(holds).applyInArrow(_first_links, "a long, b long")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    component_id is the smallest doc_id that links reach, the row's own included. Null and empty texts, and texts without
    words, have an empty set and are linked with nothing. Equal sets always link. Rows of one doc_id are nodes of their
    own if their sets differ, and one node if not. A null doc_id counts as larger than all others: a class has it only if all its
    ids are null. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bytes_ = int(read.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = max(1, -(-(bytes_ // 6 // 4) // GROUP_POSTINGS))

    def names(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, sets in _set_rows(batch):
            yield np.concatenate(sets)

    order = spark.sparkContext.broadcast(_sketch.counts(read.select("text"), names, ORDER_BITS))
    member, known, salt = _identified(read, order, ORDER_BITS)
    found = cut(candidates(read, order, ORDER_BITS, parts), "candidates")

    # group pairs to pairs of their members' sets; a group of several sets is a list of its own
    of_group = known.select("grp", "set")
    pairs = found.where("b IS NOT NULL").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    long_of = found.where("b IS NULL").groupBy("a").agg(F.count(F.lit(1)).alias("la"))
    pairs = pairs.join(long_of, "a", "left").join(long_of.withColumnsRenamed({"a": "b", "la": "lb"}), "b", "left").where(_enough()).select("a", "b")
    pairs = pairs.join(of_group.withColumnsRenamed({"grp": "a", "set": "sa"}), "a").join(of_group.withColumnsRenamed({"grp": "b", "set": "sb"}), "b")
    within = known.groupBy("grp").agg(F.min("set").alias("sa"), F.count(F.lit(1)).alias("c")).where("c > 1")
    within_pairs = within.join(of_group, "grp").where("set <> sa").select("sa", F.col("set").alias("sb"))
    pairs = pairs.select("sa", "sb").unionByName(within_pairs)
    pairs = cut(pairs.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct(), "pairs")
    first_of = known.select("set", "first_id")
    links = cut(_verified(read, pairs, first_of, salt), "verified")
    root = components(links)

    # what long lists still hold across components
    lists = found.where("b IS NULL").select("list", F.col("a").alias("grp"), "largest").join(known.select("grp", "set", "n"), "grp").select("list", "set", "n", "largest")
    same = within.select("grp").join(known, "grp").select(F.col("grp").alias("list"), "set", "n", F.col("n").alias("largest"))
    lists = lists.unionByName(same).where(F.col("largest") * 100 >= F.col("n") * NUMERATOR)
    lists = lists.join(root.withColumnRenamed("node", "set"), "set", "left").select("list", "set", "n", "largest", F.coalesce("root", "set").alias("root"))
    lists = cut(lists, "lists")
    open_ = lists.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("list")
    left = cut(lists.join(open_, "list", "left_semi"), "open")
    held = left.groupBy("list", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("largest").alias("largest"))
    x, y = held.alias("x"), held.alias("y")
    near = (F.col("x.hi") * 100 >= F.col("y.lo") * NUMERATOR) & (F.col("y.hi") * 100 >= F.col("x.lo") * NUMERATOR)
    near = near & (F.col("y.lo") <= F.col("x.largest")) & (F.col("x.lo") <= F.col("y.largest"))
    meet = x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("x.root") < F.col("y.root")) & near).select(F.col("x.root").alias("rx"), F.col("y.root").alias("ry")).distinct()
    member_of = left.groupBy("set", "n", "root").agg(F.max("largest").alias("l"))
    # the smaller component of two is spread out first
    size = member_of.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    meet = meet.join(size.withColumnsRenamed({"root": "rx", "c": "cx"}), "rx").join(size.withColumnsRenamed({"root": "ry", "c": "cy"}), "ry")
    swap = F.col("cx") > F.col("cy")
    meet = meet.select(F.when(swap, F.col("ry")).otherwise(F.col("rx")).alias("rx"), F.when(swap, F.col("rx")).otherwise(F.col("ry")).alias("ry"))
    meet = cut(meet, "meet")
    if not meet.isEmpty():
        found_more = _across(read, meet, member_of, first_of, salt)
        root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found_more))

    rooted = known.groupBy("set").agg(F.min("first_id").alias("first_id")).join(root.withColumnRenamed("node", "set"), "set", "left")
    rooted = rooted.select("set", "first_id", F.coalesce("root", "set").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = rooted.join(smallest, "root").select("set", "component_id")
    label = label.withColumn("some", F.lit(1).cast("long"))
    joined = member.join(label, (member["set"] == label["set"]) & (member["n_shingles"] >= label["some"]), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that are the smallest of their class.

    Rows with a null doc_id, and those whose text is null or has no words, stay; rows of one doc_id stay or go together; an empty
    table stays empty. All columns stay, whatever their names.
    """
    first = classes(docs, text, doc_id).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("own"))
    return rows.join(first, F.col("own") == F.col("_id"), "left_anti").select("row.*")


def oracle() -> str:
    """The classes of `documents` in SQL: all pairs that share a shingle, and the closure of their links."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, w, unnest(generate_series(1, greatest(len(w) - {WIDTH - 1}, least(len(w), 1)))) AS i FROM d),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + {WIDTH - 1}), ' ') AS g FROM p),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM c JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * common >= {NUMERATOR} * (a.n + b.n - common)),
reach AS (SELECT r, r AS t FROM n UNION SELECT reach.r, l.y FROM reach JOIN l ON l.x = reach.t),
k AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)"""
