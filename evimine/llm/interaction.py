"""How filters interact: what each removes, in every order in which they can be applied.

Method: a packed bitmap index. Every document is measured once and each filter's verdict becomes a bit. Partition by
partition, NumPy bitsets hold the verdicts, the labels and the parts (rows are laid out by part, so that a part's bitset
is a run of whole bytes). What is alive after a subset of filters is the AND-NOT of their bitsets; its population counts
depend on the subset and not on the order, so 2**n prefix subsets stand for n! orders. Partitions send those counts only,
which are summed; orders, shares and ablations are read from the sums.

Whether a text repeats that of a smaller doc_id is decided over the whole table: the smallest doc_id per text is combined
before its shuffle, and documents ask for it by text and doc_id together, so that a text which a third of all rows share is
spread by doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evimine.llm import _text
from evimine.llm._spark import cut, ship

#: The filters of documents, in order of their bits.
FILTERS = ("A", "B", "C", "D", "E")
#: Rows of one index; parts whose sums a task holds before it sends them.
INDEX_ROWS, HELD_PARTS = 1 << 17, 4096
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"#$%&*|")] = True


def _measure(chunk: _text.Chunk) -> tuple[np.ndarray, list[bytes]]:
    """Bits of the filters that a text alone decides (A to D), and 128 bits that name it."""
    found = _text.words(chunk)
    n, data, edges = found.counts, chunk.data, chunk.offsets
    rows = found.rows
    # a word counts once in its own text
    own = _text.mix(_text.hashes(chunk, found, lower=False) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    new = np.ones(len(own), bool)
    new[1:] = own[order[1:]] != own[order[:-1]]
    distinct = np.bincount(rows[order[new]], minlength=len(n))
    points, upper, marks = (_text.per_row(x, edges) for x in ((data & 0xC0) != 0x80, _UPPER[data], _MARK[data]))
    failing = (n < 100, 100 * distinct < 80 * n, 100 * upper > 10 * points, marks > 0)
    bits = sum(f.astype(np.int32) << i for i, f in enumerate(failing))
    return bits, [hashlib.sha256(_text.text_at(chunk, r)).digest()[:16] for r in range(len(n))]


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bit i: the document fails FILTERS[i]), good and toxic of every row of docs (doc_id, text, lang).

    Null texts are empty. Null lang is the part of the empty string. A row without doc_id has no labels and never fails E;
    equal texts under one doc_id do not make each other fail. A document is good, or toxic, if any of its labels
    (doc_id, quality, toxic) says 1. Other columns are not read. No rows give no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                measured = [_measure(c) for c in _text.chunks(batch.column("text"))]
                fails = np.concatenate([m[0] for m in measured]).astype(np.int32)
                names = pa.array([d for m in measured for d in m[1]], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(fails), names], names=["doc_id", "part", "fails", "name"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    found = cut(narrow.mapInArrow(run, "doc_id long, part string, fails int, name binary"), "measured")
    own = found.where("doc_id IS NOT NULL")
    first = own.groupBy("name").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    is_1 = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_1("quality"), is_1("toxic"))
    repeated = F.when(F.col("_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    joined = own.join(first, ["name", "doc_id"], "left").join(marked, "doc_id", "left")
    no = F.lit(False)
    with_id = joined.select("part", F.col("fails").bitwiseOR(repeated).alias("fails"), F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return with_id.union(found.where("doc_id IS NULL").select("part", "fails", no, no))


def _counts(parts: np.ndarray, n_parts: int, fails: np.ndarray, labels: list[np.ndarray], n_filters: int) -> np.ndarray:
    """[part, prefix subset, filter, (alive, removed, removed with each label)] of rows, whose part is a number below n_parts."""
    sizes = np.bincount(parts, minlength=n_parts)
    first_byte = np.append(0, np.cumsum(-(-sizes // 8)))
    order = np.argsort(parts, kind="stable")
    place = np.arange(len(parts)) + np.repeat(8 * first_byte[:-1] - np.append(0, np.cumsum(sizes)[:-1]), sizes)

    def packed(flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(8 * first_byte[-1], bool)
        bits[place] = flags[order]
        return np.packbits(bits)

    def per_part(bitset: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bitset), first_byte[:-1], dtype=np.int64)

    failing, labelled = [packed(fails >> f & 1) for f in range(n_filters)], [packed(x) for x in labels]
    alive, out = [packed(np.ones(len(parts), bool))], np.zeros((n_parts, 1 << n_filters, n_filters, 2 + len(labels)), np.int64)
    for subset in range(1 << n_filters):
        if subset:
            last = subset.bit_length() - 1
            alive.append(alive[subset ^ 1 << last] & ~failing[last])
        out[:, subset, :, 0] = per_part(alive[subset])[:, None]
        for f in range(n_filters):
            if not subset >> f & 1:
                removed = alive[subset] & failing[f]
                out[:, subset, f, 1] = per_part(removed)
                for i, x in enumerate(labelled):
                    out[:, subset, f, 2 + i] = per_part(removed & x)
    return out


def prefix_counts(rows: DataFrame, n_filters: int = len(FILTERS), labels: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """part, prefix, filter, alive, removed and a column per label, for every part, subset of filters and filter outside of it.

    rows: part, fails (bits) and a boolean per label, none null. alive: rows that no filter of prefix fails; removed: those of them that the filter
    fails. No rows give no rows.
    """
    ship(rows.sparkSession)
    names = ["part", "prefix", "filter", "alive", "removed", *labels]
    outside = [(s, f) for s in range(1 << n_filters) for f in range(n_filters) if not s >> f & 1]
    at_s, at_f = (np.array(x, np.int32) for x in zip(*outside, strict=True))

    def sent(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        values = np.stack(list(sums.values()))[:, at_s, at_f].reshape(-1, 2 + len(labels))
        columns = [pa.array(np.repeat(np.array(list(sums), object), len(outside)), pa.string()), *(pa.array(np.tile(x, len(sums))) for x in (at_s, at_f))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(v)) for v in values.T)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, INDEX_ROWS):
                batch = whole.slice(low, INDEX_ROWS)
                coded = batch.column("part").dictionary_encode()
                flags = [batch.column(x).to_numpy(zero_copy_only=False) for x in labels]
                found = _counts(coded.indices.to_numpy(), len(coded.dictionary), batch.column("fails").to_numpy(), flags, n_filters)
                for part, counts in zip(coded.dictionary.to_pylist(), found, strict=True):
                    sums[part] = sums[part] + counts if part in sums else counts
            if len(sums) > HELD_PARTS:
                yield sent(sums)
                sums = {}
        if sums:
            yield sent(sums)

    schema = f"part string, prefix int, filter int, {', '.join(f'{c} long' for c in names[3:])}"
    each = rows.select("part", "fails", *labels).mapInArrow(run, schema)
    return each.groupBy("part", "prefix", "filter").agg(*(F.sum(c).alias(c) for c in names[3:]))


def orders(spark: SparkSession, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """filter_order, step, prefix and filter: every order of the filters, a row for each of its steps. n! times n rows."""
    rows = [("".join(filters[f] for f in order), i + 1, sum(1 << f for f in order[:i]), order[i]) for order in permutations(range(len(filters))) for i in range(len(filters))]
    return spark.createDataFrame(rows, "filter_order string, step int, prefix int, filter int")


def audit(counts: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """What every filter removes in every order, per part, from prefix_counts; a part that has rows has all orders.

    shapley: the filter's removed rows summed over all orders, n! times its Shapley value. No counts give no rows.
    """
    n = len(filters)
    whole, orders_with = (1 << n) - 1, F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)))
    weight = F.element_at(orders_with, F.bit_count(F.col("prefix")) + 1)
    own = counts.groupBy("part", "filter").agg(
        F.max(F.when(F.col("prefix") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("prefix").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("filter"))) == whole, F.col("removed"))).alias("unique_fails"),
        F.sum(weight * F.col("removed")).cast("long").alias("shapley"),
    )
    steps = counts.join(own, ["part", "filter"]).join(orders(counts.sparkSession, filters), ["prefix", "filter"])
    return steps.select(
        "part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def oracle() -> str:
    """The audit of `documents` and `labels` in SQL, order by order."""
    pick = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(FILTERS))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
m AS (SELECT part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(words) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM w),
c AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m GROUP BY ALL),
f(name, bit) AS (VALUES {pick}),
o AS (SELECT '' AS filter_order, 0 AS used UNION ALL SELECT filter_order || name, used + bit FROM o, f WHERE used & bit = 0),
s AS (SELECT filter_order, step, bit, (SELECT coalesce(sum(b.bit), 0) FROM f b WHERE strpos(filter_order, b.name) < step)::BIGINT AS prefix
    FROM o, range(1, {len(FILTERS) + 1}) r(step), f WHERE used = {(1 << len(FILTERS)) - 1} AND name = filter_order[step]),
x AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE fails & (prefix | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE fails & prefix = 0 AND fails & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE fails & prefix > 0 AND fails & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE good AND fails & prefix = 0 AND fails & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (WHERE toxic AND fails & prefix = 0 AND fails & bit > 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x"""
