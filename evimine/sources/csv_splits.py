"""Quoted CSV of any encoding that extends ASCII, read by many tasks.

A record may hold line ends within quotes, so a task that starts in the middle of a file cannot tell whether it starts within a field. Lines are cut by
Spark's text source, which splits files into blocks. A first pass tells for every block where it ends, inside or outside of quotes, for
both ways in which it may begin, and which encodings its bytes allow: one small row per block. In order of the blocks of a file, those rows give how each
begins. The second pass parses the records that a block holds whole; what a block has of a record that it shares with its neighbours is joined
with theirs, at most two pieces per block.

Bytes of quote, comma and line end have to stand for nothing else: so in UTF-8, GB18030, GBK, Big5, Shift-JIS and all one-byte codes, and not in
UTF-16. A quote opens a field only where the field begins, and is doubled within, as Python's csv module has it.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from io import StringIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evimine.sources.scratch import ship, stored

#: Lines that are parsed at once.
LINES = 10_000


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line that begins inside of quotes, or at a field, ends inside of quotes."""
    if b'"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != b'"':
                at = line.find(b",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        close = line.find(b'"', at)
        if close < 0:
            return True
        inside = line[close + 1 : close + 2] == b'"'
        if inside:
            at = close + 2
            continue
        at = line.find(b",", close + 1) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _by_block(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ()) -> Iterator[tuple[tuple, list[bytes]]]:
    """Key (file, block and the other columns) and lines of stretches of one block, in order."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("file", "block", *columns)), strict=True))
        lines, low = batch.column("line").to_pylist(), 0
        for high in range(1, len(keys) + 1):
            if high == len(keys) or keys[high] != keys[low]:
                yield keys[low], [line or b"" for line in lines[low:high]]
                low = high


def _blocks(spark: SparkSession, path: str, encodings: tuple[str, ...]) -> DataFrame:
    """file, block, begins (inside of quotes) and bad (how many encodings from the first its bytes do not allow, as bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for key, lines in _by_block(batches):
            own = found.setdefault(key, [False, True, 0])
            for line in lines:
                if b'"' in line:
                    own[0], own[1] = ends_inside(line, own[0]), ends_inside(line, own[1])
            joined = b"\n".join(lines)
            for i, encoding in enumerate(encodings):
                if not own[2] >> i & 1:
                    try:
                        joined.decode(encoding)
                    except UnicodeDecodeError:
                        own[2] |= 1 << i
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()), strict=True)], names=["file", "block", "out", "out_inside", "bad"])

    each = _lines(spark, path).mapInArrow(run, "file string, block long, out boolean, out_inside boolean, bad long")
    ordered = F.array_sort(F.collect_list(F.struct("block", "out", "out_inside", "bad")))
    step = lambda a, b: F.struct(F.when(a["inside"], b["out_inside"]).otherwise(b["out"]).alias("inside"), F.concat(a["begins"], F.array(a["inside"])).alias("begins"))
    zero = F.struct(F.lit(False).alias("inside"), F.array().cast("array<boolean>").alias("begins"))
    files = each.groupBy("file").agg(ordered.alias("blocks")).withColumn("begins", F.aggregate("blocks", zero, step)["begins"])
    zipped = F.explode(F.arrays_zip("blocks", "begins")).alias("z")
    return stored(files.select("file", zipped).select("file", F.col("z.blocks.block").alias("block"), F.col("z.begins").alias("begins"), F.col("z.blocks.bad").alias("bad")))


def _parsed(text: str, width: int) -> list[list[str | None]]:
    return [[(r[i] or None) if i < len(r) else None for i in range(width)] for r in csv.reader(StringIO(text, newline="")) if r]


def header(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """Column names of the first file by name; nameless ones by place."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return []
    lines = [bytes(r["line"]) for r in spark.read.option("lineSep", "\n").text(files[0]).select(F.col("value").cast("binary").alias("line")).head(100)]
    first = next(csv.reader(StringIO(b"\n".join(lines).decode(encoding, "replace"), newline="")), [])
    return [c.lstrip("﻿") or f"_c{i}" for i, c in enumerate(first)]


def read(spark: SparkSession, path: str, encodings: tuple[str, ...]) -> DataFrame:
    """All columns as text, empty ones null; each file's first record is its header. The first encoding that all bytes allow is taken, else the last.

    Short records are filled with nulls and long ones cut to the first file's header; blank lines are left out. Rows come in any order.
    """
    ship(spark)
    blocks = _blocks(spark, path, encodings)
    bad = blocks.agg(F.bit_or("bad")).first()[0] or 0
    encoding = next((e for i, e in enumerate(encodings) if not bad >> i & 1), encodings[-1])
    names = header(spark, path, encoding)
    schema = StructType([StructField(c, StringType()) for c in names])
    if not names:
        return spark.createDataFrame([], schema)
    # one row per block of some megabytes
    lines = _lines(spark, path).join(F.broadcast(blocks.select("file", "block", "begins")), ["file", "block"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str, list[bytes]]]:
        """(file, block), what it is (head, record or tail; a record is the first of its file if its block is 0 and nothing came before), and the lines of it."""
        key, inside, open_, began_inside, records = None, False, [], False, 0
        for (file, block, begins), some in _by_block(batches, ("begins",)):
            if key != (file, block):
                if open_:
                    yield key, "head" if began_inside else "header" if not records and key[1] == 0 else "tail", open_
                key, inside, open_, began_inside, records = (file, block), begins, [], begins, 0
            for line in some:
                open_.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    kind = "head" if began_inside else "header" if not records and block == 0 else "record"
                    yield key, kind, open_
                    open_, began_inside, records = [], False, records + 1
        if open_:
            yield key, "head" if began_inside else "header" if not records and key[1] == 0 else "tail", open_

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def sent() -> pa.RecordBatch:
            rows = _parsed(b"\n".join(held).decode(encoding, "replace"), len(names))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=[f"c{i}" for i in range(len(names))])

        for _, kind, own in pieces(batches):
            if kind == "record":
                held += own
                if len(held) >= LINES:
                    yield sent()
                    held = []
        if held:
            yield sent()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*key, kind, b"\n".join(own)) for key, kind, own in pieces(batches) if kind in ("head", "tail", "header")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["file", "block", "kind", "piece"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for pieces_ in batch.column("pieces").to_pylist() for r in _parsed(b"\n".join(p["piece"] for p in pieces_).decode(encoding, "replace"), len(names))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=[f"c{i}" for i in range(len(names))])

    numbered = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    inner = lines.mapInArrow(whole, numbered)
    parts = lines.mapInArrow(shared, "file string, block long, kind string, piece binary")
    # in one block the end of a record comes before a header, and that before the beginning of a record, as their names do
    order = W.partitionBy("file").orderBy("block", "kind").rowsBetween(W.unboundedPreceding, 0)
    starts = F.sum((F.col("kind") != "head").cast("int")).over(order)
    grouped = parts.withColumn("record", starts).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "piece"))).alias("pieces"))
    rest = grouped.where(F.col("pieces")[0]["kind"] != "header").select("pieces").mapInArrow(joined, numbered)
    return inner.union(rest).toDF(*names)
