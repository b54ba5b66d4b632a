"""Quality rules as a bitmask ledger.

Method: every document is measured once and every rule is evaluated once; the ledger keeps the measurements and one
integer whose bit i says that rule i failed. Policies are versioned sets of rules and only test bits; ablations are
bitwise aggregates over the distinct bit patterns (never more than 2**rules rows, pre-aggregated before the shuffle).

Measuring is one pass per partition with no shuffle and works on about a megabyte of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimine.llm import _text
from evimine.llm._spark import ship

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words")
_BLANK = b" \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True



def _rules() -> dict[str, Column]:
    """Rules in order of their bits; each says when a document fails. All compare whole numbers."""
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 100 * F.col("n_symbols") > 25 * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > 60 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "letterless_words": 100 * F.col("n_letter_words") < 50 * n,
    }


RULE_NAMES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "letterless_words")
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {"v1": BASE, "v2": RULE_NAMES}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULE_NAMES.index(r) for r in rules)


def _measure(column: pa.Array) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in MEASURES]
    for chunk in _text.chunks(column):
        found = _text.words(chunk)
        data, edges = chunk.data, chunk.offsets
        inside = _text.IS_WORD[data]
        n_words = found.counts
        word_chars = _text.per_row(inside & ((data & 0xC0) != 0x80), edges)
        symbols = _text.per_row(_SYMBOL[data], edges)
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_LETTER[data], out=letters[1:])
        with_letter = _text.per_row(letters[found.ends] > letters[found.starts], found.first)
        lines, repeats = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
        for row in np.flatnonzero(n_words):
            full = [x for x in _text.text_at(chunk, row).split(b"\n") if x.strip(_BLANK)]
            lines[row], repeats[row] = len(full), len(full) - len(set(full))
        starts, names, rows = _text.windows(_text.hashes(chunk, found, lower=False), found.first, 3)
        names = _text.mix(names + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # of one text only
        order = np.argsort(names)
        again = np.zeros(len(names), bool)
        same = names[order[1:]] == names[order[:-1]]
        again[order[1:][same]] = again[order[:-1][same]] = True
        covered = np.zeros(len(found.starts), bool)
        for shift in range(3):
            covered[starts[again] + shift] = True
        for i, x in enumerate((n_words, word_chars, symbols, lines, repeats, _text.per_row(covered, found.first), with_letter)):
            out[i].append(x)
    return [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]


def ledger(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the measurements of every whole text and `failures`, the bits of the rules it fails.

    Null and empty texts have no words (all measurements 0). Repeated rows are measured each. Columns of docs that are
    named like a measurement or `failures` are replaced; all others stay.
    """
    ship(docs.sparkSession)
    kept = docs.drop(*MEASURES, "failures")
    fields = [f for f in kept.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                measured = _measure(batch.column(text))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *map(pa.array, measured)], names=[*names, *MEASURES])

    bits = sum((F.when(rule, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(_rules().values())), F.lit(0).cast("long"))
    return kept.mapInArrow(run, schema).withColumn("failures", bits)


def passes(policy: str = "v2") -> Column:
    """Whether a row of the ledger fails no rule of the policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablation(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail only it, and that would be kept without it.

    Repeated rows count each; an empty ledger gives no rows. The rows met here are at most one per pattern of bits.
    """
    patterns = entries.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    whole = mask(POLICIES[policy])
    rule = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy])))
    each = patterns.select("failures", "n", rule.alias("r")).select("failures", "n", "r.rule", "r.bit")
    failed = F.col("failures").bitwiseAND(F.lit(whole).cast("long"))
    others = failed.bitwiseAND(F.bitwise_not(F.col("bit")))
    hit = failed.bitwiseAND(F.col("bit")) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(total(hit).alias("failing"), total(hit & (others == 0)).alias("failing_only"), total(others == 0).alias("kept_without"))


def verdicts(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger's verdict on every document, with the base measurements.

    Null and empty texts fail the base rules; repeated rows and rows of one doc_id, or of none, are judged each; an
    empty table gives no rows; other columns are ignored.
    """
    base = F.col("failures").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    entries = ledger(docs.select("doc_id", "text"), keep_text=False)
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "failures")


def keep(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of docs that the policy and the base rules keep, repeated ones each; null and empty texts go, an empty table stays empty."""
    entries = ledger(docs)
    base = F.col("failures").bitwiseAND(F.lit(mask(BASE)).cast("long")) == 0
    return entries.where(base & passes(policy)).select(*docs.columns)


def oracle() -> str:
    """The verdicts on `documents` in SQL."""
    rules = {
        "few_words": "n_words < 50",
        "repeated_words": "100 * n_repeat_words > 50 * n_words",
        "symbols": "100 * n_symbols > 25 * n_words",
        "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
        "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
        "letterless_words": "100 * n_letter_words < 50 * n_words",
    }
    bits = " + ".join(f"CASE WHEN {rules[r]} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULE_NAMES))
    return f"""WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT row_id, unnest(generate_series(1, len(words) - 2)) AS i, words FROM w),
h AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, words[i], words[i + 1], words[i + 2]) AS n FROM g),
c AS (SELECT row_id, count(DISTINCT place)::BIGINT AS n_repeat_words FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS place FROM h WHERE n > 1) GROUP BY row_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]')))::BIGINT AS n_letter_words FROM w LEFT JOIN c USING (row_id)),
f AS (SELECT *, ({bits})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {mask(BASE)}) <> 0 AS base_failed, (failures & {mask(BASE) | mask(POLICIES["v2"])}) = 0 AS kept, failures FROM f"""
