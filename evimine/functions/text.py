"""Column expressions for noisy coded text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing key or value.
NULL_KEYS = ("nan", "None", "", "<NA>")
UNKNOWN_TEXTS = ("未知", "不详", "未测", "未填", "缺失", "不适用", "unknown", "missing", "n/a", "none", "nan")
UNKNOWN_CODES = ("99-未知", "999-未知", "9999-未知", "99999-未知")
VULNERABLE_ROLES = ("行人", "自行车", "电动自行车", "摩托车", "三轮车", "两轮车", "pedestrian", "bicycle", "motorcycle")


def normalize_key(key: Column) -> Column:
    """Trimmed, without a trailing `.0`; null where the text stands for nothing."""
    text = F.regexp_replace(F.trim(key.cast("string")), r"\.0$", "")
    return F.when(~text.isin(*NULL_KEYS), text)


def digits(text: Column) -> Column:
    """The first run of digits, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))


def first_number(text: Column) -> Column:
    """The first signed decimal as double, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(-?\d+\.?\d*)", 1), F.lit("")).try_cast("double")


def code_digit(text: Column, unknown: str = "9") -> Column:
    """The first digit as int, null if there is none or it is the code for unknown."""
    digit = F.nullif(F.regexp_extract(text, r"(\d)", 1), F.lit(""))
    return F.when(digit != unknown, digit).try_cast("int")


def contains_any(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a keyword occurs; false for null."""
    return F.coalesce(text.rlike("|".join(map(re.escape, keywords))), F.lit(False))


def sentinel(value: Column, codes: tuple[float, ...] = ()) -> Column:
    """Whether a raw value says that nothing was observed: by its text, or by a numeric code of its feature."""
    text = F.regexp_replace(F.lower(F.trim(value.cast("string"))), r"\s+", "")
    unknown = text.isin(*UNKNOWN_TEXTS, *UNKNOWN_CODES)
    if codes:
        unknown = unknown | first_number(value.cast("string")).isin(*codes)
    return F.coalesce(unknown, F.lit(False))


def observed_number(value: Column, codes: tuple[float, ...] = ()) -> Column:
    return F.when(~sentinel(value, codes), first_number(value.cast("string")))


def within(value: Column, low: float, high: float) -> Column:
    """value if it lies in the range, ends included; else null."""
    return F.when(value.between(low, high), value)


def short_label(text: Column, most: int = 140) -> Column:
    """One line of at most so many characters, white space collapsed; `None` of null, as text of nothing."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("None")), r"\s+", " ")), 1, most)


def count_summary(n: Column, share: Column) -> Column:
    """`12 (34.5%)`."""
    return F.format_string("%d (%.1f%%)", n.cast("long"), share * 100)


def spread_summary(mean: Column, sd: Column, median: Column, q1: Column, q3: Column) -> Column:
    """`1.000 ± 0.500; 1.000 [0.500, 1.500]`."""
    return F.format_string("%.3f ± %.3f; %.3f [%.3f, %.3f]", mean, sd, median, q1, q3)


def capped_list(value: Column, most: int = 20, separator: str = "||") -> Column:
    """Aggregate: the first distinct values in order, joined. All distinct values of a group are gathered before the list is cut, so they have to be few."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(value)), 1, most), separator)


def binary(value: Column) -> Column:
    """1 and 0 for the spellings of true and false, else null."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("1", "1.0", "true"), 1).when(text.isin("0", "0.0", "false"), 0)


def is_binary_like(value: Column) -> Column:
    """Aggregate: some value, and none but the spellings of true and false."""
    text = F.lower(value.cast("string"))
    return (F.count(value) > 0) & (F.count_if(~text.isin("0", "1", "0.0", "1.0", "true", "false")) == 0)


def sanitized(name: Column) -> Column:
    """Without characters that column names should not hold."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[\[\]<>,;:{}()'\"\s]", "_"), "_+", "_"), "^_+|_+$", "")


def item_name(source: Column, operator: Column, threshold: Column) -> Column:
    """`source___GT_50_0` for source > 50."""
    word = F.when(operator == ">", "GT").when(operator == "<=", "LE").otherwise("EQ")
    return F.concat(source, F.lit("___"), word, F.lit("_"), F.translate(threshold.cast("string"), ".-", "_m"))


def right_closed(value: Column, edges: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """Label of the bin (edge, next edge] that holds value, null outside."""
    bins = zip(edges, edges[1:], labels, strict=False)
    return reduce(lambda c, b: c.when((value > b[0]) & (value <= b[1]), b[2]), bins, F.when(F.lit(False), F.lit(None).cast("string")))


def parsed_time(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyyMMdd")) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def time_parts(at: Column) -> dict[str, Column]:
    """Hour, and flags (0 if unknown) for rush hours 7-9 and 17-19, night (19 to 6) and weekend."""
    hour = F.hour(at)
    flag = lambda when: F.coalesce(when.cast("int"), F.lit(0))
    return {
        "hour": hour,
        "rush_hour": flag(hour.between(7, 9) | hour.between(17, 19)),
        "night": flag((hour >= 19) | (hour <= 6)),
        "weekend": flag(F.weekday(at) >= 5),
    }


def powertrain(energy: Column) -> dict[str, Column]:
    """Flags of an energy source's text: electric, hybrid, fuel only."""
    hybrid = contains_any(F.lower(energy), ("hybrid", "混合"))
    electric = contains_any(F.lower(energy), ("electric", "battery", "纯电")) & ~hybrid
    fuel = contains_any(F.lower(energy), ("petrol", "diesel", "gasoline", "汽油", "柴油")) & ~hybrid & ~electric
    return {"electric": electric.cast("int"), "hybrid": hybrid.cast("int"), "fuel_only": fuel.cast("int")}


# What the texts of an energy vehicle's kind, a motor and a fuel say of a powertrain, texts of no battery, and the labels.
ELECTRIC_WORDS = (("纯电",), ("电动机",), ("电池",))
HYBRID_WORDS = (("插电式混合", "增程", "混合动力"), ("混合动力",), ("混合动力",))
FUEL_WORDS = ((), ("汽油发动机", "柴油发动机"), ("汽油", "柴油"))
NO_BATTERY = ("不适用", "未知", "nan")
POWERTRAINS = ("纯电/电驱", "混动/增程", "燃油", "未知")


def vehicle_power(kind: Column, motor: Column, fuel: Column, capacity: Column, battery: Column) -> dict[str, Column]:
    """Flags of a vehicle by five texts: purely electric, hybrid, new energy (either, or a battery on record), and the powertrain's label.

    A battery is on record if its capacity is a number above 0, or its type is told. Null texts tell nothing; a column that a table lacks is a
    null literal. Electric comes before hybrid in the label, and fuel counts only where neither holds.
    """
    told = lambda words: reduce(lambda a, b: a | b, (contains_any(c, w) for c, w in zip((kind, motor, fuel), words, strict=True) if w))
    electric, hybrid = told(ELECTRIC_WORDS), told(HYBRID_WORDS)
    size = F.nanvl(capacity.cast("string").try_cast("double"), F.lit(0.0))
    stored = F.coalesce(size > 0, F.lit(False)) | (battery.isNotNull() & ~contains_any(battery, NO_BATTERY))
    label = F.when(electric, POWERTRAINS[0]).when(hybrid, POWERTRAINS[1]).when(told(FUEL_WORDS), POWERTRAINS[2]).otherwise(POWERTRAINS[3])
    return {"electric": electric.cast("int"), "hybrid": hybrid.cast("int"), "new_energy": (electric | hybrid | stored).cast("int"), "powertrain": label}
