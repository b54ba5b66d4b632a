"""Licence scans by Dice coefficient over word bigrams.

Method: texts and templates are normalised to lower-case words; a unit of text (each line, and the text as a whole) is
compared with a template by 2 * common / (bigrams + bigrams) over their sets of word bigrams. A template is a
candidate only if the sizes allow the threshold, and a unit only if its word counts allow some template. Where none of
these matches a template, runs of words are compared, over line ends: the best run begins with a bigram of the template and
has at most as many distinct bigrams as the threshold allows, so one pass from each such place finds it. Texts are read for
runs only if they have a word without which too few of a template's bigrams are left, and then enough of its bigrams.

Only DataFrame functions, no shuffle before the final aggregate of matches per document. Templates are a constant of
the program (a dozen rows), so they travel inside the plan.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of public licence notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.8
#: Words that say little about a text; taken as anchors only where a template has no others left.
COMMON = frozenset("a above all an and any are as at be by for from if in is it may not of on or out that the this to under use was with without you".split())


def bigrams(text: str) -> list[str]:
    """Sorted set of word bigrams of a normalised text."""
    w = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def anchors(grams: list[str], missing: int) -> list[str]:
    """Words of which a text has at least one if it lacks no more than so many of the bigrams."""
    left, found = set(grams), []
    while left and len(grams) - len(left) <= missing:
        in_grams = Counter(w for g in left for w in set(g.split(" ")))
        found.append(max(in_grams, key=lambda w: (w not in COMMON, in_grams[w], len(w), w)))
        left = {g for g in left if found[-1] not in g.split(" ")}
    return found


def _pairs(w: str) -> Column:
    return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))


def _computed(df: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """kept and the given columns, each computed once: a generator's output is not folded into what reads it."""
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _best_run(b: Column, tb: Column, m: Column, most: Column) -> Column:
    """The best Dice coefficient of a run of the bigrams b with the template's."""
    reach = most * 4  # far enough unless bigrams repeat

    def at(i: Column) -> Column:
        near = F.array_distinct(F.slice(b, i, reach))
        seen = F.when((F.size(near) >= most) | (i + reach > F.size(b)), near).otherwise(F.array_distinct(F.slice(b, i, F.size(b))))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(0.0).alias("best"))

        def step(done: Column, x: Column) -> Column:
            n, c = done["n"] + 1, done["c"] + F.array_contains(tb, x).cast("int")
            return F.struct(n.alias("n"), c.alias("c"), F.greatest(done["best"], 2.0 * c / (n + m)).alias("best"))

        return F.aggregate(F.slice(seen, F.lit(1), most), none, step, lambda done: done["best"])

    starts = F.filter(F.sequence(F.lit(1), F.size(b)), lambda i: F.array_contains(tb, F.get(b, i - 1)))
    return F.array_max(F.transform(starts, at))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Matches of whole texts: doc_id, license_id, n_units (distinct normalised units that match) and dice (the best).

    A unit is each line of the text and the text as a whole; equal units of a text count once. A template that no unit
    matches is matched by the best run of words (over line ends, or within a line), which counts as one unit. Ties keep
    every template that reaches the threshold. Null and empty texts match nothing; rows of one doc_id (repeated ones, null)
    are taken together; an empty table has no matches; other columns are ignored.
    """
    sets = {k: b for k, v in (TEMPLATES if templates is None else templates).items() if (b := bigrams(v))}
    # a little wider, so that rounding never decides; the coefficient does
    low = {k: len(v) * threshold / (2 - threshold) - 1e-9 for k, v in sets.items()}
    high = {k: len(v) * (2 - threshold) / threshold + 1e-9 for k, v in sets.items()}
    least, most = min(low.values(), default=math.inf), max(high.values(), default=0.0)
    need, longest = {k: math.ceil(x) for k, x in low.items()}, {k: math.floor(x) for k, x in high.items()}
    rare = {k: anchors(v, len(v) - need[k]) for k, v in sets.items()}
    has = lambda c, words: reduce(lambda a, x: a | x, (F.contains(c, F.lit(f" {w} ")) for w in words), F.lit(False))
    units = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ").alias("t"))
    lines = F.transform(F.concat(F.split("t", "\n"), F.array(F.translate("t", "\n", " "))), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    units = _computed(units, "doc_id", u=lines)
    units = units.select("doc_id", F.inline(F.transform(F.array_distinct("u"), lambda x: F.struct(x.alias("unit"), (x == F.element_at("u", -1)).alias("whole")))))
    # at least one word more than the fewest bigrams; d distinct words make d - 1 distinct bigrams or more
    spaces = F.length("unit") - F.length(F.replace("unit", F.lit(" "), F.lit("")))
    units = units.where(spaces >= least)
    padded = F.concat(F.lit(" "), F.col("unit"), F.lit(" "))
    units = _computed(units, "doc_id", "unit", whole=F.when(F.col("whole"), has(padded, sorted({w for x in rare.values() for w in x}))).otherwise(F.lit(False)))
    units = _computed(units, "doc_id", "unit", "whole", w=F.split("unit", " "))
    units = units.where(F.col("whole") | (F.size("w") <= 4 * most + 4) | (F.size(F.array_distinct("w")) - 1 <= most))
    units = _computed(units.where(F.size("w") >= 2), "doc_id", "unit", "whole", a=_pairs("w"))
    units = _computed(units, "doc_id", "unit", "whole", "a", b=F.array_distinct("a"))
    units = units.withColumn("n", F.size("b")).where((F.col("n") >= least) & (F.col("whole") | (F.col("n") <= most)))
    fits = lambda k: (F.col("n") >= low[k]) & (F.col("n") <= high[k])
    known = F.array(*(F.when(fits(k) | (F.col("whole") & has(padded, rare[k])), F.struct(F.lit(k).alias("license_id"), F.lit(low[k]).alias("low"), F.lit(high[k]).alias("high"), F.lit(longest[k]).alias("longest"), F.lit(len(v)).alias("m"), F.array(*map(F.lit, v)).alias("tb"))) for k, v in sets.items()))
    near = units.select("doc_id", "unit", "whole", "a", "b", "n", F.inline(F.filter(known, lambda x: x.isNotNull())))
    near = _computed(near, "doc_id", "license_id", "unit", "whole", "a", "n", "low", "high", "longest", "m", "tb", common=F.size(F.array_intersect("b", "tb")))
    near = near.where(F.col("common") >= F.col("low"))
    dice = F.when((F.col("n") >= F.col("low")) & (F.col("n") <= F.col("high")), 2.0 * F.col("common") / (F.col("n") + F.col("m")))
    near = _computed(near, "doc_id", "license_id", "unit", "whole", "a", "longest", "m", "tb", dice=dice)
    run = F.when(F.col("whole") & ~F.coalesce(F.col("dice") >= threshold, F.lit(False)), _best_run(F.col("a"), F.col("tb"), F.col("m"), F.col("longest")))
    hits = _computed(near, "doc_id", "license_id", "unit", "dice", run=run).where((F.col("dice") >= threshold) | (F.col("run") >= threshold))
    of_units = F.when(F.col("dice") >= threshold, F.col("dice"))
    n_units = F.count_distinct(F.when(F.col("dice") >= threshold, F.col("unit")))
    return hits.groupBy("doc_id", "license_id").agg(F.greatest(F.lit(1).cast("long"), n_units).alias("n_units"), F.coalesce(F.max(of_units), F.max("run")).alias("dice"))


def oracle() -> str:
    """The same scan in DuckDB SQL."""
    rows = ", ".join(f"('{k}', [{', '.join(repr(b) for b in bigrams(v))}])" for k, v in TEMPLATES.items())
    return f"""
WITH templates(license_id, tb) AS (VALUES {rows}),
norm AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL),
units AS (SELECT DISTINCT doc_id, trim(regexp_replace(u, ' +', ' ', 'g')) AS unit
          FROM (SELECT doc_id, unnest(list_concat(string_split(t, chr(10)), [replace(t, chr(10), ' ')])) AS u FROM norm)),
grams AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
          FROM (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM units) WHERE len(w) >= 2),
scored AS (SELECT doc_id, unit, license_id, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice
           FROM grams, templates WHERE 2.0::DOUBLE * least(len(b), len(tb)) / (len(b) + len(tb)) >= {THRESHOLD}::DOUBLE)
SELECT doc_id, license_id, count(DISTINCT unit) AS n_units, max(dice) AS dice FROM scored WHERE dice >= {THRESHOLD}::DOUBLE GROUP BY doc_id, license_id
"""
