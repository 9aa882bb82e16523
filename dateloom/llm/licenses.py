"""Licence scan: units of text against licence templates by the Dice coefficient of their word bigrams.

Units are the lines of a text, its paragraphs (between blank lines) and the whole,
and for each template the best run of lines; if none of them matches, any run of words
is one. A run has at most twice as many words as the largest set of pairs its template
can match; all the runs of a text count as one unit, and only if no other matches.
Unit and template are lower-cased, ASCII marks become spaces, and each is the set
of its pairs of neighbouring words. Dice >= ``least`` needs the sizes to be within a
factor of (2 - least) / least, which prunes templates before sets are compared, and a
unit that could reach it for a template must hold one of some words of the template,
so texts without any of those are passed by. Everything is column
arithmetic on the row, so nothing is shuffled and no group can grow hot.

Edge cases: null, empty and one-word texts have no licence; among equal scores the
first licence by name wins; repeated rows each get their answer; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dateloom.llm.common import let, text_or_empty

LEAST = 0.8

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published "
    "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
)

#: (SPDX id, text): public licence notices and the usual one-line statements.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. " + _AS_IS,
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", _GNU.format("General Public License")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", _GNU.format("Lesser General Public License")),
    ("AGPL-3.0", _GNU.format("Affero General Public License")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]

#: ASCII characters that are no letter, digit or line feed; the second class also takes line feeds.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
ALL_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_pairs(text: str) -> list[str]:
    words = re.sub(ALL_MARKS, " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, least: float) -> tuple[int, int]:
    """Sizes of a set that can reach Dice ``least`` with a set of ``size``."""
    ratio = (2 - least) / least
    return max(1, math.ceil(size / ratio - 1e-9)), math.floor(size * ratio + 1e-9)


def anchor_words(pairs: Sequence[str], least: float) -> list[str]:
    """Words of which a unit must hold one to reach Dice ``least``: few, long ones first, whose pairs outnumber those it may miss."""
    low, _ = size_bounds(len(pairs), least)
    may_miss = len(pairs) - math.ceil(least * (len(pairs) + low) / 2 - 1e-9)
    holding: dict[str, set[str]] = {}
    for p in pairs:
        for w in p.split(" "):
            holding.setdefault(w, set()).add(p)
    chosen: list[str] = []
    covered: set[str] = set()
    while len(covered) <= may_miss:
        best = max(holding.keys() - set(chosen), key=lambda w: (len(w) > 4 and bool(holding[w] - covered), len(holding[w] - covered), len(w), w))
        chosen.append(best)
        covered |= holding[best]
    return chosen


def any_word(words: Sequence[str]) -> str:
    """A pattern for any of the words, whole and in either case; words with the same first letter share a branch."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by_letter.setdefault(w[0], []).append(w[1:])
    branches = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    inside = r"[0-9a-z\x80-\x{10FFFF}]"
    return rf"(?i)(?<!{inside})(?:{branches})(?!{inside})"


def folded(text: Column) -> Column:
    """Lower case, marks as single spaces, lines kept."""
    return F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), MARKS, " ")


def units_of(text: Column) -> Column:
    """Lines, paragraphs and the whole of a folded text, each word between single spaces, without repeats."""
    parts = F.transform(F.split(text, r"\n[ \n]*\n"), lambda p: F.translate(p, "\n", " "))
    every = F.concat(F.split(text, r"\n"), parts, F.array(F.translate(text, "\n", " ")))
    return F.array_distinct(F.transform(every, lambda u: F.trim(F.regexp_replace(u, " +", " "))))


def word_pairs(unit: Column, least_words: int) -> Column:
    """The distinct neighbouring pairs of a unit with enough words for some template; else an empty array."""
    words = F.split(unit, " ")
    spaces = F.length(unit) - F.length(F.translate(unit, " ", ""))
    later = F.slice(words, 2, F.greatest(spaces, F.lit(1)))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(spaces, F.lit(1))), later, lambda a, b: F.concat_ws(" ", a, b))
    return F.when(spaces >= least_words - 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def better_first(a: Column, b: Column) -> Column:
    """Sort order: the higher score, then the earlier name."""
    return (
        F.when(a["dice"] > b["dice"], -1)
        .when(a["dice"] < b["dice"], 1)
        .when(a["licence"] < b["licence"], -1)
        .when(a["licence"] > b["licence"], 1)
        .otherwise(0)
    )


def matching_units(text: Column, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> Column:
    """array<struct(dice, licence)> of a folded text: for each unit that matches any template, the best one."""
    known = [(name, template_pairs(body)) for name, body in templates]
    bounds = [size_bounds(len(p), least) for _, p in known]
    low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
    every = sorted({p for _, pairs in known for p in pairs})
    need = min(math.ceil(least * (len(p) + b[0]) / 2 - 1e-9) for (_, p), b in zip(known, bounds, strict=True))
    sets = F.transform(units_of(text), lambda unit: word_pairs(unit, low + 1))
    sized = F.transform(
        F.filter(sets, lambda p: F.size(p).between(low, high)),
        lambda p: F.struct(F.size(p).alias("n"), F.filter(p, lambda x: x.isin(every)).alias("common")),
    )

    def best(unit: Column) -> Column:
        scores = []
        for (name, pairs), (lo, hi) in zip(known, bounds, strict=True):
            common = F.size(F.array_intersect(unit["common"], F.array(*map(F.lit, pairs))))
            dice = F.lit(2.0) * common / (unit["n"] + F.lit(len(pairs)))
            scores.append(
                F.struct(F.when(unit["n"].between(lo, hi), dice).otherwise(0.0).alias("dice"), F.lit(name).alias("licence"))
            )
        return F.get(F.array_sort(F.filter(F.array(*scores), lambda s: s["dice"] >= least), better_first), 0)

    near = F.filter(sized, lambda u: F.size(u["common"]) >= need)
    return F.filter(F.transform(near, best), lambda s: s.isNotNull())


def placed_words(text: Column) -> Column:
    """array<struct(w, k, m)> of a folded text: each word, its place in its line and the line's words."""
    lines = F.transform(F.split(text, r"\n"), lambda u: F.split(F.trim(F.regexp_replace(u, " +", " ")), " "))
    filled = F.filter(lines, lambda ws: F.get(ws, 0) != "")
    return F.flatten(F.transform(filled, lambda ws: F.transform(ws, lambda w, k: F.struct(w.alias("w"), k.alias("k"), F.size(ws).alias("m")))))


def matching_windows(text: Column, whole_lines: bool, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> Column:
    """array<struct(dice, licence)> of a folded text: for each template that a window reaches, the best window's score.

    Windows are runs of whole lines, blank ones skipped, or else any neighbouring words. Words or lines at the edge
    without a pair of the template only lower the score, so windows begin and end with one that has such a pair.
    """
    known = [(name, template_pairs(body)) for name, body in templates]
    every = sorted({p for _, pairs in known for p in pairs})
    none = F.array().cast("array<struct<dice:double,licence:string>>")

    def scores(words: Column, pairs: Column, hits: Column) -> Column:
        def first(h: Column) -> Column:
            return h["j"] - F.get(words, h["j"])["k"] if whole_lines else h["j"]

        def last(h: Column) -> Column:
            j = h["j"] + 1
            return j - F.get(words, j)["k"] + F.get(words, j)["m"] - 1 if whole_lines else j

        def of(name: str, own_pairs: list[str]) -> Column:
            t = len(own_pairs)
            lo, hi = size_bounds(t, least)
            need = math.ceil(least * (t + lo) / 2 - 1e-9)
            distinct = lambda hs: F.size(F.array_distinct(F.transform(hs, lambda h: h["p"])))

            def dice(near: Column, a: Column, z: Column) -> Column:
                def with_common(common: Column) -> Column:
                    n = F.when(common >= need, F.size(F.array_distinct(F.slice(pairs, a + 1, z - a))))
                    return let(n, lambda n: F.when(n.between(lo, hi), F.lit(2.0) * common / (n + F.lit(t))))

                return let(distinct(F.filter(near, lambda h: h["j"] < z)), with_common)

            def from_start(own: Column, a: Column) -> Column:
                def ends(near: Column) -> Column:
                    stops = F.filter(F.array_distinct(F.transform(near, last)), lambda z: (z - a).between(lo, 2 * hi))
                    return F.when(distinct(near) >= need, F.array_max(F.transform(stops, lambda z: dice(near, a, z))))

                return let(F.filter(own, lambda h: h["j"].between(a, a + F.lit(2 * hi))), ends)

            def best(own: Column) -> Column:
                starts = F.array_distinct(F.transform(own, first))
                return F.when(distinct(own) >= need, F.array_max(F.transform(starts, lambda a: from_start(own, a))))

            listed = F.split(F.lit("\n".join(own_pairs)), "\n")  # one constant: a literal a pair takes seconds to build
            score = let(F.filter(hits, lambda h: F.array_contains(listed, h["p"])), best)
            return F.struct(score.alias("dice"), F.lit(name).alias("licence"))

        return F.filter(F.array(*(of(name, p) for name, p in known)), lambda s: s["dice"] >= least)

    def with_words(words: Column) -> Column:
        n = F.greatest(F.size(words) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a["w"], b["w"]))

        def with_pairs(pairs: Column) -> Column:
            placed = F.transform(pairs, lambda p, j: F.when(p.isin(every), F.struct(p.alias("p"), j.alias("j"))))
            return let(F.filter(placed, lambda h: h.isNotNull()), lambda hits: scores(words, pairs, hits))

        return F.when(n > 0, let(pairs, with_pairs)).otherwise(none)

    return let(placed_words(text), with_words)


def may_hold_licence(text: Column, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> Column:
    """Whether a text holds an anchor word of any template; false means that none can match."""
    return text.rlike(any_word([w for _, body in templates for w in anchor_words(template_pairs(body), least)]))


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: its best licence, that licence's score and the number of matching units."""
    none = F.array().cast("array<struct<dice:double,licence:string>>")
    whole = text_or_empty(text)
    ready = docs.select(doc_id, F.when(may_hold_licence(whole, least=least), folded(whole)).alias("folded"))
    units = F.when(F.col("folded").isNotNull(), matching_units(F.col("folded"), least=least)).otherwise(none)
    windows = lambda lines: F.when(F.col("folded").isNotNull(), matching_windows(F.col("folded"), lines, least=least)).otherwise(none)

    def with_words(found: Column) -> Column:
        return F.when(F.size(found["all"]) > 0, found).otherwise(F.struct(windows(False).alias("all"), found["units"].alias("units")))

    both = let(units, lambda u: F.struct(F.concat(u, windows(True)).alias("all"), F.size(u).alias("units")))
    ranked = ready.select(doc_id, let(both, with_words).alias("found")).select(
        doc_id, F.array_sort("found.all", better_first).alias("found"), F.col("found.units").alias("units")
    )
    return ranked.select(
        doc_id,
        F.get("found", F.lit(0))["licence"].alias("licence"),
        F.get("found", F.lit(0))["dice"].alias("dice"),
        F.greatest("units", F.least(F.size("found"), F.lit(1))).cast("long").alias("n_units"),
    )


def oracle() -> str:
    """The same scan in DuckDB SQL."""
    rows = ",\n            ".join(
        f"({i}, '{name}', [{', '.join(repr(p) for p in template_pairs(body))}])" for i, (name, body) in enumerate(TEMPLATES)
    )
    return rf"""
        WITH templates(t, licence, pairs) AS (VALUES
            {rows}
        ), folded AS (
            SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g') AS f
            FROM documents
        ), units AS (
            SELECT DISTINCT doc_id, trim(regexp_replace(u, ' +', ' ', 'g')) AS unit
            FROM (SELECT doc_id, unnest(list_concat(list_concat(string_split(f, chr(10)),
                      list_transform(string_split_regex(f, '\n[ \n]*\n'), lambda p: translate(p, chr(10), ' '))),
                      [translate(f, chr(10), ' ')])) AS u FROM folded)
        ), words AS (
            SELECT doc_id, unit, string_split(unit, ' ') AS w FROM units WHERE contains(unit, ' ')
        ), pairs AS (
            SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM words
        ), hits AS (
            SELECT doc_id, unit, licence, 2.0 * len(list_intersect(p, pairs.pairs_t)) / (len(p) + len(pairs.pairs_t)) AS dice
            FROM (SELECT a.doc_id, a.unit, a.p, b.licence, b.pairs AS pairs_t FROM pairs a, templates b
                  WHERE len(a.p) <= 1.5 * len(b.pairs) AND len(b.pairs) <= 1.5 * len(a.p)) pairs
        ), good AS (SELECT * FROM hits WHERE dice >= 0.8),
        best AS (
            SELECT doc_id, licence, dice FROM good
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, licence) = 1
        ), counted AS (SELECT doc_id, count(DISTINCT unit) AS n FROM good GROUP BY doc_id)
        SELECT d.doc_id, licence, dice, coalesce(n, 0)::BIGINT AS n_units
        FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN counted USING (doc_id)
    """
