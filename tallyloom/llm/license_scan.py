"""Licences of files: TF-IDF cosine of lines, blocks and whole texts to templates, inherited down directories; built-in functions only.

Terms are runs of ASCII letters and digits, lower-cased. A term's weight is ``ln((N + 1) / (df + 1)) + 1`` with its document
frequency over all files; a term of no template counts as one that no file has. Comment marks are no terms. A unit (a line, a
paragraph, a run of comment lines, or a whole text) can reach
the similarity only if the terms that it shares with a template hold enough of the template's vector: it needs one of the
heaviest terms, and as many different terms as the heaviest ones that are together long enough. A unit whose other terms weigh too much against those of templates reaches it
neither. Texts and units that fail this are set aside before any term is exploded or shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Licence statements as they stand in file headers, paragraphs of headers and licence texts, and titles.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
]

# A line without letters and digits ends a paragraph.
GAP = r"\n[^A-Za-z0-9\n]*\n"
# How a comment line starts: # // /* * -- ; % ! <!-- and quotes.
COMMENT = r"^[ \t]*(#|//|/\*|\*|--|;|%|!|<!--|\"\"\"|''')"
# File names whose own licence stands for their directory whatever else they hold.
LICENCE_FILE = r"(?i)/(licen[cs]e|unlicen[cs]e|copying)[^/]*$"

_NOT_TERM = "[^a-z0-9]+"


def _terms_of(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def terms(text: Column) -> Column:
    # The only two characters beyond ASCII whose lower case holds an ASCII letter end a term, as all others do.
    plain = F.replace(F.replace(text, F.lit("\u0130"), F.lit(" ")), F.lit("\u212a"), F.lit(" "))
    return F.array_remove(F.split(F.lower(plain), _NOT_TERM), "")


def _any_of(words: Iterable[str]) -> str:
    """Pattern of texts that hold one of the terms."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(words):
        by_first.setdefault(w[0], []).append(w[1:])
    found = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items())
    return rf"(?i)(?:\A|[^A-Za-z0-9])(?:{found})(?![A-Za-z0-9])"


def scan(
    files: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    *,
    similarity: float = 0.8,
    file_share: float = 0.5,
) -> DataFrame:
    """The rows of (file_id, path, text) as file_id, licence, similarity, n_lines, own, inherited_from.

    A file's own licence is the template nearest to one of its units, at ``similarity`` or more (rounded to 9 digits; ties go to
    the first name). Units are lines, paragraphs and runs of comment lines of two lines and more (so wrapped headers are found, also
    right above code), and the whole text. ``n_lines`` counts lines that match any. A licence file has at least ``file_share`` of its
    terms in units of one sort that match, or has a licence of its own and such a file's name (``LICENCE_FILE``); it stands for its
    directory, the nearest one first by similarity, then name. A file
    without a licence of its own takes that of the nearest directory above it that has one; ``inherited_from`` names it. NULL
    or empty texts have no own licence, NULL paths nothing to inherit; repeated rows are judged alike; no templates, no licences.
    """
    keyed = [(name, Counter(_terms_of(text))) for name, text in templates]
    vocabulary = sorted({t for _, c in keyed for t in c})
    known = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    words = files.select("file_id", "path", "text", terms(F.coalesce("text", F.lit(""))).alias("_terms"))
    # One row per term of a template at most.
    seen = words.select(F.explode(F.array_intersect("_terms", known)).alias("term"))
    df = {r["term"]: r["n"] for r in seen.groupBy("term").agg(F.count("*").alias("n")).collect()}
    total = files.count()

    def weight(df_: int) -> float:
        return math.log((total + 1) / (df_ + 1)) + 1

    idf = {t: weight(df.get(t, 0)) for t in vocabulary}
    shares, heavy, wanted = [], set(), []

    def listed(words: Iterable[str]) -> Column:
        return F.array(*map(F.lit, sorted(words))).cast("array<string>")

    for name, counts in keyed:
        vector = {t: n * idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        if vector:
            # Lists instead of a map: equal lists are equal, so that a stage that is read twice is made once.
            lists = F.array(*map(F.lit, vector)).alias("terms"), F.array(*[F.lit(v / norm) for v in vector.values()]).alias("share")
            shares.append(F.struct(F.lit(name).alias("name"), *lists))
        enough = (similarity * norm) ** 2 * (1 - 1e-8)
        # Without these terms the others cannot hold enough of the template's vector.
        left, first = norm * norm, set()
        for t, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if left < enough:
                break
            first.add(t)
            left -= v * v
        heavy |= first
        reached = 0.0
        for least, v in enumerate(sorted(vector.values(), reverse=True), 1):
            reached += v * v
            if reached >= enough:
                wanted.append(F.struct(listed(first).alias("heavy"), listed(vector).alias("terms"), F.lit(least).alias("least")))
                break
    pattern = _any_of(heavy)

    def has_heavy(text: Column) -> Column:
        return text.rlike(pattern) if heavy else F.lit(False)

    def can_reach(unit: Column) -> Column:
        # Bound once: the shared terms, then compared with each template's.
        shared = F.array(F.array_intersect(unit, known))
        many = F.transform(
            shared,
            lambda own: F.exists(
                F.array(*wanted),
                lambda t: F.arrays_overlap(own, t["heavy"]) & (F.size(F.array_intersect(t["terms"], own)) >= t["least"]),
            ),
        )
        return many[0] if wanted else F.lit(False)

    def light_enough(unit: str) -> Column:
        # No dot product is above the length of the part in terms of templates, and the rest weighs at least as if no term came twice.
        found = F.array(F.filter(unit, lambda t: t.isin(vocabulary)))
        idfs = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])

        def fits(own: Column) -> Column:
            def square(t: Column) -> Column:
                v = (F.size(own) - F.size(F.array_remove(own, t))) * F.try_element_at(idfs, t)
                return v * v

            inside = F.aggregate(F.array_distinct(own), F.lit(0.0), lambda total, t: total + square(t))
            outside = (F.size(unit) - F.size(own)) * F.lit(weight(0) ** 2)
            return inside >= similarity**2 * (1 - 1e-8) * (inside + outside)

        return F.transform(found, fits)[0] if vocabulary else F.lit(False)

    def nearest_template(unit: str) -> Column:
        """The smallest of (-cosine, name) over the templates that are near enough, else NULL."""
        if not vocabulary:
            return F.lit(None).cast("struct<c:double,name:string>")
        idfs = F.array(*[F.lit(idf[t]) for t in vocabulary])

        def times(words: Column, t: Column) -> Column:
            return F.size(words) - F.size(F.array_remove(words, t))

        own, rest = F.filter(unit, lambda t: t.isin(vocabulary)), F.filter(unit, lambda t: ~t.isin(vocabulary))
        bound = F.array(F.struct(own.alias("own"), rest.alias("rest")))
        weighed = F.transform(
            bound,
            lambda u: F.struct(
                F.transform(
                    F.array_distinct(u["own"]), lambda t: F.struct(t.alias("term"), (times(u["own"], t) * F.get(idfs, F.array_position(known, t).cast("int") - 1)).alias("v"))
                ).alias("terms"),
                F.aggregate(
                    F.array_distinct(u["rest"]), F.lit(0.0), lambda total, t: total + F.pow(times(u["rest"], t) * F.lit(weight(0)), F.lit(2.0))
                ).alias("outside"),
            ),
        )

        def cosines(u: Column) -> Column:
            norm = F.aggregate(u["terms"], u["outside"], lambda total, w: total + w["v"] * w["v"])
            return F.transform(
                F.array(F.sqrt(norm)),
                lambda length: F.transform(
                    F.array(*shares),
                    lambda t: F.struct(
                        (-F.round(
                            F.aggregate(
                                u["terms"],
                                F.lit(0.0),
                                lambda total, w: total + w["v"] * F.coalesce(F.get(t["share"], F.array_position(t["terms"], w["term"]).cast("int") - 1), F.lit(0.0)),
                            )
                            / length,
                            9,
                        )).alias("c"),
                        t["name"].alias("name"),
                    ),
                ),
            )[0]

        near = F.filter(F.transform(weighed, cosines)[0], lambda t: (t["c"] <= -similarity) & (t["c"] < 0))
        return F.array_min(near)

    hopeful = files.where(has_heavy(F.col("text"))).select(F.xxhash64("path", "file_id", "text").alias("key"), "text")
    # Lines are numbered from 0, the whole text is -1, paragraphs have even numbers from -2 down, runs of comment lines odd ones from -3.
    remarks = F.array_join(F.transform(F.split("text", "\n"), lambda l: F.when(l.rlike(COMMENT), l).otherwise("")), "\n")

    def numbered(parts: Column, first: int, step: int) -> Column:
        return F.transform(parts, lambda u, k: F.struct((first + step * k).cast("int").alias("line"), u.alias("unit")))

    blocks = [
        F.filter(numbered(F.split(text, GAP), first, -2), lambda u: u["unit"].contains("\n"))
        for first, text in ((-2, F.col("text")), (-3, remarks))
    ]
    whole = F.array(F.struct(F.lit(-1).alias("line"), F.col("text").alias("unit")))
    # In one expression, so that each step sees what the one before left, and nothing is worked out twice: filters of exploded rows
    # would be merged and repeat what they read. Only units with a heavy term are cut into terms.
    parts = F.concat(numbered(F.split("text", "\n"), 0, 1), whole, *blocks)
    cut = F.transform(
        F.filter(parts, lambda u: has_heavy(u["unit"])), lambda u: F.struct(u["line"].alias("line"), terms(u["unit"]).alias("terms"))
    )
    left_over = F.filter(cut, lambda u: can_reach(u["terms"]))
    judged_text = F.transform(
        F.array(left_over),
        lambda units: F.struct(F.when(F.size(units) > 0, F.size(terms(F.col("text")))).alias("n_terms"), units.alias("units")),
    )
    units = hopeful.select("key", F.explode(judged_text).alias("found"))
    units = units.select("key", "found.n_terms", F.explode("found.units").alias("part"))
    units = units.select("key", "n_terms", "part.line", F.col("part.terms").alias("_terms"))
    # A unit's terms stay in its row: however many files hold the same unit, no term is a row of its own.
    scored = units.where(light_enough("_terms")).select("key", "n_terms", "line", F.size("_terms").alias("n"), nearest_template("_terms").alias("best"))
    # Both sizes follow from key and line; as keys they stay in both readings of the stage, which is then made once.
    best = scored.dropDuplicates(["key", "line", "n_terms", "n"]).where("best is not null")
    line = F.col("line")
    sorts = [line >= 0, line == -1, (line < -1) & (line % 2 == 0), (line < -1) & (line % 2 != 0)]
    own = best.groupBy("key", "n_terms").agg(
        F.min("best").alias("best"),
        F.count(F.when(F.col("line") >= 0, 1)).alias("n_lines"),
        F.greatest(*[F.sum(F.when(sort, F.col("n")).otherwise(0)) for sort in sorts]).alias("n_matched"),
    )

    directory = F.nullif(F.regexp_replace("path", "/[^/]*$", ""), F.col("path"))
    keyed_files = words.select(
        F.xxhash64("path", "file_id", "text").alias("key"),
        "file_id",
        directory.alias("directory"),
        F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)).alias("named"),
    )
    judged = keyed_files.join(own, "key", "left")
    stands = judged.where(F.col("best").isNotNull() & (F.col("named") | (F.col("n_matched") >= file_share * F.col("n_terms"))))
    stands = stands.where("directory is not null")
    given = stands.groupBy("directory").agg(F.min("best").alias("given"))
    # Every directory with those above it; the longest that gives a licence is the nearest.
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    climbed = keyed_files.select("directory").where("directory is not null").distinct().select(
        "directory", F.explode(above).alias("ancestor")
    )
    nearest = (
        climbed.join(given.withColumnRenamed("directory", "ancestor"), "ancestor")
        .groupBy("directory")
        .agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "given")).alias("from"))
    )
    return judged.join(nearest, "directory", "left").select(
        "file_id",
        F.coalesce("best.name", "from.given.name").alias("licence"),
        F.coalesce(-F.col("best.c"), -F.col("from.given.c")).alias("similarity"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.col("best").isNotNull().alias("own"),
        F.when(F.col("best").isNull(), F.col("from.ancestor")).alias("inherited_from"),
    )
