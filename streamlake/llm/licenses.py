"""Licence notices in documents, by the Dice coefficient of word bigrams with licence templates."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlake.llm.decontaminate import let

# Public licence notices and short licence texts, by identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "This project is licensed under the terms of the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the "
                     "LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                     "License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or "
                "neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                "the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in "
            "all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
                "of the MPL was not distributed with this file, You can obtain one at "
                "http://mozilla.org/MPL/2.0/."),
)
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK_LINE = r"\n[ \t\r]*\n"
SENTENCE_END = r"[.!?][ \t]+"

LEAST_DICE = 0.8


def words_of(text: Column) -> Column:
    """Lower-case words: letters and digits, without punctuation."""
    return F.filter(F.split(F.lower(text), NO_WORD), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n),
                                       lambda a, b: F.concat_ws(" ", a, b)))


def template_table(spark, templates) -> list[tuple[str, list[str]]]:
    """Templates with their bigrams, by the same expression as the documents'."""
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(templates)], "i int, text string")
    found = rows.select("i", bigrams(words_of(F.col("text"))).alias("b")).orderBy("i").collect()
    return [(templates[r["i"]][0], r["b"]) for r in found]


def telling_words(known: list[tuple[str, list[str]]], least: float) -> list[str]:
    """Words of which every matching passage holds one.

    A passage that reaches the coefficient has ``least / (2 - least)`` of a template's bigrams at least,
    so of any larger number than may be missing it has one. For each template that many bigrams are
    taken, each with one of its words, those first that serve many templates.
    """
    serves: dict[str, int] = {}
    for _, pairs in known:
        for word in {w for pair in pairs for w in pair.split(" ")}:
            serves[word] = serves.get(word, 0) + len(word)
    chosen = set()
    for _, pairs in known:
        missing = len(pairs) - math.ceil(least * len(pairs) / (2 - least) - 1e-9)
        words = sorted((max(pair.split(" "), key=lambda w: (len(w) > 4, serves[w], w)) for pair in pairs),
                       key=lambda w: (len(w) > 4, serves[w], w), reverse=True)
        chosen.update(words[:missing + 1])
    return sorted(w for w in chosen if not any(o != w and o in w for o in chosen))


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST_DICE,
         keep: str = "doc_id") -> DataFrame:
    """Licence notices of ``docs (text)``: ``keep`` (a column passed on), ``matches``.

    A passage is a line, a sentence of a line, a paragraph between blank lines, or the whole text. It
    matches the template with which the Dice coefficient of their distinct word bigrams is highest, the
    first by name of equals, if that is ``least`` or more. ``matches`` holds ``(dice, license, words)`` of
    every distinct matching passage, ``words`` in normal form, best first, then by name. Only templates whose number of bigrams can reach the coefficient with
    the passage's are compared: twice the smaller number over the sum is its bound. Null, empty and
    wordless texts match nothing; repeated rows get equal results; other columns are ignored.

    A scan and nothing else: no row leaves its task. The templates are constants of the plan. A text
    without any of the ``telling_words`` holds no match and is not taken apart.
    """
    known = template_table(docs.sparkSession, templates)
    most = max(int(len(b) * (2 - least) / least) for _, b in known)
    # For each number of bigrams of a passage, the templates it can match.
    fitting = F.array(*(F.array(*(F.lit(i) for i, (_, b) in enumerate(known)
                                  if n and 2 * min(n, len(b)) >= least * (n + len(b))))
                        .cast("array<int>") for n in range(most + 1)))
    sets = F.array(*(F.array(*map(F.lit, b)) for _, b in known))
    sizes = F.array(*(F.lit(len(b)) for _, b in known))
    names = F.array(*(F.lit(name) for name, _ in known))

    def compared(words: Column) -> Column:
        def with_pairs(pairs: Column) -> Column:
            candidates = F.when(F.size(pairs) <= most, F.element_at(fitting, F.size(pairs) + 1)).otherwise(
                F.array().cast("array<int>"))

            def against(i: Column) -> Column:
                common = F.size(F.array_intersect(pairs, F.element_at(sets, i + 1)))
                dice = 2.0 * common / (F.size(pairs) + F.element_at(sizes, i + 1))
                return F.struct((-dice).alias("rank"), F.element_at(names, i + 1).alias("license"),
                                F.array_join(words, " ").alias("words"))

            best = F.array_min(F.transform(candidates, against))
            return let(best, lambda m: F.when(m["rank"] <= -least, m))

        return let(bigrams(words), with_pairs)

    text = F.coalesce(F.col("text"), F.lit(""))

    def passages(lines: Column) -> Column:
        by_line = F.transform(lines, words_of)
        sentences = F.flatten(F.transform(
            F.filter(lines, lambda x: x.rlike(r"[.!?][ \t]")), lambda x: F.split(x, SENTENCE_END)))
        paragraphs = F.when(text.rlike(BLANK_LINE), F.split(text, BLANK_LINE)).otherwise(
            F.array().cast("array<string>"))

        def joined(found: Column) -> Column:
            return F.concat(found, F.transform(F.concat(sentences, paragraphs), words_of),
                            F.array(F.flatten(found)))

        return let(by_line, joined)

    some = F.filter(let(F.split(text, "\n"), passages), lambda w: F.size(w) > 1)
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(some, compared))))
    lower = F.lower(text)
    possible = reduce(or_, (lower.contains(w) for w in telling_words(known, least)))
    none = F.array().cast("array<struct<rank:double,license:string,words:string>>")
    rows = docs.select(keep, F.explode(F.array(F.when(possible, found).otherwise(none))).alias("found"))
    return rows.select(keep, F.transform("found", lambda m: F.struct(
        (-m["rank"]).alias("dice"), m["license"].alias("license"), m["words"].alias("words"))).alias("matches"))
