"""Licence scan: text units against licence templates by the Dice coefficient of word bigrams.

DataFrame functions only.  A text's units are its sentences, its lines and, if
it is short enough for any template, the whole.  Besides, as notices are wrapped
and stand between other text, whole licences among it, windows of as many words as a template has are
units as well, a sixteenth of their length apart; one that matches counts if no
better match has any of its words.  Case, punctuation, comment
marks and spacing don't count, nor the British spelling of licence.  With a
coefficient of t, sets of sizes a and b can only match if both sizes are within
t / (2 - t) of one another; so a unit is cut into bigrams only if some template
has a size like its number of words, and is compared with templates of such
sizes alone.  Every match has one of a few words, the hooks; texts without any
go at once, and windows stand around hooks alone.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

# Notices by which works state their licence, and the licences they state.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)

# Common English words, which make poor hooks.
_COMMON = frozenset("a all an and any as at be by can for from has in is it not of on or other that the this to under use was with without you".split())

#: Where a text parts into sentences, and what isn't a word; the same in Java's and RE2's syntax.
SENTENCE = r"[.!?][ \t\r]+|[\r\n]+"
LINE = r"[\r\n]+"
NO_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def normalise(text: str) -> list[str]:
    """The words of a template."""
    return [w.replace("licence", "license") for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", text.lower()) if w]


def templates(rows=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, list[str], int, int, int]]:
    """Licence, distinct bigrams, the least and greatest size of a set that can match, and the template's words."""
    out = []
    for name, text in rows:
        w = normalise(text)
        grams = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
        if grams:
            n = len(grams)
            out.append((name, grams, math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9), len(w)))
    return out


def windows(known) -> list[tuple[int, int]]:
    """Words in a window, and how many words apart windows begin, for each length of a template."""
    return sorted({(n, max(1, n // 16)) for *_, n in known})


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rows=TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, n_units): the licences that each document states.

    dice is the best coefficient, rounded to 6 places, and n_units the number of
    distinct sentences, lines and whole texts that match one of the licence's
    templates best, 1 if windows alone do; of equally good licences, a unit counts
    for the first in the alphabet.  A document that states none, among them null
    and empty ones, has no row.  Rows of one id (null too) count as one document.
    Other columns are ignored.
    """
    known = templates(rows, threshold)
    if not known:
        raise ValueError("no template has two words")
    least, most = min(t[2] for t in known), max(t[3] for t in known)
    # each explode is a barrier that expressions aren't moved across, so that none of them is evaluated twice
    words = hooks(known, threshold)
    short = "|".join(w for w in words if len(w) <= 4)
    spelt = {x for w in words if len(w) > 4 for x in (w, w.replace("license", "licence"))}
    spelt = sorted(w for w in spelt if not any(x in w for x in spelt if x != w))
    docs = docs.select(F.col(id_col).alias("__id"), F.explode(F.array(F.lower(F.col(text_col).cast("string")))).alias("low"))
    # whole texts first: one without any hook has no unit with one
    text = F.col("low")
    docs = docs.where(reduce(lambda a, b: a | b, [*(F.contains(text, F.lit(w)) for w in spelt), *([text.rlike(rf"\b({short})\b")] if short else [])]))

    def plain(u):
        return F.trim(F.replace(F.regexp_replace(u, NO_WORD, F.lit(" ")), F.lit("licence"), F.lit("license")))

    def bigrams(w):
        return F.zip_with(w, F.slice(w, 2, F.size(w)), lambda x, y: F.concat(x, F.lit(" "), y))

    table = F.broadcast(docs.sparkSession.createDataFrame([k[:4] for k in known], "license string, t array<string>, lo int, hi int"))

    def matches(units, *keys):
        """(keys, g, license, d) of units (keys, w): as sets of bigrams, of those sizes that some template can match, and each one's best."""
        sets = units.select(*keys, F.explode(F.array(F.sort_array(F.array_distinct(F.array_compact(bigrams(F.col("w"))))))).alias("g")).withColumn("n", F.size("g"))
        pairs = sets.where(F.col("n").between(least, most)).join(table, F.col("n").between(F.col("lo"), F.col("hi")))
        dice = 2.0 * F.size(F.array_intersect("g", "t")) / (F.col("n") + F.size("t"))
        found = pairs.select(*keys, "g", "license", dice.alias("d")).where(F.col("d") >= threshold - 1e-12)
        best = found.groupBy(*keys, "g").agg(F.min(F.struct((-F.col("d")).alias("m"), "license")).alias("__best"))
        return best.select(*keys, "g", F.col("__best.license").alias("license"), (-F.col("__best.m")).alias("d"))

    units = F.array_distinct(F.transform(F.array_distinct(F.concat(F.split(text, SENTENCE), F.split(text, LINE), F.array(text))), plain))
    hooked = "(^| )(" + "|".join(words) + ")( |$)"
    # a set of n bigrams takes n + 1 words; repeated ones may make more, so words bound it from below alone
    exploded = docs.select("__id", F.explode(units).alias("unit")).where((F.length("unit") >= 2 * least + 1) & F.col("unit").rlike(hooked))
    in_units = matches(exploded.select("__id", F.split("unit", " ").alias("w")), "__id").select("__id", "license", "d", F.lit(False).alias("window"))
    # rows of one id are texts of their own here; where hooks stand, from 0; then windows that hold one, and the last window of the text
    whole = docs.select("__id", F.explode(F.array(F.split(plain(text), " "))).alias("w"))
    whole = whole.select("__id", "w", F.explode(F.array(F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(words)))).alias("at")).where(F.size("at") > 0)
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("s")) for n, s in windows(known)]))
    sized = whole.select("__id", F.xxhash64("w").alias("__text"), "w", "at", sizes.alias("z")).select("__id", "__text", "w", "at", "z.n", "z.s").where(F.size("w") > F.col("n"))
    low = lambda p: F.ceil(F.greatest(p - F.col("n") + 1, F.lit(0)) / F.col("s")).cast("int")
    high = lambda p: F.floor(F.least(p, F.size("w") - F.col("n")) / F.col("s")).cast("int")
    begins = F.flatten(F.transform("at", lambda p: F.when(low(p) <= high(p), F.transform(F.sequence(low(p), F.greatest(low(p), high(p))), lambda i: i * F.col("s"))).otherwise(F.array().cast("array<int>"))))
    begins = F.array_distinct(F.concat(begins, F.array(F.size("w") - F.col("n"))))
    keys = ["__id", "__text", "b", "m"]
    around = sized.select("__id", "__text", "w", F.col("n").alias("m"), F.explode(begins).alias("b")).select(*keys, F.slice("w", F.col("b") + 1, F.col("m")).alias("w"))
    around = matches(around, *keys).select(*keys, "license", "d", F.explode(F.sequence(F.col("b"), F.col("b") + F.col("m") - 1)).alias("p"))
    around = around.withColumn("top", F.max("d").over(Window.partitionBy("__id", "__text", "p")))
    in_windows = around.groupBy(*keys, "license", "d").agg(F.max("top").alias("top")).where("top <= d").select("__id", "license", "d", F.lit(True).alias("window"))
    n = F.greatest(F.count_if(~F.col("window")), F.lit(1)).cast("bigint")
    out = in_units.unionByName(in_windows).groupBy("__id", "license").agg(F.round(F.max("d"), 6).alias("dice"), n.alias("n_units"))
    return out.select(F.col("__id").alias(id_col), "license", "dice", "n_units")


def hooks(known, threshold: float) -> list[str]:
    """Words of which every matching unit has at least one.

    A match shares at least t / (2 - t) of a template's bigrams.  Words are taken, by how many templates still
    lack them, until the bigrams of each template without any of its hooks are fewer than a match needs."""
    need = {i: math.ceil(threshold / (2 - threshold) * len(t[1]) - 1e-9) for i, t in enumerate(known)}
    free = {i: [set(g.split(" ")) for g in t[1]] for i, t in enumerate(known)}
    out: list[str] = []
    while open_ := [i for i in free if len(free[i]) >= need[i]]:
        gain: dict[str, int] = {}
        for i in open_:
            for g in free[i]:
                for w in g:
                    gain[w] = gain.get(w, 0) + (0.001 if w in _COMMON else len(w) if len(w) > 6 else len(w) / 100)  # longer words are rarer
        best = max(sorted(gain), key=gain.__getitem__)
        out.append(best)
        for i in open_:
            free[i] = [g for g in free[i] if best not in g]
    return out


def oracle_sql() -> str:
    """The same scan for DuckDB."""
    known = templates()
    values = ",\n".join(f"('{n}', [{', '.join(repr(g) for g in t)}], {lo}, {hi})" for n, t, lo, hi, _ in known)
    words = ", ".join(f"'{w}'" for w in hooks(known, THRESHOLD))
    sizes = ", ".join(f"({n}, {s})" for n, s in windows(known))

    def plain(u):
        return f"list_filter(string_split(replace(regexp_replace({u}, '{NO_WORD}', ' ', 'g'), 'licence', 'license'), ' '), lambda x: x <> '')"

    return rf"""
        WITH known(license, t, lo, hi) AS (VALUES {values}),
        sizes(n, s) AS (VALUES {sizes}),
        units AS (SELECT DISTINCT doc_id, unnest(list_concat(regexp_split_to_array(lower(text), '{SENTENCE}'), regexp_split_to_array(lower(text), '{LINE}'), [lower(text)])) AS unit FROM documents),
        whole AS (SELECT doc_id, {plain("lower(text)")} AS w FROM documents WHERE text IS NOT NULL),
        hooked AS (SELECT doc_id, w, list_filter(range(0, len(w)), lambda i: list_contains([{words}], w[i + 1])) AS spots FROM whole),
        sized AS (SELECT doc_id, w, n, s, unnest(spots) AS spot FROM hooked, sizes WHERE len(w) > n AND len(spots) > 0),
        begins AS (SELECT DISTINCT doc_id, w, n, unnest(list_append(list_transform(range(CAST(ceil(greatest(spot - n + 1, 0) / CAST(s AS DOUBLE)) AS BIGINT), CAST(floor(least(spot, len(w) - n) / CAST(s AS DOUBLE)) AS BIGINT) + 1), lambda i: i * s), len(w) - n)) AS b FROM sized),
        words AS (SELECT DISTINCT doc_id, -1 AS b, 0 AS n, {plain("unit")} AS w FROM units UNION ALL SELECT doc_id, b, n, w[b + 1 : b + n] FROM begins),
        grams AS (SELECT DISTINCT doc_id, b, n, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words WHERE len(w) > 1),
        found AS (SELECT doc_id, license, b, n, g, 2.0 * len(list_intersect(g, t)) / (len(g) + len(t)) AS d FROM grams JOIN known ON len(g) BETWEEN lo AND hi),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, b, n, g ORDER BY d DESC, license) AS r FROM found WHERE d >= {THRESHOLD} - 1e-12) WHERE r = 1),
        places AS (SELECT doc_id, b, n, license, d, max(d) OVER (PARTITION BY doc_id, p) AS top FROM (SELECT *, unnest(range(b, b + n)) AS p FROM best WHERE b >= 0)),
        kept AS (SELECT doc_id, license, d, false AS win FROM best WHERE b < 0 UNION ALL SELECT doc_id, license, any_value(d), true FROM places GROUP BY doc_id, b, n, license HAVING max(top) <= any_value(d))
        SELECT doc_id, license, round(CAST(max(d) AS DOUBLE), 6) AS dice, greatest(count(*) FILTER (WHERE NOT win), 1) AS n_units FROM kept GROUP BY doc_id, license"""
