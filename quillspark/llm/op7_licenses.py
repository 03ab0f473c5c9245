"""License scans: Dice coefficient over word bigrams, size bounds prune templates.

Only DataFrame functions: no Python, pandas or Arrow code runs on the executors.
"""

from __future__ import annotations

import math
import pathlib
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import text_of

# The six Creative Commons licences.
CREATIVE = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)


def creative_commons(code: str, name: str) -> list[tuple[str, str]]:
    """The short and the full notices of versions 4.0 and 3.0."""
    return [
        (f"CC-{code}-{version}", notice)
        for version, kind in (("4.0", "International"), ("3.0", "Unported"))
        for notice in (f"Licensed under CC {code} {version}.", f"This work is licensed under a Creative Commons {name} {version} {kind} License.", f"Licensed under the Creative Commons {name} {version} license.")
    ]


# The GNU licences.
GNU = (("GPL", "", "2"), ("GPL", "", "3"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3"), ("AGPL", "Affero ", "3"))


def gnu(code: str, kind: str, version: str) -> list[tuple[str, str]]:
    """The one-line notices of a version alone and of it or later ones."""
    full, short = f"GNU {kind}General Public License", version if "." in version else f"{version}.0"
    return [
        (f"{code}-{short}-{granted}", notice.format(of))
        for granted, ends in (("only", ("",)), ("or-later", (" or later", " or any later version")))
        for end in ends
        for of in (f"{full}, version {version}{end}.", f"{full} v{short}{end}.", f"GNU {code} v{version}{end}.")
        for notice in ("Licensed under the {}", "This work is licensed under the {}")
    ]


# Notices by SPDX identifier, as their licences word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", "Licensed under the ISC License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, version 3 of the License.",
    ),
    (
        "GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by "
        "the Free Software Foundation.",
    ),
    (
        "LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    (
        "EPL-1.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
        "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:",
    ),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."),
    *(t for code, name in CREATIVE for t in creative_commons(code, name)),
    *(t for code, kind, version in GNU for t in gnu(code, kind, version)),
)


# SPDX identifiers of whole licences by the names of their files in a folder
# of common licences, as Linux distributions hold them.
FILES = {
    "Apache-2.0": "Apache-2.0",
    "Artistic": "Artistic-1.0-Perl",
    "BSD": "BSD-3-Clause",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3",
    "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}
COMMON_LICENSES = "/usr/share/common-licenses"


def whole_licenses(folder: str = COMMON_LICENSES) -> tuple[tuple[str, str], ...]:
    """The texts of ``FILES`` that ``folder``, a folder of the driver's machine, holds."""
    found = ((name, pathlib.Path(folder, file)) for file, name in FILES.items())
    return tuple((name, path.read_text("utf-8", "replace")) for name, path in found if path.is_file())


# Words of ordinary texts, poor at telling notices from them.
COMMON = frozenset("a an and any are as at be by for from in is it its later may no not of on or that the this to under which with work you".split())
#: Words between two bigrams of templates that one notice can hold.
GAP = 8


def bigrams(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


#: Templates of more bigrams than this are long licences, others are notices.
LONG = 200


def kinds(sets: list[list[str]]) -> list[list[str]]:
    """The bigrams of notices and those of long licences, without those of common words only."""
    of = [sorted({pair for b in sets if (len(b) > LONG) == long for pair in b if not {*pair.split()} <= COMMON}) for long in (False, True)]
    return [k for k in of if k]


def anchors(sets: list[list[str]], threshold: float) -> list[str]:
    """Words of which every match has at least one in a common bigram.

    A match shares c >= threshold*b/(2-threshold) of a template's b bigrams (its own
    set is no smaller than c). Long words, common ones last, are taken until fewer
    bigrams than that are without one of them, so what shares that many shares one
    with such a word. Words taken for smaller templates come first.
    """
    chosen: set[str] = set()
    for b in sorted(sets, key=len):
        needed = math.ceil(threshold * len(b) / (2 - threshold) - 1e-9)
        left = [{*pair.split()} for pair in b if not chosen & {*pair.split()}]
        for w in sorted({w for pair in b for w in pair.split()} - chosen, key=lambda w: (w in COMMON, -len(w), w)):
            if len(left) < needed:
                break
            chosen.add(w)
            left = [pair for pair in left if w not in pair]
    return sorted(chosen)


def lowered(text: Column) -> Column:
    """A-Z lowered. The two letters whose lower case is an ASCII letter are blanked
    first, so that a-z come of A-Z only."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" ")))


def normal(low: Column) -> Column:
    """Of a lowered text, what is other than a-z, 0-9 and line ends as one blank."""
    return F.regexp_replace(low, "[^a-z0-9\n]+", " ")


#: The end of a sentence in a raw text, or of a line.
SENTENCE = "[.;!?][ \t]+|\n"
PARAGRAPH = " ?\n ?\n[ \n]*"


def constant(items: list[str]) -> Column:
    """An array of strings as one literal that the optimizer folds."""
    return F.split(F.lit("\n".join(items)), "\n")


def within(of: list[str]) -> str:
    """SQL for "is one of these", which becomes a look-up in a set."""
    return "IN (" + ", ".join(f"'{x}'" for x in of) + ")"


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] | None = None, threshold: float = 0.75, gap: int = GAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, license, dice, n_segments, licenses.

    ``templates`` are (identifier, text): the notices of ``TEMPLATES`` and the whole
    licences found on the driver's machine unless given. A text's segments are its
    lines, sentences, paragraphs (between blank lines), itself, and its clusters: from
    one bigram of any notice to another, or of any long licence (more than ``LONG``
    bigrams), as long as no more than ``gap`` words lie between two of them, so a notice
    of several paragraphs or within a line of prose is a segment whatever surrounds it. Each segment's set of word bigrams meets the
    templates whose own set is of a size that can reach ``threshold``
    (2*min(a,b) >= threshold*(a+b)); where the Dice coefficient does, it matches.

    Texts without any of the words that every match needs (``anchors``) are passed
    over, and segments with too few bigrams that stand in any template. ``license`` and
    ``dice`` are the best match (ties: the larger template, then the least identifier),
    ``n_segments`` counts matching segments, ``licenses`` is their identifiers, sorted
    and joined by commas. Everything is an expression of one row: no shuffle, join or
    broadcast, and templates are a fixed table in the plan.

    Cases: a null or empty text, or one without bigrams, matches nothing (license and
    dice null, 0, empty string); ids may be null or repeat; an empty table gives an
    empty result; other columns are ignored.
    """
    templates = (*TEMPLATES, *whole_licenses()) if templates is None else templates
    sets = [(name, bigrams(text)) for name, text in templates]
    least, most = min(len(b) for _, b in sets), max(len(b) for _, b in sets)
    low, high = threshold / (2 - threshold) * least, (2 - threshold) / threshold * most
    known = sorted({pair for _, b in sets for pair in b})

    def dice(found: Column) -> Column:
        n = F.size(found)
        tried = [
            F.when(
                F.lit(2.0) * F.least(n, F.lit(len(b))) >= threshold * (n + len(b)),
                F.struct((F.lit(2.0) * F.size(F.array_intersect(found, constant(b))) / (n + len(b))).alias("dice"), F.lit(len(b)).alias("size"), F.lit(name).alias("name")),
            )
            for name, b in sets
        ]
        return F.filter(F.array(*tried), lambda t: t.isNotNull() & (t["dice"] >= threshold))

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))

    words = constant(anchors([b for _, b in sets], threshold))
    no_words, no_texts = F.array().cast("array<string>"), F.array().cast("array<string>")
    rows = docs.select(F.col("doc_id"), lowered(text_of()).alias("low"))
    # other texts are passed over before any costly expression
    rows = rows.select("doc_id", F.when(F.arrays_overlap(F.split("low", "[^a-z0-9]+"), words), F.col("low")).alias("low"))
    rows = rows.select("doc_id", F.coalesce(F.split("low", SENTENCE), no_texts).alias("sentences"), normal(F.col("low")).alias("norm"))
    rows = rows.withColumn("w", F.coalesce(F.filter(F.split("norm", "[ \n]+"), lambda w: w != ""), no_words))
    rows = rows.withColumn("pairs", pairs(F.col("w")))
    of = kinds([b for _, b in sets])
    for k, kind in enumerate(of):  # the places of such bigrams
        rows = rows.withColumn(f"at{k}", F.expr(f"filter(transform(pairs, (p, i) -> CASE WHEN p {within(kind)} THEN i END), i -> i IS NOT NULL)"))

    def clusters(at: str) -> Column:
        begins = F.filter(at, lambda x, i: (i == 0) | (x - F.try_element_at(at, F.greatest(i, F.lit(1))) > gap + 1))
        ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.try_element_at(at, i + 2) - x > gap + 1))
        return F.zip_with(begins, ends, lambda a, b: F.array_join(F.slice("w", a + 1, b - a + 2), " "))

    one_blank = lambda p: F.trim(F.regexp_replace(p, "[ \n]+", " "))
    parts = F.concat(F.transform(F.concat(F.split("norm", "\n"), F.split("norm", PARAGRAPH), F.array("norm"), F.transform("sentences", normal)), one_blank), *[clusters(f"at{k}") for k in range(len(of))])
    rows = rows.select("doc_id", F.when(F.size("w") > 0, F.array_distinct(parts)).otherwise(no_texts).alias("parts"))
    wide = F.filter("parts", lambda s: F.regexp_count(s, F.lit(" ")) >= low)
    sized = F.filter(F.transform(wide, lambda s: F.array_distinct(pairs(F.split(s, " ")))), lambda b: (F.size(b) >= low) & (F.size(b) <= high))
    rows = rows.select("doc_id", sized.alias("sized"))
    # of its bigrams so many stand in any template that one can reach the threshold
    enough = f"{threshold / 2}D * (size(b) + greatest({float(least)}D, {threshold / (2 - threshold)}D * size(b))) - 1e-9D"
    rows = rows.select("doc_id", F.expr(f"filter(sized, b -> size(filter(b, p -> p {within(known)})) >= {enough})").alias("sets"))
    rows = rows.select("doc_id", F.filter(F.transform("sets", dice), lambda m: F.size(m) > 0).alias("m"))
    best = F.array_min(F.transform(F.flatten("m"), lambda t: F.struct((-t["dice"]).alias("d"), (-t["size"]).alias("s"), t["name"].alias("name"))))
    return rows.select(
        "doc_id",
        best["name"].alias("license"),
        (-best["d"]).alias("dice"),
        F.size("m").cast("long").alias("n_segments"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.flatten("m"), lambda t: t["name"]))), ",").alias("licenses"),
    )


def scan_licenses_sql(templates: tuple[tuple[str, str], ...] | None = None, threshold: float = 0.75, gap: int = GAP) -> str:
    """The same scan for DuckDB, without passing anything over."""
    templates = (*TEMPLATES, *whole_licenses()) if templates is None else templates
    sets = [(name, bigrams(text)) for name, text in templates]
    rows = ",\n".join(f"('{name}', [{', '.join(repr(b) for b in found)}])" for name, found in sets)
    strong = ", ".join(f"({k}, '{pair}')" for k, kind in enumerate(kinds([b for _, b in sets])) for pair in kind)
    clean = lambda x: f"regexp_replace(translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^a-z0-9\n]+', ' ', 'g')"
    return f"""
        WITH t(name, tb) AS (VALUES {rows}),
        k(kind, pair) AS (VALUES {strong}),
        n AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS raw, {clean("coalesce(text, '')")} AS x FROM documents),
        a AS (SELECT r, list_filter(string_split_regex(x, '[ \n]+'), lambda v: v <> '') AS w FROM n),
        i AS (SELECT r, w, unnest(range(1, len(w))) AS i FROM a),
        h AS (SELECT r, kind, i, lag(i) OVER (PARTITION BY r, kind ORDER BY i) AS before FROM i JOIN k ON k.pair = w[i] || ' ' || w[i + 1]),
        g AS (SELECT r, kind, i, sum(CASE WHEN i - before <= {gap + 1} THEN 0 ELSE 1 END) OVER (PARTITION BY r, kind ORDER BY i) AS g FROM h),
        c AS (SELECT r, array_to_string(w[a:b + 1], ' ') AS s FROM (SELECT r, min(i) AS a, max(i) AS b FROM g GROUP BY r, kind, g) JOIN a USING (r)),
        p AS (SELECT r, unnest(string_split(x, chr(10)) || string_split_regex(x, '{PARAGRAPH}') || [x]) AS s FROM n
              UNION ALL SELECT r, {clean("s")} FROM (SELECT r, unnest(string_split_regex(raw, '{SENTENCE}')) AS s FROM n)
              UNION ALL SELECT r, s FROM c),
        s AS (SELECT DISTINCT r, trim(regexp_replace(s, '[ \n]+', ' ', 'g')) AS s FROM p),
        w AS (SELECT r, s, string_split(s, ' ') AS w FROM s),
        b AS (SELECT r, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b, s FROM w WHERE len(w) > 1),
        d AS (SELECT r, s, name, len(tb) AS size, 2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice
              FROM b JOIN t ON 2.0::DOUBLE * least(len(b), len(tb)) >= {threshold}::DOUBLE * (len(b) + len(tb))),
        m AS (SELECT r, first(name ORDER BY dice DESC, size DESC, name) AS license, max(dice) AS dice, count(DISTINCT s) AS n_segments,
                     string_agg(DISTINCT name, ',' ORDER BY name) AS licenses
              FROM d WHERE dice >= {threshold}::DOUBLE GROUP BY r)
        SELECT doc_id, license, dice, coalesce(n_segments, 0) AS n_segments, coalesce(licenses, '') AS licenses
        FROM n LEFT JOIN m USING (r)
    """
