"""Licence scans: Dice coefficient of word bigrams against licence templates, with DataFrame functions only.

A text is lower-cased, everything but letters, digits and line ends becomes one space, and its lines, paragraphs and the
text as a whole are segments. Let a and b be the numbers of distinct word bigrams of a segment and a template. A Dice
coefficient 2 * shared / (a + b) of t needs b * t / (2 - t) <= a <= b * (2 - t) / t, and needs so many shared bigrams
that at least one of the template's first b - shared + 1 bigrams, in any order, is among them. So a
segment meets only those templates of which it has such a bigram and a fitting size; their coefficient is then exact.

Bigrams are looked for in the order of their longest words, so a text without any of these words, as nearly all are, is
left out before it is cut into segments.
"""

from __future__ import annotations

from collections.abc import Sequence

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import common

#: Least Dice coefficient, in hundredths.
LEAST = 80
#: Names and wordings of public licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: The texts of short public licences, paragraph by paragraph. A licence's whole text and each of its paragraphs are templates.
FULL = (
    ("MIT", (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    )),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    )),
    ("BSD-2-Clause", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    )),
    ("BSD-3-Clause", (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    )),
    ("Zlib", (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "3. This notice may not be removed or altered from any source distribution.",
    )),
    ("BSL-1.0", (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    )),
    ("Unlicense", (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    )),
)
TEMPLATES += tuple(dict.fromkeys((name, text) for name, parts in FULL for text in ("\n\n".join(parts), *parts) if (name, text) not in TEMPLATES))


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams in order."""
    w = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def size_bounds(b: int, least: int = LEAST) -> tuple[int, int]:
    """The numbers of bigrams that a segment can have to reach the least coefficient with a template of b."""
    return -(-b * least // (200 - least)), b * (200 - least) // least


def _rows(templates: Sequence[tuple[str, str]], least: int) -> list[tuple]:
    """(template number, name, bigram to look for, fewest, most, all bigrams) of the templates' first bigrams."""
    out = []
    for k, (name, text) in enumerate(templates):
        grams = bigrams(text)
        fewest, most = size_bounds(len(grams), least)
        shared = -(-least * (len(grams) + fewest) // 200)
        for g in sorted(grams, key=lambda g: (-len(_longest(g)), g))[: len(grams) - shared + 1]:
            out.append((k, name, g, fewest, most, grams))
    return out


def _longest(gram: str) -> str:
    """The longer word of a bigram, the first of equal ones."""
    return max(gram.split(), key=len)


def matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: int = LEAST) -> DataFrame:
    """(doc_id, segment, template, licence, dice) of all segments that reach the least coefficient with a template.

    segment is the number of the segment among the text's distinct ones. Null and empty texts have no segments.
    """
    rows = _rows(templates, least)
    table = docs.sparkSession.createDataFrame(rows, "template int, licence string, gram string, fewest int, most int, grams array<string>")
    fewest, most = min(r[3] for r in rows), max(r[4] for r in rows)
    marks = F.array(*[F.lit(w) for w in sorted({_longest(r[2]) for r in rows})])
    looked_for = F.array(*[F.lit(g) for g in sorted({r[2] for r in rows})])
    clean = docs.select("doc_id", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ").alias("text"))
    clean = clean.where(F.arrays_overlap(F.split("text", "[ \\n]"), marks))
    segments = clean.select("doc_id", F.posexplode(F.expr("array_distinct(concat(array(text), split(text, '\\n'), split(text, '\\n *\\n')))")).alias("segment", "text"))
    worded = segments.select("doc_id", "segment", F.expr("split(trim(BOTH ' \\n' FROM text), '[ \\n]+')").alias("words"))
    worded = worded.where(F.size("words") > fewest)
    pairs = worded.select("doc_id", "segment", F.expr("array_distinct(zip_with(slice(words, 1, size(words) - 1), slice(words, 2, size(words)), (a, b) -> concat(a, ' ', b)))").alias("own"))
    pairs = pairs.where(F.size("own").between(fewest, most)).select("doc_id", "segment", "own", F.explode(F.array_intersect("own", looked_for)).alias("gram"))
    found = pairs.join(F.broadcast(table), "gram").where("size(own) BETWEEN fewest AND most")  # the templates: a fixed list
    dice = F.expr("2e0 * size(array_intersect(own, grams)) / (size(own) + size(grams))")
    return found.select("doc_id", "segment", "template", "licence", dice.alias("dice")).where(f"100 * dice >= {least}").distinct()


def licences(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: int = LEAST) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, licence of the best match (ties: first by name), its dice, and n_segments that match.

    licence and dice are null and n_segments 0 where nothing matches, also for null and empty texts. Rows of equal
    doc_id share their matches; an empty table gives no rows; other columns are ignored.
    """
    best = matches(docs, templates, least).groupBy("doc_id").agg(F.min(F.struct((-F.col("dice")).alias("order"), "licence")).alias("best"), F.countDistinct("segment").alias("n"))
    best = best.select("doc_id", F.col("best.licence").alias("licence"), F.round(-F.col("best.order"), 6).alias("dice"), F.col("n").alias("n_segments"))
    return docs.select("doc_id").join(best, "doc_id", "left").fillna(0, ["n_segments"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(common.table(spark, sf_dir, "documents"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(f"({_literal(name)}, [{', '.join(map(_literal, bigrams(text)))}], {size_bounds(len(bigrams(text)))[0]}, {size_bounds(len(bigrams(text)))[1]})" for name, text in TEMPLATES)
#: The same by comparing every segment with every template of a size that can reach the coefficient.
SQL = f"""
WITH template AS (SELECT * FROM (VALUES {_VALUES}) AS x(licence, grams, fewest, most)),
clean AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL),
segment AS (SELECT doc_id, unnest(list_distinct(list_concat([text], string_split(text, chr(10)), regexp_split_to_array(text, '\\n *\\n')))) AS text FROM clean),
worded AS (SELECT doc_id, text, regexp_split_to_array(trim(text, chr(32) || chr(10)), '[ \\n]+') AS w FROM segment),
own AS (SELECT doc_id, text, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS own FROM worded WHERE len(w) > 2),
scored AS (SELECT doc_id, text, licence, 2e0 * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM own JOIN template ON len(own) BETWEEN fewest AND most),
hit AS (SELECT * FROM scored WHERE 100 * dice >= {LEAST}),
best AS (SELECT doc_id, min({{'a': -dice, 'b': licence}}) AS best, count(DISTINCT text) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, best.b AS licence, round(-best.a, 6) AS dice, CAST(coalesce(n, 0) AS BIGINT) AS n_segments FROM documents d LEFT JOIN best USING (doc_id)
"""
