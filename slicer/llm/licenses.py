"""Licence notices in documents, by the Dice coefficient over word bigrams.

Texts are normalised to words of lower-case letters and digits. A template of n words is compared with windows of n
words of a document, wherever they stand in lines and paragraphs (cut at the document's ends). A window of a distinct bigrams
and a template of b reach a Dice coefficient of t only if t / (2 - t) <= a / b <= (2 - t) / t, so windows out of these
size bounds are never compared, and they share more than b - t / (2 - t) * b of any such number of the template's
bigrams: of its longest ones, its marks, one at least. So only the windows are compared that
have one of the marks at the same place as the template, and documents without any mark are done
after one regular expression. Everything is DataFrame functions within one row: nothing is exploded or shuffled.

Of overlapping matches only those count that no better one (more shared bigrams, then higher Dice, then first in the alphabet)
overlaps, first among the windows of one template, then among those left of all, so that a notice that resembles two licences, or contains another, is listed under its own.

Defined results: null and empty texts have no words; a document without a match has a null license,
dice 0.0 and no matches; ties go to the license that is first in the alphabet; texts of any length are read whole; repeated
rows are judged each; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU_OLD = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."


def _gnu(kind: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details."


#: Texts, standard headers and usual short notices, by SPDX identifier.
TEMPLATES = [
    ("AGPL-3.0", _gnu("GNU Affero General Public License")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD_CLAUSES} {_BSD_DISCLAIMER}"),
    ("BSD-2-Clause", _BSD_CLAUSES),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{_BSD_CLAUSES} {_BSD_THIRD} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_CLAUSES} {_BSD_THIRD}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU_OLD),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu("GNU General Public License")),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu("GNU Lesser General Public License")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
]


def normalised(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def bigrams(words: list[str]) -> list[str]:
    """Distinct word bigrams in order; a single word stands for itself."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] or words[:1]
    return list(dict.fromkeys(pairs))


def marks(words: list[str], least: float) -> list[tuple[str, int]]:
    """(bigram, place) of the longest bigrams of a template, enough that a match has one of them."""
    grams = bigrams(words)
    chosen = set(sorted(grams, key=lambda g: (-len(g), g))[: int(len(grams) - least / (2 - least) * len(grams) + 1e-9) + 1])
    return [(g, i) for i in range(max(1, len(words) - 1)) if (g := " ".join(words[i : i + 2])) in chosen]


def pattern(grams: list[str]) -> str:
    """A regular expression of any of some bigrams, by their first words, in text of words between single spaces."""
    by_first: dict[str, list[str]] = {}
    for g in sorted(set(grams)):
        first, _, second = g.partition(" ")
        by_first.setdefault(first, []).append(second)
    letters: dict[str, list[str]] = {}
    for first, seconds in by_first.items():
        letters.setdefault(first[0], []).append(f"{first[1:]} (?:{'|'.join(seconds)}) " if all(seconds) else f"{first[1:]} ")
    return f" (?:{'|'.join(f'{c}(?:{chr(124).join(rest)})' for c, rest in letters.items())})"


_PAIRS = "array_distinct(if(size(x.w) < 2, x.w, zip_with(slice(x.w, 1, greatest(size(x.w) - 1, 0)), slice(x.w, 2, greatest(size(x.w) - 1, 0)), (a, b) -> concat_ws(' ', a, b))))"


def _matches(name: str, text: str, least: float) -> Column:
    """Array of struct(shared, minus, name, start, end), the first two negative: the windows of ``words`` that match a template.

    ``at`` has the bigram that begins with each word. As SQL text, because building the same from a call for each part takes seconds.
    """
    template = normalised(text)
    grams, n, slack = bigrams(template), len(template), 1e-9
    b, escaped = len(grams), name.replace("\\", "\\\\").replace("'", "\\'")
    places: dict[str, list[int]] = {}
    for g, i in marks(template, least):
        places.setdefault(g, []).append(i)
    hits = f"filter(transform(at, (g, i) -> struct(i AS i, try_element_at(from_json('{json.dumps(places)}', 'map<string,array<int>>'), g) AS p)), h -> h.p IS NOT NULL)"
    starts = f"array_distinct(flatten(transform({hits}, h -> transform(h.p, q -> h.i - q))))"
    bounds = f"transform({starts}, s -> struct(greatest(s, 0) AS start, least(s + {n}, size(words)) AS end))"
    sliced = f"transform({bounds}, w -> struct(w.start AS start, w.end AS end, slice(words, w.start + 1, w.end - w.start) AS w))"
    windows = f"transform({sliced}, x -> struct(x.start AS start, x.end AS end, {_PAIRS} AS g))"
    cut = f"filter({windows}, w -> size(w.g) >= {b * least / (2 - least) - slack} AND size(w.g) <= {b * (2 - least) / least + slack})"
    shared = f"transform({cut}, w -> struct(-size(array_intersect(w.g, split('{'|'.join(grams)}', '[|]'))) AS shared, size(w.g) + {b} AS total, w.start AS start, w.end AS end))"
    scored = f"transform({shared}, m -> struct(m.shared AS shared, 2.0D * m.shared / m.total AS minus, '{escaped}' AS name, m.start AS start, m.end AS end))"
    return F.expr(f"filter({scored}, m -> m.minus <= -{least}D)")


def _best(found: str) -> str:
    """Matches that no better one overlaps."""
    return f"filter({found}, m -> NOT exists({found}, o -> o.start < m.end AND m.start < o.end AND o < m))"


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, least: float = 0.8) -> DataFrame:
    """doc_id, license (the best match's), dice, licenses (all that match), n_matches (windows that match) of every row."""
    grams = [g for _, text in templates for g, _ in marks(normalised(text), least)]
    clean = F.regexp_replace(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), r"[^a-z0-9]+", " ")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(" "), F.trim(clean), F.lit(" ")).alias("clean"))
    words = F.when(F.col("clean").rlike(pattern(grams)), F.split(F.trim("clean"), " "))  # null without a mark
    rows = rows.select("doc_id", words.alias("words"))
    bigram_at = "transform(words, (w, i) -> concat_ws(' ', w, try_element_at(words, i + 2)))"
    rows = rows.select("doc_id", "words", F.expr(bigram_at).alias("at"))
    # a column each, so that what is used twice is computed once
    found = {f"m{k}": _matches(name, text, least) for k, (name, text) in enumerate(templates)}
    rows = rows.select("doc_id", "words", *[F.when(F.col("words").isNotNull(), m).alias(c) for c, m in found.items()])
    nothing = "cast(array() AS array<struct<shared:int,minus:double,name:string,start:int,end:int>>)"
    rows = rows.selectExpr("doc_id", f"if(words IS NOT NULL, concat({', '.join(_best(c) for c in found)}), {nothing}) AS all")
    rows = rows.selectExpr("doc_id", f"{_best('all')} AS all")
    best = F.array_min("all")
    return rows.select("doc_id", best["name"].alias("license"), F.coalesce(-best["minus"], F.lit(0.0)).alias("dice"), F.array_sort(F.array_distinct(F.transform("all", lambda m: m["name"]))).alias("licenses"), F.size("all").cast("long").alias("n_matches"))
