"""License scan (native: SQL functions only).

Texts are folded to lower-case words of letters and digits. Overlapping windows of `window` five-word shingles, half a
window apart, get MinHash signatures of `bands` bands of one row; templates are indexed by the signatures of all their
windows. A window that lies in an unchanged copy equals a template window, so its bands collide for certain; a copy of
a template of 32 shingles or more with a fifth of its shingles changed has a window of Jaccard similarity 0.66 or more,
which shares one of 8 bands with probability 1 - 0.34^8 > 0.9998. Templates of fewer shingles are retrieved by windows
of one shingle, whose minimum is the shingle's own hash and cannot miss. What is retrieved is verified exactly: the share of the template's shingles that the
whole text holds must reach 0.8.

The template index goes along with the plan as a set of literals while it has `MAX_KEYS` keys at most: looking a key up
takes the same time whatever the number of templates. A larger index stays a table: the rows' shingles are stored, their
keys exploded and joined with it, and the rows that share a key with a template read again.

Defined results: null and empty texts, and texts under five words, match nothing; very long texts are read whole; a template of fewer than five words
is refused; repeated rows match alike; an empty table gives an empty table; further columns pass through, those named
like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED_WORD, materialise, once

#: Statements of license as they stand in files and pages, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("WTFPL", "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
WINDOW, STEP, BANDS, SHORT, CONTAINMENT = 16, 8, 8, 32, 0.8
#: Keys of the template index up to which it goes along with the plan.
MAX_KEYS = 20_000

_WORDS = "regexp_extract_all(lower({t}), '" + FOLDED_WORD.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}") + "', 0)"
_SHINGLES = "case when size({w}) < 5 then cast(array() as array<bigint>) else transform(sequence(0, size({w}) - 5), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2], {w}[i + 3], {w}[i + 4])) end"


def _blocks(shingles: str, band: int) -> str:
    """SQL: the band's minima of blocks of half a window, so that each shingle is hashed once a band."""
    return f"transform(sequence(0, greatest((size({shingles}) - 1) div {STEP}, 0)), i -> array_min(transform(slice({shingles}, i * {STEP} + 1, {STEP}), h -> xxhash64(h, {band}))))"


def _pairs(blocks: str, band: int) -> str:
    """SQL: the band's keys of the windows, each of two neighbouring blocks."""
    return f"zip_with(slice({blocks}, 1, greatest(size({blocks}) - 1, 1)), slice({blocks}, 2, greatest(size({blocks}), 1)), (x, y) -> xxhash64({band}, least(x, y)))"


def _every(shingles: str) -> str:
    """SQL: keys of all bands of the windows at every place (templates)."""
    one = "transform(sequence(0, greatest(size({s}) - {w}, 0)), i -> xxhash64({b}, array_min(transform(slice({s}, i + 1, {w}), h -> xxhash64(h, {b})))))"
    return f"concat({', '.join(one.format(s=shingles, w=WINDOW, b=b) for b in range(BANDS))})"


def template_index(spark, templates=TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(template, license, shingles), (key, template)."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    words = once(once(rows, "w", _WORDS.format(t="text")), "all", _SHINGLES.format(w="w"))
    made = words.select("template", "license", "all", F.array_distinct("all").alias("shingles"))
    if made.filter("size(shingles) = 0").count():
        raise ValueError("a template has fewer than five words")
    keys = made.select("template", F.explode(F.expr(f"case when size(shingles) < {SHORT} then shingles else {_every('all')} end")).alias("key")).distinct()
    return made.select("template", "license", "shingles"), keys


def scan(docs: DataFrame, templates=TEMPLATES, text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """docs' rows by matched template: template, license, n_template, n_shared, containment."""
    spark = docs.sparkSession
    made, keys = template_index(spark, templates)
    results = {"template", "license", "n_template", "n_shared", "containment"}
    passing = [c for c in docs.columns if c not in results]
    listed = sorted({r["key"] for r in keys.select("key").distinct().limit(MAX_KEYS + 1).collect()})
    folded = once(docs.select(*[F.col(f"`{c}`") for c in passing]), "__s_w", _WORDS.format(t=f"coalesce(`{text}`, '')"))
    hashed = once(folded, "__s_h", _SHINGLES.format(w="__s_w")).drop("__s_w").filter("size(__s_h) > 0")
    blocks = hashed
    for b in range(BANDS):
        blocks = once(blocks, f"__s_{b}", _blocks("__s_h", b))
    keyed = F.expr(f"concat(__s_h, {', '.join(_pairs(f'__s_{b}', b) for b in range(BANDS))})")
    bands = [f"__s_{b}" for b in range(BANDS)]
    if len(listed) <= MAX_KEYS:
        hits = once(blocks, "__s_k", F.filter(keyed, lambda k: k.isin(listed))).drop(*bands).filter("size(__s_k) > 0")
        # few rows are left; each row's keys name its candidate templates
        named = hits.withColumn("__s_row", F.monotonically_increasing_id())
        named = materialise(named, "licenses")
        touched = named.select("__s_row", F.explode(F.array_distinct("__s_k")).alias("key"))
    else:
        named = materialise(once(blocks, "__s_k", keyed).drop(*bands).withColumn("__s_row", F.monotonically_increasing_id()), "licenses")
        touched = named.select("__s_row", F.explode(F.array_distinct("__s_k")).alias("key"))
    candidates = touched.join(keys, "key").select("__s_row", "template").distinct()
    pairs = named.drop("__s_k").join(candidates, "__s_row").join(made, "template")
    shared = F.size(F.array_intersect("shingles", "__s_h"))
    found = pairs.withColumns({"n_template": F.size("shingles").cast("long"), "n_shared": shared.cast("long")})
    out = found.withColumn("containment", F.col("n_shared") / F.col("n_template")).filter(F.col("containment") >= containment)
    return out.select(*[F.col(f"`{c}`") for c in passing], "template", "license", "n_template", "n_shared", "containment")
