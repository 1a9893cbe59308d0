"""License scan: MinHash bands over overlapping text windows, verified by exact shingle containment. DataFrame functions only.

A template is found in a document if the document has at least `percent` of the template's distinct 5-word shingles (lower-cased). A template is left out if
another is the better match (a greater share of it is there, or as great a share and more of it) and the document lacks what tells them apart: it has less than `percent` of the
shingles that only the worse one has. So a notice that differs from others in a few words gives its own license, and two licenses that are both there are both reported.

Templates are partitioned by size: class c holds those of up to 2**c shingles and more than half of that. Documents are covered by windows of
2 x 2**c shingles that start every 2**c, so a text as long as the template lies whole in one window, which is at most four
times as large. Containment 0.8 is then a Jaccard similarity of at least 0.19, and with `bands` = 48 bands of one row the chance that no
band collides is 0.81**48 = 4e-5 (1e-6 for an unchanged template). Each collision is verified over the whole document.

Bands are computed for windows that share a shingle with some template of their class; no other window can collide. A bitmap of
all templates' shingles (two bits each, without false negatives) tells which documents may have any; their shingles are written once, and
windows, bands and verification read them. The bitmap is the only part of the templates in the plan, at most
2**22 bits, whatever their number; their bands and shingles are broadcast only below a checked size and joined by a shuffle beyond it.

Templates are `NOTICES` (short notices made by a rule from license names, notices for file headers, and full texts of short
licenses) or any other: pairs of name and text, or a table (license, text).

Rows: null or empty texts match nothing, nor do templates below five words. Repeated documents are reported each, a template that is given
twice once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.shared import Scratch, small

# Names of licenses as notices print them.
NAMES = (
    ("mit", "the MIT License"),
    ("apache-2.0", "the Apache License, Version 2.0"),
    ("gpl-2.0", "the GNU General Public License, version 2"),
    ("gpl-3.0", "the GNU General Public License, version 3"),
    ("lgpl-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "the GNU Lesser General Public License, version 3"),
    ("agpl-3.0", "the GNU Affero General Public License, version 3"),
    ("mpl-2.0", "the Mozilla Public License, version 2.0"),
    ("bsd-3-clause", "the BSD 3-Clause License"),
    ("bsd-2-clause", "the BSD 2-Clause License"),
    ("isc", "the ISC License"),
    ("epl-2.0", "the Eclipse Public License, version 2.0"),
    ("cc0-1.0", "CC0 1.0 Universal"),
    ("cc-by-4.0", "CC BY 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0"),
    ("cc-by-4.0", "a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
# How notices begin.
FORMS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under")
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(kind: str, version: str) -> str:
    """The notice that the GNU licenses ask to be put into each file."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        f"GNU {kind} for more details."
    )


# Public license wording.
TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS
     + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
     "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
     "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
     "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
     "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-clause", _BSD + _BSD_END),
    ("bsd-3-clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
     "this software without specific prior written permission. " + _BSD_END),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
     "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
     "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
     "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
     "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
     "not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
     "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
     "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
     "this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
     "and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
     "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
     "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
     "language governing permissions and limitations under the License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
     "obtain one at http://mozilla.org/MPL/2.0/."),
    ("gpl-2.0", _gnu("General Public License", "2")),
    ("gpl-3.0", _gnu("General Public License", "3")),
    ("lgpl-3.0", _gnu("Lesser General Public License", "3")),
    ("agpl-3.0", _gnu("Affero General Public License", "3")),
)
#: (license, text) of all templates.
NOTICES = tuple((license, f"{form} {name}{stop}") for license, name in NAMES for form in FORMS for stop in (".", "")) + TEXTS

_SPACES = " \t\n\x0b\f\r"
#: Most bits of the bitmap of shingles.
BITS = 1 << 22


def shingles(text: Column, k: int = 5) -> Column:
    """The hashes of all k-word shingles of a text, in order; empty for less than k words."""
    words = F.split(F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_SPACES)), r"[ \t\n\x0B\f\r]+")
    # A lambda's argument, so that the words are split once and not for each shingle.
    each = F.transform(F.array(words), lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>")))
    return F.get(each, F.lit(0))


def _bitmap(own: DataFrame) -> tuple[Column, int]:
    """The bitmap of the shingles in `own` (h) as an array of longs, and how many bits it has."""
    spark = own.sparkSession
    bits = 1 << 12
    while bits < min(BITS, 128 * own.count()):
        bits *= 2
    both = own.select(F.explode(F.array(*_bits(F.col("h"), bits))).alias("bit"))
    words = both.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("word"))
    found = {r["at"]: r["word"] for r in words.collect()}  # at most BITS / 64 rows
    text = ",".join(str(found.get(i, 0)) for i in range(bits // 64))
    return F.split(F.lit(text), ",").cast("array<bigint>"), bits


def _bits(h: Column, bits: int) -> tuple[Column, Column]:
    """The two bits that a shingle sets: from its lower and from its upper half."""
    return h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(bits - 1))


def scan(docs: DataFrame, templates: DataFrame | Iterable[tuple[str, str]] = NOTICES, percent: int = 80, k: int = 5, bands: int = 48) -> DataFrame:
    """doc_id, license, n_template (the template's shingles), n_shared for each template that a row of `docs` (doc_id, text) contains."""
    spark = docs.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(list(templates), "license string, text string")
    distinct = templates.select(F.col("license").cast("string"), F.col("text").cast("string")).distinct()
    named = distinct.select(F.xxhash64("license", "text").alias("template"), "license", F.array_distinct(shingles(F.col("text"), k)).alias("own")).where(F.size("own") > 0)
    scratch = Scratch(spark, "licenses")
    table = scratch.keep(named.withColumn("size", F.expr("int(power(2, length(bin(size(own) - 1)) - if(size(own) = 1, 1, 0)))")), "templates")
    facts = table.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.size("own")).alias("shingles")).collect()
    out = "doc_id long, license string, n_template long, n_shared long"
    if not facts:
        return spark.createDataFrame([], out)
    number, total = sum(r["n"] for r in facts), sum(r["shingles"] for r in facts)
    bitmap, bits = _bitmap(table.select(F.explode("own").alias("h")))

    def known(h: Column) -> Column:
        one, two = (F.getbit(F.get(bitmap, F.shiftright(x, 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1 for x in _bits(h, bits))
        return one & two

    def signature(window: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda i: F.array_min(F.transform(window, lambda h: F.xxhash64(h, i))))

    filed = table.select("template", "size", F.posexplode(signature(F.col("own"))).alias("band", "value"))

    # Evaluated once for each document: the generator keeps the shingles from being computed again for each use.
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(shingles(F.col("text"), k))).alias("doc"))
    near = scratch.keep(hashed.where(F.exists("doc", known)).withColumn("row", F.monotonically_increasing_id()), "near")
    # The windows of a class that share a shingle with one of its templates: a place lies in its own window and the one before.
    own = table.select("size", F.explode("own").alias("h")).distinct()
    hits = near.select("row", F.posexplode("doc").alias("at", "h")).join(small(own, total, 24), "h")
    last = F.floor(F.col("at") / F.col("size")).cast("int")
    starts = hits.select("row", "size", F.explode(F.array(last, last - 1)).alias("w")).where("w >= 0").distinct()
    windows = starts.join(near.select("row", "doc"), "row").select("row", "size", F.slice("doc", F.col("w") * F.col("size") + 1, 2 * F.col("size")).alias("window"))
    banded = windows.select("row", "size", F.posexplode(signature(F.col("window"))).alias("band", "value"))
    met = scratch.keep(banded.join(small(filed, number * bands, 40), ["size", "band", "value"]).select("row", "template").distinct(), "met")
    found = near.join(small(met, met.count(), 32), "row").join(small(table, total + 8 * number, 8), "template")
    hit = F.array_intersect("doc", "own")
    shared = found.select("row", "doc_id", F.struct("license", F.size("own").cast("long").alias("n_template"), F.size(hit).cast("long").alias("n_shared"), hit.alias("hit"), "own").alias("t"))
    enough = shared.where(F.col("t.n_shared") * 100 >= F.col("t.n_template") * percent)
    # As many entries as the templates that one document holds.
    kept = F.transform(_best("all", percent), lambda t: F.struct(t["license"].alias("license"), t["n_template"].alias("n_template"), t["n_shared"].alias("n_shared")))
    return enough.groupBy("row", "doc_id").agg(F.collect_list("t").alias("all")).select("doc_id", F.inline(kept))


def _best(found: str, percent: int) -> Column:
    """The templates of which no better one leaves nothing to tell."""

    def worse(t: Column, u: Column) -> Column:
        one, two = u["n_shared"] * t["n_template"], t["n_shared"] * u["n_template"]
        better = (one > two) | ((one == two) & (u["n_shared"] > t["n_shared"]))
        there, only = F.size(F.array_except(t["hit"], u["own"])), F.size(F.array_except(t["own"], u["own"]))
        return better & ((only == 0) | (100 * there < percent * only))

    return F.filter(found, lambda t: ~F.exists(found, lambda u: worse(t, u)))
