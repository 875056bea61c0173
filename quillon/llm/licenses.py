"""Licence scans: Dice coefficient of word bigrams between windows of a text and licence templates."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache
from importlib import resources
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written

#: Wordings of notices as their licences give them.
NOTICES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

#: The names that licences go by.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"],
    "Unlicense": ["Unlicense"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
}
#: Creative Commons licences, short and long, all of version 4.0.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: How a work says that it has a licence, before the name.
VERBS = ("licensed under", "released under", "distributed under", "available under")

THRESHOLD = 0.8


def bigram_list(text: str) -> list[str]:
    """Bigrams of runs of ASCII letters and digits in lower case, in order, repeats kept."""
    words = re.findall("[a-z0-9]+", text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@cache
def templates() -> tuple[tuple[str, str], ...]:
    """Licences and texts: whole licences, their notices, and each name after each verb, with ``the`` or without."""
    texts = sorted((f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    whole = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in texts]
    names = NAMES | {f"CC-{k}-4.0": [f"CC {k} 4.0", f"Creative Commons {v} 4.0 International License"] for k, v in COMMONS.items()}
    short = [(k, f"{verb} {the}{name}") for k, v in names.items() for name, verb, the in product(v, VERBS, ("", "the "))]
    return (*whole, *NOTICES, *short)


class Index:
    """What the scan needs of the templates: their bigrams, and anchors that find them.

    Where the Dice coefficient of a template with b bigrams and a window reaches t, they share at
    least t / (2 - t) * b bigrams. So of any b - that + 1 of the template's bigrams the window has
    one; the anchors are those that come in the fewest places of all templates, longest first.
    """

    def __init__(self, known: tuple[tuple[str, str], ...], threshold: float):
        self.names = [name for name, _ in known]
        self.lists = [bigram_list(text) for _, text in known]
        self.sets = [sorted(set(x)) for x in self.lists]
        self.low, self.high = threshold / (2 - threshold), (2 - threshold) / threshold
        places = Counter(g for x in self.lists for g in x)
        self.anchors: dict[str, list[tuple[int, int]]] = {}
        for k, (own, every) in enumerate(zip(self.sets, self.lists, strict=True)):
            rare = sorted(own, key=lambda g: (places[g], -len(g), g))
            chosen = set(rare[: len(own) - math.ceil(self.low * len(own) - 1e-9) + 1])
            for offset, g in enumerate(every):
                if g in chosen:
                    self.anchors.setdefault(g, []).append((k, offset))


def _once(value: Column) -> Column:
    """The value as a generator's only row: filters on it aren't moved below, where each would compute it again."""
    return F.explode(F.array(value))


def bigrams(words: Column) -> Column:
    """Bigrams of an array of words, in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


#: A window is a number: its template * this + its start, which may lie before the text.
SPAN = 1 << 40
#: Words of a stretch in which windows meet.
STRETCH = 512


def _unbeaten(found: DataFrame, rivals: Column) -> tuple[DataFrame, DataFrame]:
    """Windows whose middle no stronger one of their ``rivals`` holds, and the others (_r, _d, _t, _f, _e, loser, winner)."""
    middle = F.floor((F.col("first") + F.col("end")) / 2)
    x = found.select("row", "doc_id", "license", "template", "strength", "first", "end", middle.alias("middle"), F.floor(middle / STRETCH).alias("stretch"))
    stretches = F.sequence(F.floor(F.col("first") / STRETCH), F.floor(F.greatest("first", F.col("end") - 1) / STRETCH))
    y = found.select(*(F.col(a).alias(b) for a, b in (("row", "_row"), ("doc_id", "_doc"), ("license", "_license"), ("template", "_template"), ("strength", "_strength"), ("first", "_first"), ("end", "_end"))), F.explode(stretches).alias("_stretch"))
    order = lambda p: F.struct(F.col(f"{p}strength").alias("s"), (-F.col(f"{p}template")).alias("t"), (-F.col(f"{p}first")).alias("f"))
    holds = (F.col("_first") <= F.col("middle")) & (F.col("middle") < F.col("_end")) & rivals & (order("_") > order(""))
    met = x.join(y, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("stretch") == F.col("_stretch")) & holds)
    best = F.max(F.struct(order("_").alias("o"), F.col("_license").alias("l"))).getField("l")
    beaten = met.groupBy(F.col("row").alias("_r"), F.col("doc_id").alias("_d"), F.col("template").alias("_t"), F.col("first").alias("_f"), F.col("end").alias("_e")).agg(F.first("license").alias("loser"), best.alias("winner"))
    beaten = written(beaten, "licence-losers")
    left = found.join(beaten, (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("template") == F.col("_t")) & (F.col("first") == F.col("_f")) & (F.col("end") == F.col("_e")), "left_anti")
    return left, beaten


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """Licences in each text: doc_id, license, dice and first_word of the best window, alternatives.

    Words are runs of ASCII letters, in lower case, and digits, so line ends and comment signs
    don't matter. Wherever a text has an anchor of a template, see `Index`, the window that begins
    where the template would, and has its length, is compared: sizes that can't reach
    ``threshold`` are passed over, else it is the Dice coefficient of both sets of bigrams.

    Windows compete for a place: one gives way to a stronger one that holds its middle, first to
    those of its own licence, then to those of others that are left. Stronger is: more shared
    bigrams times Dice, of equal ones the template, then the place, that comes first. So a notice is one licence, though its siblings' notices are nearly alike, and
    what a whole licence quotes isn't another. The best window of a licence that is left counts, of equal ones the
    first; ``alternatives`` are the licences that gave way to it where it was the strongest, in
    order, joined by commas.

    Null and empty texts and texts without notices have no rows. Texts are scanned whole, however
    long, where they are; what leaves them are windows over the threshold, which meet by stretches
    of ``STRETCH`` words. Rows with one doc_id count together; a null doc_id is kept; an empty table gives none.
    """
    index = Index(known or templates(), threshold)
    least = index.low * min(map(len, index.sets))
    listed = lambda column, kind: F.from_json(F.lit(json.dumps(column)), kind)
    sets, sizes = listed(index.sets, "array<array<string>>"), listed([len(x) for x in index.lists], "array<int>")
    found_by = listed({g: [k * SPAN - o for k, o in places] for g, places in index.anchors.items()}, "map<string,array<bigint>>")
    anchors = ", ".join(f"'{g}'" for g in sorted(index.anchors))

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("row"), _once(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit("[a-z0-9]+"), F.lit(0))).alias("words")).where(F.size("words") > least)
    rows = rows.select("doc_id", "row", _once(bigrams(F.col("words"))).alias("grams"))
    hits = F.expr(f"filter(transform(grams, (g, i) -> CASE WHEN g IN ({anchors}) THEN struct(g AS g, i AS i) END), x -> x IS NOT NULL)")
    rows = rows.select("doc_id", "row", "grams", _once(hits).alias("hits")).where(F.size("hits") > 0)
    at = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(found_by, h.g), lambda place: place + h.i)))
    # Half a span more, so that a start before the text stays with its template.
    rows = rows.select("doc_id", "row", "grams", _once(F.array_distinct(F.transform(at, lambda x: x + SPAN // 2))).alias("windows"))

    def window(w: Column) -> Column:
        template, start = F.floor(w / F.lit(SPAN)).cast("int"), F.pmod(w, F.lit(SPAN)) - SPAN // 2
        first = F.greatest(start, F.lit(0)).cast("int")
        end = F.least(start + F.get(sizes, template), F.size("grams")).cast("int")
        own = F.array_distinct(F.slice("grams", first + 1, F.greatest(end - first, F.lit(0))))
        return F.struct(template.alias("template"), first.alias("first"), end.alias("end"), own.alias("own"))

    def compare(w: Column) -> Column:
        other = F.get(sets, w.template)
        fits = F.size(w.own).between(index.low * F.size(other), index.high * F.size(other))
        shared = F.when(fits, F.size(F.array_intersect(w.own, other))).otherwise(0)
        return F.struct(w.template.alias("template"), w.first.alias("first"), w.end.alias("end"), shared.alias("shared"), (F.size(w.own) + F.size(other)).alias("both"))

    def rated(w: Column) -> Column:
        dice = 2.0 * w.shared / w.both
        return F.struct(w.template.alias("template"), dice.alias("dice"), (w.shared * dice).alias("strength"), w.first.alias("first"), w.end.alias("end"))

    # Step by step, so that each window's bigrams are cut out and compared once.
    good = F.filter(F.transform(F.transform(F.transform("windows", window), compare), rated), lambda x: x.dice >= threshold)
    license = F.get(listed(index.names, "array<string>"), F.col("x.template"))
    # Rows alike in doc_id and text have the same windows.
    found = rows.select("doc_id", F.explode(good).alias("x"), "row").select("doc_id", "row", license.alias("license"), "x.*").distinct()
    found = written(found, "licence-windows")
    found = written(_unbeaten(found, F.col("_license") == F.col("license"))[0], "licence-places")
    left, beaten = _unbeaten(found, F.col("_license") != F.col("license"))
    top = left.groupBy("doc_id", "license").agg(F.max(F.struct("dice", (-F.col("first")).alias("before"))).alias("x"))
    others = beaten.groupBy(F.col("_d").alias("_doc"), F.col("winner").alias("_won")).agg(F.array_join(F.array_sort(F.collect_set("loser")), ",").alias("alternatives"))
    out = top.join(others, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("license") == F.col("_won")), "left")
    return out.select("doc_id", "license", "x.dice", (-F.col("x.before")).alias("first_word"), F.coalesce("alternatives", F.lit("")).alias("alternatives"))
