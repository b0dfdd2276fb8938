"""License scans: Dice coefficient of word bigrams between parts of a text and license texts and notices.

Text is normalised to lower-case ASCII letters and digits with single blanks. A unit is a line or a paragraph (lines
between blank lines, or a whole text without any) of at least two words. A unit with a bigrams and a template with b can
reach a coefficient t only if a lies between b * t / (2 - t) and b * (2 - t) / t, so templates are kept by unit size and only
those of the unit's own size class are compared, and of these only those that share enough distinct bigrams. Within longer texts, a
window of a template's size begins wherever the template's first two words stand. Bigrams count as often as they occur.
Some templates name bigrams, such as those of a version, that the unit must hold, and of a family's templates (the name up to the first hyphen) only the
best of a unit counts. All is done within the row, in Spark's own functions.

Cases: null text has no units and no license. Repeated rows give repeated result rows. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_AS_IS = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_OLD = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
#: Fixed values: (name, bigrams that a match must hold, such as the version, text) of public licenses and of the notices by which texts state one.
TEMPLATES = [
    ("MIT", "", "Released under the MIT License."),
    ("MIT", "", "This project is licensed under the MIT License."),
    ("MIT", "", _MIT),
    ("MIT", "", f"{_MIT} {_MIT_NOTICE}"),
    ("MIT", "", f"{_MIT} {_MIT_NOTICE} {_AS_IS}"),
    ("BSD-2-Clause", "", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2}"),
    ("BSD-2-Clause", "", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} {_BSD_AS_IS}"),
    ("BSD-3-Clause", "", _BSD),
    ("BSD-3-Clause", "", _BSD_3),
    ("BSD-3-Clause", "neither the", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3}"),
    ("BSD-3-Clause", "neither the", f"{_BSD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3} {_BSD_AS_IS}"),
    ("BSD-3-Clause", "3 clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "2 0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "2 0", _APACHE),
    ("Apache-2.0", "", _APACHE_AS_IS),
    ("Apache-2.0", "2 0", f"{_APACHE} {_APACHE_AS_IS}"),
    ("GPL-2.0", "gnu general,version 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "gnu general,version 2", _GPL_OLD.format("General", 2)),
    ("GPL-3.0", "gnu general,version 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gnu general,version 3", _GPL.format("General", 3)),
    ("LGPL-2.1", "gnu lesser,2 1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu lesser,version 3", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "gnu lesser,version 3", _GPL.format("Lesser General", 3)),
    ("AGPL-3.0", "gnu affero,version 3", _GPL.format("Affero General", 3)),
    ("MPL-2.0", "2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "by 4", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "attribution 4", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "by sa", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "sharealike 4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "by nc", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "noncommercial 4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("all-rights-reserved", "rights reserved", "All rights reserved."),
]
LEAST = 0.8
_TEMPLATE = "struct<name:string,family:string,need:array<string>,size:int,grams:array<string>,again:array<struct<gram:string,n:int>>>"
_TEMPLATES = f"array<{_TEMPLATE}>"
_MATCHES = "array<struct<name:string,family:string,dice:double>>"


def _plain(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def _sized(name: str, need: str, text: str) -> dict:
    words = _plain(text)
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    distinct = list(dict.fromkeys(grams))
    again = [{"gram": g, "n": grams.count(g)} for g in distinct if grams.count(g) > 1]
    return {"name": name, "family": name.split("-")[0], "need": [x for x in need.split(",") if x], "size": len(grams), "grams": distinct, "again": again}


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)  # folded to a literal once, when the plan is optimised


def _by_size(sized: list[dict], least: float) -> Column:
    """Element n: the templates that a unit of n bigrams may match."""
    top = max(int(t["size"] * (2 - least) / least) for t in sized)
    return _literal([[t for t in sized if 2 * min(n, t["size"]) >= least * (n + t["size"])] for n in range(top + 1)], f"array<{_TEMPLATES}>")


def _grams(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))


def _dice(t: Column, own: Column) -> Column:
    """Bigrams in common, as often as in both; those that a template holds but once need no count."""
    once = F.size(F.array_intersect(t["grams"], own))
    more = F.aggregate(t["again"], F.lit(0), lambda n, g: n + F.greatest(F.least(g["n"], F.size(F.filter(own, lambda x: x == g["gram"]))) - 1, F.lit(0)))
    return (once + more) * F.lit(2.0) / (t["size"] + F.size(own))


def _matching(near: Column, own: Column, least: float) -> Column:
    """The best template of each family that a unit's bigrams match."""
    may = F.filter(near, lambda t: (F.size(F.array_intersect(t["grams"], own)) + t["size"] - F.size(t["grams"])) * 2 >= (t["size"] + F.size(own)) * least)
    held = F.filter(may, lambda t: F.size(F.array_except(t["need"], own)) == 0)
    rated = F.transform(held, lambda t: F.struct(t["name"].alias("name"), t["family"].alias("family"), _dice(t, own).alias("dice")))
    good = F.filter(rated, lambda m: m["dice"] >= least)
    worse = lambda m, o: (o["family"] == m["family"]) & ((o["dice"] > m["dice"]) | ((o["dice"] == m["dice"]) & (o["name"] < m["name"])))
    return let(good, lambda g: F.filter(g, lambda m: ~F.exists(g, lambda o: worse(m, o))))


def licenses(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """Per document: doc_id, n_units, n_matches, licenses (sorted names, comma-joined), best (highest coefficient or 0), matches."""
    sized = [_sized(*t) for t in templates or TEMPLATES]
    table, none = _by_size(sized, least), F.array().cast(_MATCHES)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = lambda x: F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    plain = lambda x: F.split(bare(x), " ")
    paragraphs = F.filter(F.split(text, r"\n[\x20\t\r]*\n"), lambda x: F.contains(x, F.lit("\n")))
    units = F.filter(F.transform(F.concat(F.split(text, "\n"), paragraphs), plain), lambda w: F.size(w) > 1)

    def of_unit(words: Column) -> Column:
        near = F.coalesce(F.get(table, F.size(words) - 1), F.array().cast(_TEMPLATES))
        return F.when(F.size(near) == 0, none).otherwise(let(_grams(words), lambda own: _matching(near, own, least)))

    # windows: only texts that hold the first two words of some template are cut into words as a whole
    anchors = sorted({t["grams"][0] for t in sized})
    every = _literal([{**t, "least": t["size"] * least / (2 - least)} for t in sized], f"array<{_TEMPLATE.replace('size:int', 'size:int,least:double')}>")

    def in_windows(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)).isin(anchors))

        def at(i: Column) -> Column:
            first = F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
            own = F.filter(every, lambda t: (F.get(t["grams"], F.lit(0)) == first) & (F.size(words) - i >= (t["size"] + 1) * (least / (2 - least))))
            return F.flatten(F.transform(own, lambda t: let(_grams(F.slice(words, i + 1, t["size"] + 1)), lambda g: _matching(F.array(t), g, least))))

        return F.flatten(F.transform(places, at))

    whole = F.col("plain")
    windows = F.when(whole.rlike(r"\b(?:" + "|".join(anchors) + r")\b"), let(F.split(whole, " "), in_windows)).otherwise(none)
    found = docs.select("doc_id", units.alias("units"), bare(text).alias("plain"))
    found = found.select("doc_id", F.size("units").cast("long").alias("n_units"), F.flatten(F.transform("units", of_unit)).alias("of_units"), windows.alias("windows"))
    # a window counts where no line or paragraph has its license
    apart = F.filter("windows", lambda m: ~F.exists("of_units", lambda o: o["name"] == m["name"]))
    found = found.select("doc_id", "n_units", F.concat("of_units", apart).alias("matches"), F.concat("of_units", "windows").alias("every"))
    return found.select(
        "doc_id",
        "n_units",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["name"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("every", lambda m: m["dice"])), F.lit(0.0)).alias("best"),
        F.transform("matches", lambda m: F.struct(m["name"].alias("name"), m["dice"].alias("dice"))).alias("matches"),
    )
