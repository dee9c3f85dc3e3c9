"""License scans: normalised text against licence templates by the Dice coefficient of word bigrams.

DataFrame functions only, and no shuffle.  A text is lower-cased, everything but
letters, digits and line ends becomes a space, and every run of consecutive
words, over line ends or within a line, is compared with the templates over
their sets of word bigrams.

Not every run is tried, but no better one is lost.  The shortest of the best runs
starts at one of the template's bigrams that it holds once, so it ends before
the next place of that bigram; and the word pair before it is not one of the
template's, or is in the run already, as with it the run would score more.  The
same holds at its end.  So the runs of a start lie between two places that are
known from the places of the same bigram before and after each place, and those
of all starts of one bigram do not overlap: the work is linear in the text, also
where it repeats a licence.  A start goes, too, if its shortest possible run is
too large to reach the threshold, or to beat what was found before.

A set that reaches the threshold lacks so few of a template's bigrams that it
holds one of any choice of one more; texts with none of the templates' choices
(the longest bigrams) are settled by one regular expression.

Defined results: a null or empty text, and one without two words, matches
nothing (null licence, score 0, no lines); of equal scores the licence that
comes first by name stays; n_lines counts the lines that hold a match of their
own and is 1 where only a run over line ends matches; repeated rows are judged
each; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Short notices by which licences are named in documents.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "LGPL-2.1": "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This {kind} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."

#: Bodies of the short licences, and the headers that the long ones ask for in source files.
BODIES = {
    "AGPL-3.0": _GNU.format(kind="program", name="Affero General Public License", version="3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": f"{_BSD_2} {_AS_IS}",
    "BSD-3-Clause": f"{_BSD_2} {_BSD_3} {_AS_IS}",
    "GPL-2.0": _GNU.format(kind="program", name="General Public License", version="2"),
    "GPL-3.0": _GNU.format(kind="program", name="General Public License", version="3"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1": _GNU.format(kind="library", name="Lesser General Public License", version="2.1"),
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def normalised(text):
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")


def word_bigrams(words):
    """The bigrams of an array of words, in order."""
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))


def _template_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _least(n: int, threshold: float) -> int:
    """Bigrams that a set at the threshold shares with a template of ``n``."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9)


def _trie(words: list[str]) -> str:
    """Pattern of the words, with common beginnings once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    end = heads.pop("", None) is not None
    body = "|".join((r"[ \n]+" if c == " " else c) + (_trie(rest) if any(rest) else "") for c, rest in sorted(heads.items()))
    return body if len(heads) == 1 and not end else f"(?:{body}){'?' if end else ''}"


def _signal(sets: list[tuple[str, list[str]]], threshold: float) -> str:
    """Pattern of the bigrams of which every matching text has at least one."""
    chosen: set[str] = set()
    for _, grams in sets:
        chosen.update(sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - _least(len(grams), threshold) + 1])
    return r"(?:^|[ \n])" + _trie(sorted(chosen)) + r"(?:[ \n]|$)"


def _let(value, use):
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(grams, every: list[str], sets: list[tuple[str, list[str]]]):
    """The bigrams in their order, each with the places of the same bigram before and after it and the templates that hold it.

    Without such a place ``before`` is -1 and ``after`` the number of bigrams.
    """

    def linked(same):
        def place(x, q):
            beside = lambda other: F.when(F.get(same, other)["g"] == x["g"], F.get(same, other)["i"])
            holders = F.filter(F.array(*[F.when(x["g"].isin(own), F.lit(t)) for t, (_, own) in enumerate(sets)]), lambda t: t.isNotNull())
            of = F.when(x["g"].isin(every), holders).otherwise(F.array().cast("array<int>"))
            return F.struct(x["i"].alias("i"), F.coalesce(beside(q - 1), F.lit(-1)).alias("before"), F.coalesce(beside(q + 1), F.size(same)).alias("after"), of.alias("of"))

        return F.sort_array(F.transform(same, place))

    return _let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), linked)


def _best_run(grams, placed, hits, template, so_far):
    """The greatest Dice coefficient of a run of ``grams`` with the template (t, n, least, most, own); null if none is above ``so_far``.

    ``hits`` are those of ``placed`` that any template holds.
    """
    n, least, most = template["n"], template["least"], template["most"]
    held = lambda place: F.array_contains(place["of"], template["t"])
    run = lambda i, length: F.slice(grams, i + 1, length)
    size = lambda i, length: F.size(F.array_distinct(run(i, length)))

    def starts(places):
        """Starts i, with the first (lo) and beyond the last (hi) place that a run may end at."""

        def start(h, q):
            left = F.get(placed, h["i"] - 1)
            turned = F.coalesce(held(left), F.lit(False))
            enough = F.coalesce(F.get(places, q + least - 1)["i"], F.size(grams))
            return F.struct(h["i"].alias("i"), F.greatest(F.when(turned, left["after"]).otherwise(h["i"]), enough).alias("lo"), h["after"].alias("hi"), turned.alias("turned"))

        return F.filter(F.transform(places, start), lambda s: s["lo"] < s["hi"])

    def sized(s):
        """With the size of the run up to lo."""
        length = s["lo"] - s["i"] + 1
        first = size(s["i"], F.least(length, 2 * most))
        return s.withField("size", _let(first, lambda d: F.when((d <= most) & (length > 2 * most), size(s["i"], length)).otherwise(d)))

    def score(s):
        """The best of the runs that start at s."""
        i, room = s["i"], s["hi"] - s["i"]
        # doubled until the run is too large; negative once it is settled
        wider = lambda x, _: F.when(x < 0, x).when(x >= room, -room).when(size(i, x) > most, -x).otherwise(2 * x)
        reach = -F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.greatest(s["lo"] - i + 1, 2 * most), wider)

        def may_end(e):
            right = F.get(placed, e["i"] + 1)
            return held(e) & (e["before"] < i) & F.coalesce(~held(right) | (right["before"] >= i), F.lit(True))

        ends = F.filter(F.slice(placed, s["lo"] + 1, reach - (s["lo"] - i)), may_end)
        dice = lambda words: 2 * F.size(F.array_intersect(words, template["own"])) / (F.size(F.array_distinct(words)) + n)
        return F.array_max(F.transform(ends, lambda e: _let(run(i, e["i"] - i + 1), dice)))

    def above(starts, floor):
        """The best of the runs from the starts whose bounds are above ``floor``."""
        bound = lambda s: 2 * n / (F.greatest(s["size"], n) + n)
        return F.array_max(F.transform(F.filter(F.transform(starts, sized), lambda s: (s["size"] <= most) & (bound(s) > floor)), score))

    def judged(starts):
        """Runs with nothing of the template before them first, then the others, unless those are whole."""
        plain = F.coalesce(above(F.filter(starts, lambda s: ~s["turned"]), so_far), F.lit(0.0))
        return _let(F.greatest(plain, so_far), lambda f: F.when(f < 1, F.greatest(f, above(F.filter(starts, lambda s: s["turned"]), f))).otherwise(f))

    def among(places):
        different = F.size(F.filter(places, lambda h: h["before"] < 0))
        return F.when(different >= least, _let(starts(places), judged))

    found = F.when(so_far < 1, _let(F.filter(hits, held), among))
    return _let(found, lambda x: F.when(x > so_far, x))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, license (its best match at the threshold or above, else null), score, n_lines (matching lines)."""
    given = [*TEMPLATES.items(), *BODIES.items()] if templates is None else templates.items()
    sets = [(name, grams) for name, body in sorted(given) if (grams := _template_bigrams(body))]
    every = sorted({g for _, grams in sets for g in grams})
    signal, names = _signal(sets, threshold), F.array(*[F.lit(name) for name, _ in sets])
    known = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(len(own)).alias("n"), F.lit(_least(len(own), threshold)).alias("least"), F.lit(math.floor(len(own) * (2 - threshold) / threshold + 1e-9)).alias("most"), F.split(F.lit("\n".join(own)), "\n").alias("own")) for t, (_, own) in enumerate(sets)])

    def best(part):
        """The best (score, -place, licence) in a text; null where none reaches the threshold."""

        def among(grams):
            def of(placed):
                def better(b, t, hits):
                    return _let(_best_run(grams, placed, hits, t, b["score"]), lambda x: F.when(x >= threshold, F.struct(x.alias("score"), t["t"].alias("t"))).otherwise(b))

                # the templates in the order of their names, each held against the best of those before it
                none = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("t"))
                found = _let(F.filter(placed, lambda p: F.size(p["of"]) > 0), lambda hits: F.aggregate(known, none, lambda b, t: better(b, t, hits)))
                return _let(found, lambda b: F.when(b["t"] >= 0, F.struct(b["score"].alias("score"), (-b["t"]).alias("rank"), names[b["t"]].alias("license"))))

            return _let(_placed(grams, every, sets), of)

        return _let(word_bigrams(F.split(F.trim(F.regexp_replace(part, r"[ \n]+", " ")), " ")), among)

    body = F.col("__body")
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("__body"))
    empty = F.array().cast("array<string>")
    # the whole text first, then its lines if it has more than one
    lines = F.when(F.contains(body, F.lit("\n")), F.filter(F.split(body, "\n"), lambda x: x.rlike(signal))).otherwise(empty)
    rows = rows.select("doc_id", F.when(body.rlike(signal), F.concat(F.array(body), lines)).otherwise(empty).alias("__parts"))
    rows = rows.select("doc_id", F.filter(F.transform("__parts", best), lambda m: m.isNotNull()).alias("__m"))
    found = F.array_max("__m")
    return rows.select("doc_id", found["license"].alias("license"), F.coalesce(found["score"], F.lit(0.0)).alias("score"), F.when(F.size("__m") > 0, F.greatest(F.size("__m") - 1, F.lit(1))).otherwise(0).cast("long").alias("n_lines"))
