"""Licence scans in plain DataFrame functions.

A text is cut into its lines, and into its paragraphs of several lines; each is
normalised (lower case, anything but a-z and 0-9 a space) and compared to licence
templates by the Dice coefficient over distinct word bigrams.  A notice within a longer
line, or a licence over several paragraphs, is found by windows: runs of as many words of
the whole text as the template has, laid so that one of the template's anchor bigrams is
where the template has it.  Dice cannot reach the threshold t unless the smaller size is
at least t / (2 - t) of the larger, so only templates within these bounds are compared.
To reach a template a unit must also share so many of its bigrams that it holds one of a
few key words, and a window one of the anchors; both are derived from the templates, and
texts without any are not even cut into bigrams.  Everything happens within a document's
row: there is no shuffle, so no key can be hot.

Defined results.  A null or empty text has no licence (null) and dice 0.  Of several
licences the best is named, ties by name; ``licenses`` lists all, and ``n_hits`` counts the
lines, paragraphs and windows that reach a template.  Very long texts are read whole.  Rows
are independent, so repeated rows and ids, and null ids, are harmless; extra columns are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.llm.common import table

THRESHOLD = 0.8

# fixed values: notices and texts of public licences, as their stewards publish them
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[str]:
    """The words of a normalised template."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised template."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def template_rows(threshold: float = THRESHOLD, templates=TEMPLATES) -> list[dict]:
    """Licence, words, distinct bigrams, and the sizes that can reach the threshold."""
    ratio = threshold / (2 - threshold)
    rows = []
    for name, text in templates:
        b = bigrams(text)
        rows.append({"license": name, "w": len(words_of(text)), "n": len(b), "lo": math.ceil(round(ratio * len(b), 9)), "hi": math.floor(round(len(b) / ratio, 9)), "b": b})
    return rows


def anchors(rows: list[dict], templates=TEMPLATES, threshold: float = THRESHOLD) -> dict[str, list[tuple[int, int]]]:
    """For each anchor bigram the templates it lays a window of, and its place in them.

    What reaches a template shares at least ``need`` of its bigrams, so one of any
    ``n - need + 1``; those with the fewest common words are taken.
    """
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (row, (_, text)) in enumerate(zip(rows, templates, strict=True)):
        need = math.ceil(round(threshold * (row["n"] + row["lo"]) / 2, 9))
        plain = lambda b: sum(w in _COMMON or len(w) < 3 for w in b.split(" "))
        chosen = set(sorted(row["b"], key=lambda b: (plain(b), -len(b), b))[: row["n"] - need + 1])
        words = words_of(text)
        for i, b in enumerate(f"{x} {y}" for x, y in zip(words, words[1:], strict=False)):
            if b in chosen:
                out.setdefault(b, []).append((t, i))
    return out


#: Words too common in plain text to tell anything.
_COMMON = set("the of to and or in is at be by for with this that under are any an a as from if you may not on it all other use copy source public version without including following action applicable provided notice mit".split())


def key_words(rows: list[dict], threshold: float = THRESHOLD) -> list[str]:
    """Words of which a unit must hold at least one to reach any template.

    A unit that reaches a template shares at least ``need`` of its bigrams.  The words
    are chosen so that fewer than that are left without one of them.
    """
    chosen: set[str] = set()
    for row in rows:
        need = math.ceil(round(threshold * (row["n"] + row["lo"]) / 2, 9))
        bare = [b.split(" ") for b in row["b"] if not chosen & set(b.split(" "))]
        while len(bare) >= need:
            among = sorted({w for b in bare for w in b if w not in _COMMON} or {w for b in bare for w in b})
            best = max(among, key=lambda w: (sum(w in b for b in bare) * (len(w) > 1), len(w)))
            chosen.add(best)
            bare = [b for b in bare if best not in b]
    return sorted(chosen)


def _matches(words: Column, rows: list[dict], threshold: float) -> Column:
    """The templates that a unit's words reach, as array of struct(dice, license)."""
    templates = F.from_json(F.lit(json.dumps(rows)), "array<struct<license:string,n:int,lo:int,hi:int,b:array<string>>>")
    rest = F.size(words) - 1
    pairs = F.array_distinct(F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat(a, F.lit(" "), b)))

    def compare(p: Column) -> Column:
        near = F.filter(templates, lambda t: F.size(p).between(t["lo"], t["hi"]))
        scored = F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(p, t["b"])) / (F.size(p) + t["n"])).alias("dice"), t["license"].alias("license")))
        return F.filter(scored, lambda s: s["dice"] >= threshold)

    # transform over a one-element array evaluates the bigrams once
    return F.transform(F.array(pairs), compare)[0]


def _windows(words: Column, rows: list[dict], laid: dict[str, list[tuple[int, int]]], threshold: float) -> Column:
    """The windows of a text's words that reach their template, as array of struct(dice, license)."""
    names, places = F.array(*map(F.lit, laid)), [{"b": b, "at": [{"t": t, "o": o} for t, o in found]} for b, found in laid.items()]
    table_ = F.from_json(F.lit(json.dumps(places)), "array<struct<b:string,at:array<struct<t:int,o:int>>>>")
    templates = F.from_json(F.lit(json.dumps(rows)), "array<struct<license:string,w:int,n:int,lo:int,hi:int,b:array<string>>>")
    pairs_of = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))

    def laid_out(pairs: Column) -> Column:
        # start (may lie before the text) and template of each window, once each
        def starts(anchor: Column) -> Column:
            at = F.filter(F.sequence(F.lit(1), F.size(pairs)), lambda i: F.element_at(pairs, i) == anchor["b"])
            return F.flatten(F.transform(at, lambda i: F.transform(anchor["at"], lambda h: F.struct((i - h["o"]).alias("s"), h["t"].alias("t")))))

        present = F.filter(table_, lambda a: F.array_contains(pairs, a["b"]))
        return F.array_distinct(F.flatten(F.transform(present, starts)))

    def compared(window: Column) -> Column:
        t, first = F.element_at(templates, window["t"] + 1), F.greatest(window["s"], F.lit(1))
        run = F.slice(words, first, F.greatest(t["w"] + window["s"] - first, F.lit(0)))
        scored = F.transform(F.array(F.array_distinct(pairs_of(run))), lambda p: F.struct(F.when(F.size(p).between(t["lo"], t["hi"]), F.lit(2.0) * F.size(F.array_intersect(p, t["b"])) / (F.size(p) + t["n"])).otherwise(0.0).alias("dice"), t["license"].alias("license")))
        return scored[0]

    none = F.array().cast("array<struct<dice:double,license:string>>")
    found = lambda p: F.when(F.arrays_overlap(p, names), F.filter(F.transform(laid_out(p), compared), lambda s: s["dice"] >= threshold)).otherwise(none)
    # transform over a one-element array evaluates the bigrams once
    return F.when(F.size(words) > 1, F.transform(F.array(pairs_of(words)), found)[0]).otherwise(none)


def scan(docs: DataFrame, *, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``doc_id, license, dice, licenses, n_hits``: one row for each row of ``docs``."""
    rows = template_rows(threshold, templates)
    laid = anchors(rows, templates, threshold)
    least = min(r["lo"] for r in rows) + 1
    keys = F.array(*map(F.lit, key_words(rows, threshold)))
    may_match = lambda u: F.exists(keys, lambda w: F.contains(u, w))

    def found(low: Column) -> Column:
        plain = F.regexp_replace(low, r"[^a-z0-9\n]+", " ")
        lines = F.split(plain, "\n")
        paragraphs = F.filter(F.split(plain, r"\n *\n[ \n]*"), lambda p: F.trim(p).contains("\n"))
        units = F.concat(lines, F.transform(paragraphs, lambda p: F.regexp_replace(p, r"[ \n]+", " ")))
        units = F.filter(F.transform(F.filter(units, may_match), lambda u: F.split(F.trim(u), " ")), lambda w: F.size(w) >= least)
        of_units = F.flatten(F.filter(F.transform(units, lambda w: _matches(w, rows, threshold)), lambda h: F.size(h) > 0))
        whole = F.transform(F.array(F.split(F.trim(F.regexp_replace(plain, r"[ \n]+", " ")), " ")), lambda w: _windows(w, rows, laid, threshold))[0]
        return F.concat(of_units, whole)

    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    none = F.array().cast("array<struct<dice:double,license:string>>")
    # most texts hold no key word and are done after that look
    hits = F.transform(F.array(low), lambda t: F.when(may_match(t), found(t)).otherwise(none))[0]
    best = F.element_at(F.sort_array(F.transform("hits", lambda h: F.struct((-h["dice"]).alias("less"), h["license"].alias("license")))), 1)
    out = docs.select("doc_id", hits.alias("hits"))
    some = F.size("hits") > 0
    return out.select(
        "doc_id", F.when(some, best["license"]).alias("license"), F.when(some, -best["less"]).otherwise(0.0).alias("dice"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"), F.size("hits").cast("long").alias("n_hits"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: ``doc_id, license, dice, licenses, n_hits``."""
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same scan as SQL over the same templates and anchors."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = template_rows()
    values = ", ".join(f"({i}, {quote(r['license'])}, {r['w']}, {r['n']}, {r['lo']}, {r['hi']}, [{', '.join(map(quote, r['b']))}])" for i, r in enumerate(rows))
    places = ", ".join(f"({quote(b)}, {t}, {o})" for b, found in anchors(rows).items() for t, o in found)
    return rf"""
with t(id, license, w, n, lo, hi, b) as (values {values}),
an(pair, t, o) as (values {places}),
d as (select row_number() over () as k, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') as plain from documents),
u0 as (
  select k, unnest(string_split(plain, chr(10))) as u from d
  union all
  select k, regexp_replace(p, '[ \n]+', ' ', 'g') from (select k, unnest(regexp_split_to_array(plain, '\n *\n[ \n]*')) as p from d) where contains(trim(p), chr(10))),
u as (select k, row_number() over () as i, string_split(trim(u), ' ') as w from u0 where length(trim(u)) > 0),
b as (select k, i, list_distinct(list_transform(range(1, len(w)), lambda x: w[x] || ' ' || w[x + 1])) as p from u where len(w) > 1),
s as (select k, license, 2.0::double * len(list_intersect(p, t.b)) / (len(p) + n) as dice from b join t on len(p) between lo and hi),
dw as (select k, string_split(trim(regexp_replace(plain, '[ \n]+', ' ', 'g')), ' ') as w from d),
dp as (select k, unnest(range(1, len(w))) as i from dw),
laid as (select distinct dp.k, i - o as first, an.t from dp join dw using (k) join an on w[i] || ' ' || w[i + 1] = pair),
wn as (select laid.k, t.*, dw.w[greatest(first, 1):first + t.w - 1] as run from laid join dw using (k) join t on t.id = laid.t),
wp as (select *, list_distinct(list_transform(range(1, len(run)), lambda x: run[x] || ' ' || run[x + 1])) as p from wn where len(run) > 1),
ws as (select k, license, 2.0::double * len(list_intersect(p, b)) / (len(p) + n) as dice from wp where len(p) between lo and hi),
h as (select * from (select * from s union all select * from ws) where dice >= {THRESHOLD}),
a as (select k, arg_min(license, {{'d': -dice, 'l': license}}) as license, max(dice) as dice, string_agg(distinct license, ',' order by license) as licenses, count(*) as n_hits from h group by k)
select doc_id, license, coalesce(dice, 0.0::double) as dice, coalesce(licenses, '') as licenses, coalesce(n_hits, 0) as n_hits from d left join a using (k)
"""
