"""License scan: parts of texts compared to license templates by the Dice coefficient of their word bigrams.

The parts of a text are its lines, its paragraphs of several lines (between blank lines), the whole, and passages. A passage has as many
words as a template and lies where an anchor word of that template would put it (each of its places in the template on the word in the text,
moved inside the text if need be), so a notice within a line, over several paragraphs or before other text has a part of its own. A
passage is compared to its template only, any other part to all of them. Part and template are
normalised (lower case, letters and digits as words) and made sets of word bigrams; a part matches where 2 * common / (sizes
added) reaches the threshold. With threshold t, sets of sizes a and b can only reach it if a lies within b * t / (2 - t) and
b * (2 - t) / t, so most templates are dropped on sizes before anything is compared. Templates are constants of the plan, so the
scan is row-local: no shuffle, no Python on the executors.

Defined results: null, empty and blank texts match nothing, nor do parts without words; a part of one word is that word; a part that
matches several templates gives a row for each; a notice that is a line or paragraph has a passage too, and passages of one template may
overlap, each giving its row; repeated rows each give theirs; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Percent.
THRESHOLD = 80

# How the common licenses are stated.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "Released under CC0 1.0 Universal, public domain dedication.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Released under the ISC License.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


# Words of templates that other texts often have.
COMMON = frozenset("a all and any applicable applications are as associated at be by code commercial conditions connection contract copy damages data distribute distributed documentation following for free from general granted if in including is it loss may modify must not of on or original other out particular performance person provided public published purpose required resulting rights sell services software source state subject substantial terms that the there this to under use version versions way whether will with without work you".split())


def template_words(text: str) -> list[str]:
    """A template's words, by the rule that scan() has for texts."""
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[str]:
    """A template's distinct word bigrams."""
    w = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w))


def anchors(sets: dict[str, list[str]], threshold: int) -> dict[str, list[str]]:
    """For each template words of which every matching part has at least one. A part that matches a template of m bigrams has at least m * t / (2 - t)
    of them; so of any more bigrams than it may lack, it has one. Words are taken until so many bigrams have one: what isn't common first, then
    what another template has taken, then long words."""
    taken: dict[str, list[str]] = {}
    seen: set[str] = set()
    for name, grams in sorted(sets.items()):
        lacking = len(grams) - -(-len(grams) * threshold // (200 - threshold))
        own: set[str] = set()
        for word in sorted({w for g in grams for w in g.split()}, key=lambda w: (w in COMMON, w not in seen, -len(w), w)):
            if sum(not own.isdisjoint(g.split()) for g in grams) > lacking:
                break
            own.add(word)
        taken[name] = sorted(own)
        seen |= own
    return taken


def places(templates: dict[str, str], words: dict[str, list[str]]) -> list[tuple[str, str, int, int]]:
    """(word, license, offset, length): every place of each anchor word in its template, and the template's number of words."""
    split = {k: template_words(v) for k, v in sorted(templates.items())}
    return [(a, k, i, len(w)) for k, w in split.items() for a in words[k] for i, x in enumerate(w) if x == a]


def any_of(words: set[str]) -> str:
    """A pattern of these words, by their first letters."""
    first = {w[0]: sorted(x[1:] for x in words if x[0] == w[0]) for w in sorted(words)}
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(f'{k}(?:{"|".join(v)})' for k, v in first.items())})(?![\p{{L}}\p{{N}}])"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: int = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, part, unit, license, common, size, template_size): part is line, paragraph, text or passage; unit is its number from 1,
    a passage's that of its first word."""
    templates = templates or TEMPLATES
    sets = {k: bigrams(v) for k, v in templates.items()}
    taken = anchors(sets, threshold)
    words = {w for v in taken.values() for w in v}
    at: dict[str, list] = {w: [(k, q, n) for a, k, q, n in places(templates, taken) if a == w] for w in sorted(words)}
    known = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(len(b)).alias("m"), F.array(*[F.lit(x) for x in b]).alias("b")) for k, b in sorted(sets.items()) if b])
    low = min(len(b) for b in sets.values()) * threshold // (200 - threshold)
    high = max(len(b) for b in sets.values()) * (200 - threshold) // threshold + 1
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    part = lambda name, unit, body, only=None: F.struct(F.lit(name).alias("part"), unit.cast("int").alias("unit"), body.alias("body"), (F.lit(only).cast("string") if only is None else only).alias("wanted"))
    lines = F.transform(F.split("t", "\n"), lambda x, i: part("line", i + 1, x))
    blocks = F.filter(F.transform(F.split("t", r"\n[ \t\r]*\n"), lambda x, i: part("paragraph", i + 1, x)), lambda x: x["body"].contains("\n"))
    whole = F.array(part("text", F.lit(1), F.col("t")))
    # Passages: places of anchor words, then what each of them puts where, then the words there. A start is one number, template and place, so that
    # equal ones go by hashing.
    named = {k: (i, len(template_words(v))) for i, (k, v) in enumerate(sorted(templates.items()))}
    entry = lambda k, q, n: F.struct(F.lit(named[k][0]).cast("bigint").alias("template"), F.lit(q).alias("offset"), F.lit(n).alias("n"))
    known_places = F.create_map(*[x for w, v in at.items() for x in (F.lit(w), F.array(*[entry(*y) for y in v]))])
    hits = F.filter(F.transform("tw", lambda x, i: F.struct(x.alias("word"), (i + 1).alias("at"))), lambda h: h["word"].isin(*sorted(words)))
    put = lambda h, k: F.shiftleft(k["template"], 40) + F.greatest(F.lit(1), F.least(h["at"] - k["offset"], F.size("tw") - k["n"] + 1))
    numbers = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(known_places, h["word"]), lambda k: put(h, k)))))
    of = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(n).alias("n")) for k, (_, n) in named.items()])
    starts = F.transform(numbers, lambda x: F.struct(F.get(of, F.shiftright(x, 40).cast("int"))["license"].alias("license"), x.bitwiseAND(F.lit((1 << 40) - 1)).cast("int").alias("start"), F.get(of, F.shiftright(x, 40).cast("int"))["n"].alias("n")))
    passages = F.transform("starts", lambda x: part("passage", x["start"], F.array_join(F.slice("tw", x["start"], x["n"]), " "), x["license"]))
    # Texts, and then parts, without any anchor can't match and aren't taken apart.
    anchor = any_of(words)
    some = docs.where(F.lower(t).rlike(anchor)).select("doc_id", t.alias("t"), F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("tw"))
    placed = some.select("doc_id", "t", "tw", hits.alias("hits")).select("doc_id", "t", "tw", starts.alias("starts"))
    units = placed.select("doc_id", F.inline(F.concat(F.filter(F.concat(lines, blocks, whole), lambda u: F.lower(u["body"]).rlike(anchor)), passages)))
    w = units.select("doc_id", "part", "unit", "wanted", F.regexp_extract_all(F.lower("body"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    # As rows of a generator: what follows reads the finished sets.
    sized = w.select("doc_id", "part", "unit", "wanted", F.inline(F.array(F.struct(F.array_distinct(F.when(F.size("w") > 1, pairs).otherwise(F.col("w"))).alias("b")))))
    near = F.filter(known, lambda k: (F.col("wanted").isNull() | (F.col("wanted") == k["license"])) & (F.size("b") * (200 - threshold) >= k["m"] * threshold) & (F.size("b") * threshold <= k["m"] * (200 - threshold)))
    matched = F.transform(near, lambda k: F.struct(k["license"].alias("license"), F.size(F.array_intersect("b", k["b"])).alias("common"), F.size("b").alias("size"), k["m"].alias("template_size")))
    matched = F.filter(matched, lambda m: 200 * m["common"] >= threshold * (m["size"] + m["template_size"]))
    none = F.array().cast("array<struct<license:string,common:int,size:int,template_size:int>>")
    return sized.select("doc_id", "part", "unit", F.inline(F.when(F.size("b").between(max(low, 1), high), matched).otherwise(none)))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "part", "unit", "license", "common", "size", "template_size", F.round(2 * F.col("common") / (F.col("size") + F.col("template_size")), 6).alias("dice"))


def _sql() -> str:
    values = ", ".join(f"('{k}', [{', '.join(repr(x) for x in bigrams(v))}])" for k, v in sorted(TEMPLATES.items()))
    put = ", ".join(f"('{a}', '{k}', {q}, {n})" for a, k, q, n in places(TEMPLATES, anchors({k: bigrams(v) for k, v in TEMPLATES.items()}, THRESHOLD)))
    return rf"""
    with known(license, tb) as (values {values}),
    places(word, template, o, n) as (values {put}),
    texts as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as tw from documents),
    starts as (select distinct r, template, n, greatest(1, least(p - o, size - n + 1)) as start from (select r, len(tw) as size, unnest(tw) as word, generate_subscripts(tw, 1) as p from texts) join places using (word)),
    units as (
      select doc_id, 'line' as part, generate_subscripts(l, 1)::int as unit, unnest(l) as body from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
      union all select * from (select doc_id, 'paragraph' as part, generate_subscripts(l, 1)::int as unit, unnest(l) as body from (select doc_id, regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n') as l from documents)) where contains(body, chr(10))
      union all select doc_id, 'text', 1, coalesce(text, '') from documents),
    w as (select doc_id, part, unit, null as wanted, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') as w from units
      union all select doc_id, 'passage', start::int, template, list_slice(tw, start, start + n - 1) from starts join texts using (r)),
    s as (select doc_id, part, unit, wanted, list_distinct(case when len(w) > 1 then list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2]) else w end) as b from w),
    c as (select s.doc_id, s.part, s.unit, license, len(list_intersect(b, tb))::int as common, len(b)::int as size, len(tb)::int as template_size from s join known on (wanted is null or wanted = license) and len(b) > 0 and len(b) * {200 - THRESHOLD} >= len(tb) * {THRESHOLD} and len(b) * {THRESHOLD} <= len(tb) * {200 - THRESHOLD})
    select *, round(2 * common / (size + template_size), 6) as dice from c where 200 * common >= {THRESHOLD} * (size + template_size)
    """


SQL = _sql()
