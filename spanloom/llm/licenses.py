"""Operator 9, licence scans: a positional index of rare template words. DataFrame functions only.

A first pass counts in how many documents each template word stands; this gives
its IDF. The index keeps each template's words of highest IDF with their
positions (at most ``anchors`` x templates postings, a bound set by parameters,
not by the corpus). A second pass looks up each file's index words, turns every
hit into votes (template, place of the template's word 0 in the file), and also
verifies where each mandatory key phrase stands word for word. Votes are grouped
by template and place: a licence is named where at least ``least_share`` of the
template's index words agree on one relative position and the key phrase stands
at that same position.

Defined results. Null text counts as empty (0 words, no labels, score 0). Null or
repeated ids: every row keeps its own result, rows are told apart by a number
given when the first results are stored. Repeated notices vote for their own
places, in texts of any length. Empty tables give empty results. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.llm.common import documents, let, stored, text_or_empty

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    """A notice in lower-case words, and the phrase in it that must stand word for word."""

    label: str
    notice: str
    key: str


#: Short notices that name a public licence.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-grant", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation"),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc0", "licensed under cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template("reserved", "all rights reserved", "all rights reserved"),
)


def notice(text: str) -> str:
    """The words of a notice as the scan sees them."""
    return " ".join(re.findall(r"[a-z0-9]+", text.lower()))


#: Whole texts and standard headers of public licences.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
BSD_2 = _BSD_HEAD + _BSD_TAIL
BSD_3 = _BSD_HEAD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_TAIL
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"""
APACHE_2 = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, {version}
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."""
MPL_2 = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
CC_LONG = "This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{code}/4.0/"

TEMPLATES += (
    Template("mit-text", notice(MIT), notice("permission notice shall be included in all copies or substantial portions of the software")),
    Template("isc-text", notice(ISC), notice("provided that the above copyright notice and this permission notice appear in all copies")),
    Template("bsd-2-clause-text", notice(BSD_2), notice("other materials provided with the distribution this software is provided by the copyright holders")),
    Template("bsd-3-clause-text", notice(BSD_3), notice("endorse or promote products derived from this software without specific prior written permission")),
    Template("zlib-text", notice(ZLIB), notice("the origin of this software must not be misrepresented")),
    Template("unlicense", notice(UNLICENSE), notice("free and unencumbered software released into the public domain")),
    Template("bsl-1.0", notice(BOOST), notice("obtaining a copy of the software and accompanying documentation covered by this license")),
    Template("apache-2.0-header", notice(APACHE_2), notice("you may not use this file except in compliance with the license")),
    *(
        Template(f"{label}-header", notice(GPL_HEADER.format(name=name, version=version)), notice(f"gnu {name} public license as published by the free software foundation {version}"))
        for label, name, version in (
            ("gpl-2.0-or-later", "General", "either version 2 of the License, or (at your option) any later version"),
            ("gpl-3.0-or-later", "General", "either version 3 of the License, or (at your option) any later version"),
            ("lgpl-3.0-or-later", "Lesser General", "either version 3 of the License, or (at your option) any later version"),
            ("agpl-3.0-or-later", "Affero General", "either version 3 of the License, or (at your option) any later version"),
        )
    ),
    Template("mpl-2.0-header", notice(MPL_2), notice("if a copy of the mpl was not distributed with this file")),
    *(
        Template(f"{label}-text", notice(CC_LONG.format(name=name, code=label[3:-4])), notice(f"creative commons {name} 4 0 international license"))
        for label, name in (("cc-by-4.0", "Attribution"), ("cc-by-sa-4.0", "Attribution-ShareAlike"), ("cc-by-nc-4.0", "Attribution-NonCommercial"), ("cc-by-nd-4.0", "Attribution-NoDerivatives"))
    ),
)


def licence_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased.

    ``lower`` changes more letters than A-Z, but no word count and, the Kelvin
    sign apart (it would become a k), no comparison with an ASCII word.
    """
    low = F.lower(F.replace(text_or_empty(text), F.lit("K"), F.lit("ÿ")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def stands_at(w: Column, i: Column, phrase: str) -> Column:
    """Whether the words of ``phrase`` stand in ``w`` from place ``i`` (from 0) on."""
    out = F.lit(True)
    for k, x in enumerate(phrase.split()):
        out = out & F.coalesce(F.get(w, i + k) == x, F.lit(False))
    return out


def document_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """In how many rows each word of the vocabulary stands, over the whole table; one row a word reaches the driver."""
    found = F.array_intersect(licence_words(F.col(text)), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in rows}


def build_index(frequencies: dict[str, int], templates=TEMPLATES, anchors: int = 4) -> dict[str, list[tuple[int, int, int]]]:
    """word -> (template, position, number of the anchor in its template): each template's rarest words."""
    index: dict[str, list[tuple[int, int, int]]] = {}
    for t, template in enumerate(templates):
        notice = template.notice.split()
        rarest = sorted(range(len(notice)), key=lambda p: (frequencies.get(notice[p], 0), p))[:anchors]
        for a, p in enumerate(sorted(rarest)):
            index.setdefault(notice[p], []).append((t, p, a))
    return index


def key_postings(frequencies: dict[str, int], templates=TEMPLATES) -> dict[str, list[tuple[int, int, int]]]:
    """word -> (template, the word's place in the key phrase, the phrase's place in the notice): each phrase by its rarest word."""
    found: dict[str, list[tuple[int, int, int]]] = {}
    for t, template in enumerate(templates):
        key, whole = template.key.split(), template.notice.split()
        at = next(p for p in range(len(whole)) if whole[p : p + len(key)] == key)
        rarest = min(range(len(key)), key=lambda p: (frequencies.get(key[p], 0), p))
        found.setdefault(key[rarest], []).append((t, rarest, at))
    return found


def entries(w: Column, index: dict[str, list[tuple[int, int, int]]], keys: dict[str, list[tuple[int, int, int]]], templates=TEMPLATES) -> Column:
    """Votes and verified key phrases of a file: (template, place of its word 0, anchor or -1 for the phrase).

    Each word that the index knows is looked up once, in a literal map from words to
    what they vote for and to the key phrases around them.
    """
    row = lambda t, at, a: F.struct(t.alias("t"), at.cast("int").alias("at"), a.alias("a"))
    ints = lambda **named: F.struct(*[F.lit(v).alias(k) for k, v in named.items()])
    looked_up = sorted(set(index) | set(keys))
    nothing = F.array().cast("array<struct<t:int,at:int,a:int>>")

    def known(word: str) -> Column:
        votes = F.array(*[ints(t=t, p=p, a=a) for t, p, a in index.get(word, [])]).cast("array<struct<t:int,p:int,a:int>>")
        phrases = [F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(at).alias("at"), F.split(F.lit(templates[t].key), " ").alias("words")) for t, p, at in keys.get(word, [])]
        return F.struct(votes.alias("votes"), F.array(*phrases).cast("array<struct<t:int,p:int,at:int,words:array<string>>>").alias("phrases"))

    table = F.create_map(*[x for word in looked_up for x in (F.lit(word), known(word))])
    hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(looked_up), F.struct(i.alias("i"), x.alias("x")))), lambda h: h.isNotNull())

    def of_hit(h: Column) -> Column:
        votes = F.transform(h["k"]["votes"], lambda v: row(v["t"], h["i"] - v["p"], v["a"]))
        stands = lambda k: (h["i"] >= k["p"]) & (F.slice(w, F.greatest(F.lit(1), h["i"] - k["p"] + 1), F.size(k["words"])) == k["words"])
        phrases = F.transform(F.filter(h["k"]["phrases"], stands), lambda k: row(k["t"], h["i"] - k["p"] - k["at"], F.lit(-1)))
        return F.concat(votes, phrases)

    wanted = F.arrays_overlap(w, F.array(*map(F.lit, looked_up)))
    found = F.transform(hits, lambda h: F.struct(h["i"].alias("i"), F.try_element_at(table, h["x"]).alias("k")))
    return F.when(wanted, F.flatten(F.transform(found, of_hit))).otherwise(nothing)


def scan(docs: DataFrame, templates=TEMPLATES, anchors: int = 4, least_share: float = 0.75, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: word count, base places and labels, labels with the method's, and the best share."""
    vocabulary = sorted({x for t in templates for x in t.notice.split()})
    frequencies = document_frequencies(docs, vocabulary, text)
    index, keys = build_index(frequencies, templates, anchors), key_postings(frequencies, templates)

    def of_words(w: Column) -> Column:
        firsts = sorted({p.split()[0] for p in BASE})
        maybe = F.arrays_overlap(w, F.array(*map(F.lit, firsts)))
        base = F.transform(w, lambda x, i: F.when(x.isin(firsts), F.coalesce(*[F.when(stands_at(w, i, p), F.struct(i.alias("at"), F.lit(name).alias("label"))) for p, name in BASE.items()])))
        none = F.array().cast("array<struct<at:int,label:string>>")
        return F.struct(F.size(w).alias("n"), F.when(maybe, F.array_compact(base)).otherwise(none).alias("base"), entries(w, index, keys, templates).alias("e"))

    first = stored(docs.select(F.col(id).alias("doc_id"), let(licence_words(F.col(text)), of_words).alias("s")).withColumn("row", F.monotonically_increasing_id()), "licences")
    size = F.element_at(F.create_map(*[F.lit(x) for t, template in enumerate(templates) for x in (t, min(anchors, len(template.notice.split())))]), F.col("t"))
    label = F.element_at(F.create_map(*[F.lit(x) for t, template in enumerate(templates) for x in (t, template.label)]), F.col("t"))
    placed = (
        first.select("row", F.explode("s.e").alias("e"))
        .groupBy("row", "e.t", "e.at")
        .agg(F.bit_count(F.bit_or(F.when(F.col("e.a") >= 0, F.expr("shiftleft(1, e.a)")).otherwise(0))).alias("agree"), F.max((F.col("e.a") < 0).cast("int")).alias("phrase"))
        .filter("phrase = 1")
        .select("row", (F.col("agree") / size).alias("share"), label.alias("label"))
    )
    found = placed.groupBy("row").agg(F.collect_set(F.when(F.col("share") >= least_share, F.col("label"))).alias("named"), F.max("share").alias("score"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.col("s.base.label")
    at = F.col("s.base.at")
    return first.join(found, "row", "left").select(
        "doc_id",
        F.col("s.n").cast("long").alias("n_words"),
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce(F.col("named"), F.array().cast("array<string>")))).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.col("score"), F.when(F.size(at) > 0, 0.5).otherwise(0.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
