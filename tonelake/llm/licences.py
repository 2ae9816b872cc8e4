"""Licence scans with a positional rare-token index, in DataFrame functions only.

Every text becomes its index words with their positions, and the documents
that hold a word give its IDF.  The postings table has a row for every index
word of a licence template with the word's offset there.  Of each template's
key phrase the two words of highest IDF are looked up first: an occurrence at
position ``p`` implies the template's start ``p - offset``, and only starts
that both words imply are candidates.  A candidate's text is then joined with
all postings of the template: its key phrase has to stand there whole, and the
IDF of the words in place, over that of all words, is its score.  Every step
is a join or a sum over rows, so work is linear in the texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small_table, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SLOTS = 4096
#: IDF is counted in these, so that sums do not depend on their order.
_UNIT = 1_000_000


@dataclass(frozen=True)
class Template:
    """``words`` in order; ``key`` marks the mandatory phrase [start, stop)."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]


def template(label: str, text: str, key: str) -> Template:
    words, must = tuple(re.findall(WORD, text.lower())), tuple(re.findall(WORD, key.lower()))
    at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
    return Template(label, words, (at, at + len(must)))


# The phrases every scan reports.
BASE = (
    template("cc-by", "cc by", "cc by"),
    template("gpl", "general public license", "general public license"),
    template("reserved", "all rights reserved", "all rights reserved"),
)
# Texts and notices of common public licences, and sentences that name one.
LICENCES = (
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    template(
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
        "unless required by applicable law or agreed to in writing",
    ),
    template("mit", "released under the mit license", "mit license"),
    template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
        "hereby granted free of charge",
    ),
    template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template(
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "redistribute it and or modify it under the terms of the gnu general public license",
    ),
    template(
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
        the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
        "gnu lesser general public license",
    ),
    template(
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        "gnu affero general public license",
    ),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
        "redistribution and use in source and binary forms",
    ),
    template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template(
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "source code form is subject to the terms of the mozilla public license",
    ),
    template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
        TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        "use copy modify and or distribute",
    ),
    template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        "free and unencumbered software",
    ),
    template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
        the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you
        wrote the original software.""",
        "in no event will the authors be held liable",
    ),
)
# Function words outside key phrases are no index words.
COMMON = frozenset("the of to and in is a or for this any with into be that are from by on as it an not you at all if no".split())


def postings(base: tuple[Template, ...], licences: tuple[Template, ...]) -> list[tuple[int, str, bool, str, int, bool]]:
    """``(template, label, is base, word, offset, in the key phrase)`` of every index word; a base phrase is all key."""
    out = []
    for n, t in enumerate(base + licences):
        for i, w in enumerate(t.words):
            key = n < len(base) or t.key[0] <= i < t.key[1]
            if key or w not in COMMON:
                out.append((n, t.label, n < len(base), w, i, key))
    return out


def positions(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(uid, doc_id, n_words, codes)``; a code is ``position * 4096 + word id``."""
    if len(vocabulary) > _SLOTS:
        raise ValueError("too many index words")
    ids = F.create_map(*[F.lit(x) for i, w in enumerate(vocabulary) for x in (w, i)])
    words = F.regexp_extract_all(ascii_lower(text_of()), F.lit(WORD), F.lit(0))

    def code(w: Column, i: Column) -> Column:
        return F.when(w.isin(vocabulary), i.cast("long") * _SLOTS + F.element_at(ids, w))

    return docs.select("doc_id", words.alias("words")).select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.filter(F.transform("words", code), lambda c: c.isNotNull()).alias("codes"),
    )


def scan(docs: DataFrame, base: tuple[Template, ...] = BASE, licences: tuple[Template, ...] = LICENCES) -> DataFrame:
    """One row per document: words, base places, labels and score.

    ``base_starts`` lists every place of every base phrase, ``found`` the
    ``(label, start)`` spans of the licence templates, whose start may lie
    before the text where only the key phrase stands.  ``score`` is the
    largest share of a found template's IDF that stands in place, 0 without
    any.  Null and empty texts have no words and no labels; repeated rows give
    repeated results; an empty table gives none; other columns are left out.
    """
    spark, listed = docs.sparkSession, postings(base, licences)
    vocabulary = sorted({p[3] for p in listed})
    ids = {w: i for i, w in enumerate(vocabulary)}
    hits = materialize(positions(docs.select("doc_id", "text"), vocabulary), "licence-hits")
    n_docs = hits.count()
    words = F.transform("codes", lambda c: F.pmod(c, F.lit(_SLOTS)).cast("int"))
    freq = {r["word"]: r["n"] for r in hits.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most len(vocabulary) rows
    idf = {w: round((log((n_docs + 1) / (freq.get(i, 0) + 1)) + 1.0) * _UNIT) for w, i in ids.items()}

    # Tables of the templates' words; their size is that of the templates.
    rows = [(ids[w], t, off, key, idf[w]) for t, _, _, w, off, key in listed]
    index = F.broadcast(small_table(spark, rows, "word int, t int, off int, key boolean, idf long"))
    rare = []
    for t in range(len(base + licences)):
        of = sorted({(-idf[w], w) for n, _, _, w, _, key in listed if n == t and key})[:2]
        rare += [(ids[w], t, off, 1 << bit) for bit, (_, w) in enumerate(of) for n, _, _, x, off, key in listed if n == t and key and x == w]
    needs = {t: sum(1 for n, _, _, w, _, key in listed if n == t and key) for t in range(len(base + licences))}
    both = {t: max(b for _, n, _, b in rare if n == t) * 2 - 1 for t in needs}
    facts = F.broadcast(small_table(spark, [(t, x.label, t < len(base), needs[t], both[t], sum(idf[w] for n, _, _, w, _, _ in listed if n == t)) for t, x in enumerate(base + licences)], "t int, label string, base boolean, need int, both int, total long"))
    lookups = F.broadcast(small_table(spark, rare, "word int, t int, off int, bit int"))

    def places(table: DataFrame) -> DataFrame:
        codes = table.select("uid", F.explode("codes").alias("c"))
        return codes.select("uid", F.pmod("c", F.lit(_SLOTS)).cast("int").alias("word"), F.floor(F.col("c") / _SLOTS).alias("pos"))

    implied = places(hits.where(F.size("codes") > 1)).join(lookups, "word").groupBy("uid", "t", (F.col("pos") - F.col("off")).alias("start")).agg(F.bit_or("bit").alias("bits"))
    candidates = materialize(implied.join(facts, "t").where("bits = both").select("uid", "t", "start"), "licence-candidates")
    asked = hits.join(candidates.select("uid").distinct(), "uid", "left_semi")
    stand = places(asked).join(index, "word").select("uid", "t", (F.col("pos") - F.col("off")).alias("start"), "key", "idf").join(candidates, ["uid", "t", "start"], "left_semi")
    found = stand.groupBy("uid", "t", "start").agg(F.sum(F.col("key").cast("int")).alias("keys"), F.sum("idf").alias("weight")).join(facts, "t").where("keys = need")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = found.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), F.col("start")))).alias("base_starts"),
        names(F.when(F.col("base"), F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"), F.max(F.col("weight") / F.col("total")).alias("score"),
        F.array_sort(F.collect_list(F.when(~F.col("base"), F.struct("label", "start")))).alias("found"),
    )
    none = lambda kind: F.array().cast(kind)
    return hits.select("uid", "doc_id", "n_words").join(per, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("base_starts", none("array<bigint>")).alias("base_starts"), F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("found", none("array<struct<label:string,start:bigint>>")).alias("found"),
    )
