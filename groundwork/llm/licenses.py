"""Licence scans by a positional rare-token index, in DataFrame expressions alone.

Each template (a whole notice or a phrase, with mandatory key phrases) is indexed under its RARE
words of highest inverse document frequency among the templates, with their places and weights. A
text's indexed words are looked up; each posting proposes an alignment, the place where the template
would begin. Alignments sorted by template and place are joined with their neighbours (a template has
at most RARE postings), those of enough weight are kept, and the mandatory phrases are verified word
by word at their places. The score is the largest share of a found template's weight whose words
stand at their places. Cost is linear in the text but for that sort; nothing is shuffled. Texts
that hold no template's anchor word cannot verify a phrase and are only counted.

Defined results: a null or empty text has no words and no labels (empty strings), null places and
score 0; overlapping places all count; repeated rows repeat their results; extra columns are
ignored; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import LOWER, UPPER


def worded(text: str) -> str:
    """The words of a notice as scan() takes them, joined by blanks."""
    return " ".join(re.findall(WORD, text.lower()))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The wording of public notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
be misrepresented; you must not claim that you wrote the original software."""

#: label, words of the template, mandatory phrases in it. The first three are the base phrases.
TEMPLATES = [
    ("mit", "mit license", ["mit license"]),
    ("apache", "apache license", ["apache license"]),
    ("gpl", "general public license", ["general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted", "free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "source and binary forms"]),
    ("mit-notice", worded(MIT), ["permission is hereby granted free of charge", "the software is provided as is"]),
    ("isc", worded(ISC), ["with or without fee is hereby granted", "the author disclaims all warranties"]),
    ("bsd-2-clause", worded(f"{BSD_HEAD} {BSD_TAIL}"), ["redistribution and use in source and binary forms", "provided with the distribution this software is provided by"]),
    ("bsd-3-clause", worded(f"{BSD_HEAD} {BSD_NAMES} {BSD_TAIL}"), ["redistribution and use in source and binary forms", "to endorse or promote products derived from this software"]),
    ("apache-2.0-notice", worded(APACHE), ["apache license version 2 0", "unless required by applicable law"]),
    ("gpl-3.0-or-later", worded(GPL), ["gnu general public license as published by the free software foundation", "either version 3 of the license"]),
    ("gpl-2.0-or-later", worded(GPL.replace("version 3", "version 2")), ["gnu general public license as published by the free software foundation", "either version 2 of the license"]),
    ("mpl-2.0-notice", worded(MPL), ["subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed"]),
    ("unlicense", worded(UNLICENSE), ["free and unencumbered software released into the public domain"]),
    ("zlib", worded(ZLIB), ["in no event will the authors be held liable", "must not be misrepresented"]),
]
BASE = 3
RARE, ENOUGH = 5, 0.55  # postings a template; share of their weight that proposes an alignment
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def index(templates: list = TEMPLATES) -> tuple[list[dict[int, float]], dict[str, list[tuple[int, int, float]]]]:
    """Per template the weight of each place; postings: word -> (template, place, share of the template's postings' weight)."""
    words = [t.split() for _, t, _ in templates]
    idf = {w: math.log((1 + len(words)) / (1 + sum(w in x for x in words))) + 0.01 for x in words for w in x}
    weights, postings = [], {}
    for t, x in enumerate(words):
        total = sum(idf[w] for w in x)
        weights.append({i: idf[w] / total for i, w in enumerate(x)})
        best = sorted(range(len(x)), key=lambda i: (-idf[x[i]], i))[:RARE]
        share = sum(idf[x[i]] for i in best)
        for i in best:
            postings.setdefault(x[i], []).append((t, i, idf[x[i]] / share))
    return weights, postings


def anchor(phrases: list[str]) -> str:
    """A pattern without which the phrases cannot stand in a text."""
    longest = max((w for p in phrases for w in p.split()), key=len)
    return longest if len(longest) >= 5 else GAP.join(map(re.escape, max(phrases, key=len).split()[:3]))


def place(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(items) -> str:
    return "array(" + ", ".join(items) + ")"


def scan(docs: DataFrame, templates: list = TEMPLATES, base: int = BASE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    weights, postings = index(templates)
    words = [t.split() for _, t, _ in templates]
    looked_up = "map(" + ", ".join(f"{quoted(w)}, {array(f'named_struct("t", {t}L, "p", {p}L, "w", {x!r}D)' for t, p, x in found)}" for w, found in postings.items()) + ")"
    phrases = array(array(f"named_struct('at', {place(words[t], p.split())}, 'words', {array(map(quoted, p.split()))})" for p in ps) for t, (_, _, ps) in enumerate(templates))
    whole = array(array(f"named_struct('word', {quoted(w)}, 'w', {weights[t][i]!r}D)" for i, w in enumerate(x)) for t, x in enumerate(words))
    labels = array(quoted(x) for x, _, _ in templates)
    # w: the text's words. hits: an alignment (template, place) for each posting of each word, sorted.
    hits = f"""array_sort(flatten(transform(w, (x, i) -> transform(
        filter(coalesce({looked_up}[x], array()), p -> i >= p.p), p -> named_struct('t', p.t, 'at', i - p.p, 'w', p.w)))))"""
    same = lambda k: f"if(get(h, i + {k}).t = x.t and get(h, i + {k}).at = x.at, get(h, i + {k}).w, 0D)"
    others = " + ".join(map(same, range(1, RARE)))
    summed = f"transform(h, (x, i) -> if(get(h, i - 1).t = x.t and get(h, i - 1).at = x.at, null, named_struct('t', x.t, 'at', x.at, 'w', x.w + {others})))"
    verified = f"""filter({summed}, x -> x.w >= {ENOUGH}D and
        forall({phrases}[int(x.t)], k -> slice(w, int(x.at) + k.at + 1, size(k.words)) = k.words))"""
    scored = f"""array_max(transform(v, x -> aggregate({whole}[int(x.t)], named_struct('i', 0, 's', 0D),
        (a, y) -> named_struct('i', a.i + 1, 's', a.s + if(get(w, int(x.at) + a.i) = y.word, y.w, 0D)), a -> least(a.s, 1D))))"""
    names = lambda v: f"array_join(array_sort(array_distinct(transform({v}, x -> {labels}[int(x.t)]))), ',')"
    own = f"filter(v, x -> x.t < {base})"
    told = f"""named_struct('n_base', bigint(size({own})), 'first_word', array_min(transform({own}, x -> x.at)), 'last_word', array_max(transform({own}, x -> x.at)),
        'base_labels', {names(own)}, 'labels', {names("v")}, 'score', coalesce({scored}, 0D))"""
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    lowered = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), r'{WORD}', 0)"
    found = let("w", lowered, let("h", hits, let("v", verified, told)))
    anchors = "(?i)" + "|".join(sorted({anchor(ps) for _, _, ps in templates}))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = text.select("doc_id", F.regexp_count("text", F.lit(ANY_CASE)).cast("long").alias("n_words"), F.when(F.col("text").rlike(anchors), F.expr(found)).alias("f"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("f.n_base", F.lit(0)).alias("n_base"), F.col("f.first_word").cast("long").alias("first_word"), F.col("f.last_word").cast("long").alias("last_word"),
        F.coalesce("f.base_labels", F.lit("")).alias("base_labels"), F.coalesce("f.labels", F.lit("")).alias("labels"), F.round(F.coalesce("f.score", F.lit(0.0)), 6).alias("score"),
    )
