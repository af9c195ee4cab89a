"""License scans: Dice coefficient over word bigrams, with DataFrame functions only.

Every line of a text, and every template, is normalised: lower case, all but letters and digits to single spaces.
Its set of word bigrams is compared with each template's: 2 * common / (size + size). A coefficient of t or more
needs sizes s and m with t / (2 - t) * m <= s <= (2 - t) / t * m, so the size of a line tells which templates it
may match, before any bigram is made: a template of m bigrams is not compared with lines outside its bounds.

scan_licenses compares whole lines with the short notices. find_passages compares runs of words anywhere in a text,
across line ends and inside longer lines, with the notices and with header and body texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices, and the opening paragraphs of licences, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "MIT": ["Released under the MIT License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

#: The header that files carry, and paragraphs of the body of full texts, as their publishers word them.
BODIES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ],
    "BSD": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Whole licences, as their publishers word them, without names and years.
WHOLE = {
    "MIT": [
        """MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    ],
    "ISC": [
        """ISC License. Copyright. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "BSD": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
    ],
}
#: What find_passages looks for: the notices first, then the bodies, then whole licences.
PASSAGES = {name: TEMPLATES.get(name, []) + BODIES.get(name, []) + WHOLE.get(name, []) for name in [*TEMPLATES, *(n for n in BODIES if n not in TEMPLATES)]}


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """The distinct bigrams of an array of words; a single word is its own."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def least_common(size: int, percent: int) -> int:
    """How many of a template's bigrams a match has at least: t / (2 - t) of them."""
    return -(-percent * size // (200 - percent))


def template_rows(spark, templates: dict[str, list[str]], percent: int) -> list:
    """(license, template, _template, low, high): the bigrams of each template and the sizes a match may have."""
    rows = [(name, k, text) for name, texts in templates.items() for k, text in enumerate(texts)]
    d = spark.createDataFrame(rows, "license string, template int, _text string")
    d = d.select("license", "template", bigrams(F.split(normalised(F.col("_text")), " ")).alias("_template"))
    return [(r[0], r[1], r[2], least_common(len(r[2]), percent), (200 - percent) * len(r[2]) // percent) for r in d.collect()]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, license, template, common, size_line, size_template, dice): every line that matches a template.

    line counts from 0. A match has a Dice coefficient of percent / 100 or more; a line that matches several
    templates gives a row for each. Lines end at newlines; texts are scanned whole, in one pass without an exchange.
    Since a match has a known share of its template's bigrams, it has one at least of any set that leaves out fewer;
    texts without any of these bigrams are passed over, and no match is lost by that.

    A null or empty text, and lines without letters or digits, match nothing; a very long line is one line, and fits no
    template; repeated rows each give theirs; a null id stays null; an empty table gives an empty table; other columns
    are not read. Templates are a list given in code: their bigrams are literals of the plan.
    """
    shapes = template_rows(docs.sparkSession, templates, percent)
    if not shapes:
        shapes = [("", 0, [], 1, 0)]
    needed = {g for _, _, found, least, _ in shapes for g in sorted(found, key=lambda g: (-len(g), g))[: len(found) - least + 1]}
    some = "(?<![^ \\n])(?:" + "|".join(map(re.escape, sorted(needed))) + ")(?![^ \\n])"
    plain = F.regexp_replace(F.lower(text_col), r"[^\p{L}\p{N}\n]+", " ")
    d = docs.select(F.col(id_col), plain.alias("_plain")).where(F.col("_plain").rlike(some))
    d = d.select(id_col, F.posexplode(F.split("_plain", "\n")).alias("line", "_line")).withColumn("_line", F.trim("_line"))
    d = d.where(F.col("_line").rlike(some)).withColumn("_bigrams", bigrams(F.split("_line", " "))).withColumn("size_line", F.size("_bigrams"))
    given = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(k).alias("template"), F.array(*map(F.lit, g)).cast("array<string>").alias("bigrams"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for n, k, g, lo, hi in shapes])
    fitting = F.filter(given, lambda t: (t["low"] <= F.col("size_line")) & (F.col("size_line") <= t["high"]))
    d = d.withColumn("_t", F.explode(fitting)).withColumn("common", F.size(F.array_intersect("_bigrams", "_t.bigrams")))
    both = F.col("size_line") + F.size("_t.bigrams")
    d = d.where(200 * F.col("common") >= percent * both)
    return d.select(id_col, "line", "_t.license", "_t.template", "common", "size_line", F.size("_t.bigrams").alias("size_template"), (2.0 * F.col("common") / both).alias("dice"))


def either(words: list[str]) -> str:
    """A pattern of these words that branches at their letters, so that few of them are tried at a place."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(h) + (either(t) if any(t) else "") for h, t in sorted(heads.items(), reverse=True)]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def find_passages(docs: DataFrame, templates: dict[str, list[str]] = PASSAGES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, words, license, template, common, size_passage, size_template, dice): the passages that match a template.

    A passage is a run of words of the whole text, across line ends; word counts from 0. It matches with a Dice
    coefficient of percent / 100 or more. A template of M running bigrams is compared with all runs of up to
    (200 - percent) / percent * M bigrams that begin and end with one of its own (others at the ends only lower the
    coefficient), from every word. Of matches of one template that overlap, the best is given, then the first, then
    the shortest; matches of different templates are all given. Templates have two words or more.

    Runs are compared only from places where enough of the template's bigrams follow within that length, so other
    texts cost one look at each bigram, and no match is lost by that. Texts are scanned in one pass without an exchange.
    A null or empty text matches nothing; a very long text is scanned whole; repeated rows each give theirs; a null id
    stays null; an empty table gives an empty table; other columns are not read. Templates are a list given in code:
    their bigrams are literals of the plan.
    """
    given = [(name, k, text) for name, texts in templates.items() for k, text in enumerate(texts)]
    plain = docs.sparkSession.createDataFrame(given, "license string, template int, _text string").select("license", "template", F.split(normalised(F.col("_text")), " ").alias("_w"))
    shapes = []
    for name, k, w in plain.collect():
        running = [f"{a} {b}" for a, b in zip(w, w[1:])]
        if not running:
            raise ValueError(f"template {k} of {name} has fewer than two words")
        known = sorted(set(running))
        shapes.append((name, k, known, least_common(len(known), percent), (200 - percent) * len(running) // percent))
    if not shapes:
        shapes = [("", 0, [""], 1, 0)]
    every = sorted({g for s in shapes for g in s[2]})
    # as in scan_licenses: a match has one at least of any set of bigrams that leaves out fewer than it needs
    needed = {g for _, _, known, least, _ in shapes for g in sorted(known, key=lambda g: (-len(g), g))[: len(known) - least + 1]}
    some = f"(?<![^ ]){either(sorted(needed))}(?![^ ])"
    least = min(s[3] for s in shapes)

    # a generator, so that filters on the column do not move below it and make it again, in lambdas for each element
    once = lambda c: F.explode(F.array(c))
    gram = lambda i: F.concat(F.get("_w", i), F.lit(" "), F.get("_w", i + 1))
    places = F.sequence(F.lit(0), F.size("_w") - 2)
    d = docs.select(F.col(id_col), once(normalised(F.col(text_col))).alias("_plain")).where(F.col("_plain").rlike(some))
    d = d.select(id_col, once(F.split("_plain", " ")).alias("_w")).where(F.size("_w") > 1)
    hit = F.filter(F.transform(places, lambda i: F.struct(i.alias("at"), gram(i).alias("gram"))), lambda h: h["gram"].isin(every))
    d = d.withColumn("_hits", once(hit)).where(F.size("_hits") >= least)

    def shape(name, k, known, least, longest):
        grams = F.split(F.lit("|".join(known)), r"\|")  # folded to one value
        at = F.transform(F.filter("_hits", lambda h: F.array_contains(grams, h["gram"])), lambda h: h["at"])
        return F.struct(F.lit(name).alias("license"), F.lit(k).alias("template"), grams.alias("known"), F.lit(least).alias("least"), F.lit(longest).alias("longest"), at.alias("at"))

    empty = "array<struct<license:string,template:int,known:array<string>,least:int,longest:int,at:array<int>>>"
    d = d.withColumn("_t", F.explode(F.filter(F.array(*[shape(*s) for s in shapes]).cast(empty), lambda t: F.size(t["at"]) >= t["least"])))
    d = d.select(id_col, "_w", "_t.*")
    # starts from which enough of the template's bigrams come within the longest run
    dense = lambda i: F.get("at", i + F.col("least") - 1) - F.get("at", i) < F.col("longest")
    starts = F.transform(F.filter(F.sequence(F.lit(0), F.size("at") - F.col("least")), dense), lambda i: F.get("at", i))
    d = d.withColumn("_starts", once(starts)).where(F.size("_starts") > 0)

    def best_run(start):
        """The best run from this word: running counts of distinct bigrams, and of the template's among them."""
        run = F.transform(F.sequence(start, F.least(start + F.col("longest") - 1, F.size("_w") - 2)), gram)

        def counted(run):
            return F.transform(run, lambda g, i: F.when(F.array_position(run, g) != i + 1, 0).when(F.array_contains("known", g), 2).otherwise(1))

        def add(s, new):
            a, c, n = s["a"] + (new > 0).cast("int"), s["c"] + (new == 2).cast("int"), s["n"] + 1
            here = 2.0 * c / (a + F.size("known"))
            better = (new == 2) & (here > s["best"]["dice"])
            found = F.struct(here.alias("dice"), (-start).alias("back"), (-n).alias("less"), c.alias("common"), a.alias("size"))
            return F.struct(a.alias("a"), c.alias("c"), n.alias("n"), F.when(better, found).otherwise(s["best"]).alias("best"))

        zero = F.lit(0)
        none = F.struct(F.lit(0.0).alias("dice"), (-start).alias("back"), zero.alias("less"), zero.alias("common"), zero.alias("size"))
        first = F.struct(zero.alias("a"), zero.alias("c"), zero.alias("n"), none.alias("best"))
        # one run in an array, so that it is made once and not for each of its bigrams
        return F.get(F.transform(F.array(run), lambda r: F.aggregate(counted(r), first, add)["best"]), F.lit(0))

    matches = F.filter(F.transform("_starts", best_run), lambda m: 200 * m["common"] >= percent * (m["size"] + F.size("known")))
    d = d.withColumn("_m", once(F.sort_array(matches, asc=False))).where(F.size("_m") > 0)
    # a run of n bigrams has n + 1 words: from -back to -back + n
    apart = lambda x, y: (-x["back"] - x["less"] < -y["back"]) | (-y["back"] - y["less"] < -x["back"])
    kept = F.aggregate("_m", F.slice("_m", 1, 0), lambda done, m: F.when(F.exists(done, lambda x: ~apart(x, m)), done).otherwise(F.array_append(done, m)))
    d = d.select(id_col, "license", "template", F.size("known").alias("size_template"), F.explode(kept).alias("_m"))
    return d.select(id_col, (-F.col("_m.back")).alias("word"), (1 - F.col("_m.less")).alias("words"), "license", "template", F.col("_m.common").alias("common"), F.col("_m.size").alias("size_passage"), "size_template", F.col("_m.dice").alias("dice"))
