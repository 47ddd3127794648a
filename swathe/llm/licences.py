"""Licence scans: windows of normalised text compared to licence texts and notices by the Dice coefficient of their word bigrams.

A text is lower-cased and cut into words of ASCII letters and digits, so line breaks, comment marks and punctuation don't
count.  A window has as many words as the template (fewer at the end of a text) and begins with one of its bigrams.  With a
and b bigrams, and o of them shared (each as often as both have it), Dice is 2 o / (a + b), which for the threshold t needs
o >= b t / (2 - t) whatever a is.  So a template is compared only where a text has so many bigrams and so many of the
template's; and a text is looked at only if it holds one of a few words without which no template can share that much.

Texts are cut into segments that overlap by the longest template, so a long text is many rows, not one large one.

Defined cases: a null or empty text, or one of a single word, matches nothing; a text with several copies of a notice counts
it once; repeated rows are scanned alike; ties for the best go to the first name; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialize

THRESHOLD = 0.8
#: Words in which a segment's windows begin.
SEGMENT_WORDS = 2048
#: What licences say, or ask to be written above a work.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
 License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
 writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
 or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "agpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
 License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
 distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
 PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public
 License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
 conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
 disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
 the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
 IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
 PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
 OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
 INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
 ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
 conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
 disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
 the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
 contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
 PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
 WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
 FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
 OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
 LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
 SUCH DAMAGE.""",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
 published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in
 the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
 PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this
 program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
 published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
 the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
 PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this
 program. If not, see <https://www.gnu.org/licenses/>.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
 the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
 WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
 ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
 OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": "Released under the MIT License.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
 (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
 distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
 following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
 Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
 MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
 DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
 OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
 (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
 distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
 following conditions:""",
    "mit-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
 with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
 sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
 means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
 arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and
 to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must
 not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be
 appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
 software. 3. This notice may not be removed or altered from any source distribution.""",
}
#: Words too common to look for, unless a template has no others.
COMMON = set("a all an and any are as at be but by can do for from if in is it its may no not of on one or see that the this to under use was with you".split())
#: Everything but letters and digits of ASCII is a word limit; the SQL of the query says the same.
BREAK = "[^a-z0-9]+"


def words_of(text: str) -> list[str]:
    return re.sub(BREAK, " ", text.lower()).split()


def least_shared(n_bigrams: int, threshold: float) -> int:
    """Bigrams that a window must share at least with a template of so many."""
    return max(1, math.ceil(n_bigrams * threshold / (2 - threshold) - 1e-9))


def needed_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which any window that matches any template has one: without them too few of the template's bigrams are left."""
    chosen: set[str] = set()
    for said in sorted(templates.values(), key=len):
        words = words_of(said)
        pairs = list(zip(words, words[1:], strict=False))
        spare = len(pairs) - least_shared(len(pairs), threshold)
        left = lambda: [p for p in pairs if not chosen.intersection(p)]
        while len(pairs) - len(rest := left()) <= spare:
            gain = Counter(w for p in rest for w in set(p))
            chosen.add(min(gain, key=lambda w: (w in COMMON or w.isdigit(), -gain[w], -len(w), w)))
    return sorted(chosen)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """For every row: distinct licences by name, how many they are, and the best match."""
    spark = docs.sparkSession
    said = {k: words_of(v) for k, v in sorted((templates or TEMPLATES).items())}
    counted = {k: Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)) for k, w in said.items()}
    # a row for each bigram of each template, numbered within it; their number is fixed, and one text holds them all
    table = "\n".join(f"{g}\t{k}\t{len(said[k])}\t{least_shared(len(said[k]) - 1, threshold)}\t{i}" for k, c in counted.items() for i, g in enumerate(c))
    field = F.split("line", "\t")
    grams = spark.range(1).select(F.explode(F.split(F.lit(table), "\n")).alias("line")).select(field[0].alias("gram"), field[1].alias("name"), *(field[k].cast("int").alias(n) for k, n in ((2, "m"), (3, "least"), (4, "gid"))))
    often = F.create_map(*(x for k, c in counted.items() for x in (F.lit(k), F.array(*map(F.lit, c.values())))))
    longest = max(map(len, said.values()))
    rows = docs.select(column("doc_id").alias("doc_id"), words(F.coalesce(column(text_col).cast("string"), F.lit(""))).alias("words"))
    held = F.arrays_overlap("words", F.lit(needed_words(templates or TEMPLATES, threshold)))
    some = materialize(rows.where(held).withColumn("row", F.monotonically_increasing_id()), "licences")
    n = F.size("words")
    segments = some.where(n > 1).select("row", n.alias("n"), "words", F.explode(F.sequence(F.lit(0), n - 2, F.lit(segment_words))).alias("from"))
    piece = F.slice("words", F.col("from") + 1, segment_words + longest)
    pairs = F.zip_with(F.slice(piece, F.lit(1), F.size(piece) - 1), F.slice(piece, F.lit(2), F.size(piece) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    found = segments.select("row", "n", "from", F.posexplode(pairs).alias("at", "gram")).join(F.broadcast(grams), "gram").where(F.col("n") - 1 >= F.col("least"))
    lists = found.groupBy("row", "from", "name").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max("least").alias("least"), F.sort_array(F.collect_list(F.struct("at", "gid"))).alias("hits")).where(F.size("hits") >= F.col("least"))

    def dice(start: Column) -> Column:
        inside = F.filter("hits", lambda x: (x["at"] >= start["at"]) & (x["at"] < start["at"] + F.col("m") - 1))
        total = F.least(F.col("m") - 1, F.col("n") - 1 - F.col("from") - start["at"]) + F.col("m") - 1
        gids = F.transform(inside, lambda x: x["gid"])
        shared = F.aggregate(F.array_distinct(gids), F.lit(0), lambda a, g: a + F.least(F.size(F.filter(gids, lambda x: x == g)), F.get(often[F.col("name")], g)))
        # as many hits as that need not be shared, but fewer can't be
        return F.when(2.0 * F.size(inside) / total >= threshold, 2.0 * shared / total)

    own = F.filter("hits", lambda x: x["at"] < segment_words)
    best = lists.withColumn("dice", F.array_max(F.transform(own, dice))).where(F.col("dice") >= threshold)
    by_row = best.groupBy("row", "name").agg(F.max("dice").alias("dice")).groupBy("row").agg(F.sort_array(F.collect_list("name")).alias("names"), F.min(F.struct((-F.col("dice")).alias("less"), "name")).alias("top"))
    matched = some.select("doc_id", "row").join(by_row, "row", "left")
    result = lambda df, names, licence, score: df.select("doc_id", F.array_join(names, ",").alias("licences"), F.size(names).cast("long").alias("n_licences"), licence.alias("best_licence"), score.alias("best_dice"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return result(matched, names, F.col("top.name"), F.round(-F.col("top.less"), 6)).unionByName(result(rows.where(~held), none, F.lit(None).cast("string"), F.lit(None).cast("double")))


def scan_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL: every window that begins with a template's bigram, in every text."""
    quoted = ", ".join("('{}', '{}')".format(k, " ".join(words_of(v))) for k, v in sorted((templates or TEMPLATES).items()))
    return f"""
with templates(name, said) as (values {quoted}),
tw as (select name, string_split(said, ' ') as ws from templates),
tb as (select name, len(ws) as m, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as g from tw),
t as (select name, m, g, count(*) as tc from tb group by 1, 2, 3),
d as (select row_number() over () as k, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{BREAK}'), lambda w: w <> '') as ws from documents),
p as (select k, len(ws) as n, ws, unnest(range(1, len(ws))) as i from d),
b as (select k, n, i, ws[i] || ' ' || ws[i + 1] as g from p),
h as (select k, n, i, name, m, t.g, tc from b join t using (g)),
w as (select s.k, s.name, s.i, s.m, least(s.m - 1, s.n - s.i) as a, x.g, least(count(*), any_value(x.tc)) as c
  from h s join h x on s.k = x.k and s.name = x.name and x.i >= s.i and x.i < s.i + s.m - 1 group by 1, 2, 3, 4, 5, 6),
q as (select k, name, max(dice) as dice from (select k, name, i, 2.0::double * sum(c) / any_value(a + m - 1) as dice from w group by 1, 2, 3) where dice >= {threshold} group by 1, 2),
f as (select k, count(*) as n_licences, string_agg(name, ',' order by name) as licences, arg_min(name, (-dice, name)) as best_licence, round(max(dice), 6) as best_dice from q group by 1)
select doc_id, coalesce(licences, '') as licences, coalesce(n_licences, 0) as n_licences, best_licence, best_dice from d left join f using (k)
"""
