"""License scans: each line, or each run of words of a template's size, normalised, against licence templates by the
Dice coefficient of their word bigrams.

Only DataFrame expressions: size bounds drop the templates that a line of so many bigrams can't reach, the bigrams of
the lines that are left meet those of the templates in a join with the (fixed, small) template table.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import without

#: Notices by which texts name their licence, and opening sentences of common licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("proprietary", "All rights reserved."),
]

#: Whole licences and the notices that files carry, without their copyright lines.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
WHOLE = [
    ("MIT", TEMPLATES[2][1] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", TEMPLATES[6][1] + " " + _GPL_REST),
    ("GPL-2.0", TEMPLATES[7][1] + " " + _GPL_REST),
    ("BSD-2-Clause", _BSD + " " + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD + " " + _BSD_NAME + " " + _BSD_DISCLAIMER),
    ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_DISCLAIMER),
    ("0BSD", _GRANT + ". " + _ISC_DISCLAIMER),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("MPL-2.0", TEMPLATES[10][1] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


def normal_words(text: str):
    """Lower-cased words: runs of letters and digits, each dot inside a number kept with it."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+", " "), r"\.(?!\p{N})", " ")), " +"), lambda w: w != "")


def bigrams(words: str):
    """The set of pairs of neighbouring words, each pair joined by a space."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda x, y: F.concat(x, F.lit(" "), y)))


def _known(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template (its number), licence, b (its bigrams) and tn (their number) of templates of two words or more."""
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(name).alias("licence"), F.lit(t).alias("t")) for i, (name, t) in enumerate(templates)))
    return spark.range(1).select(F.inline(rows)).withColumn("w", normal_words("t")).withColumn("b", bigrams("w")).select("template", "licence", "b", F.size("b").alias("tn")).where("tn > 0")


def _words_to_hold(known: DataFrame, low: float) -> list[str]:
    """Words of which any text, line or run that reaches the threshold holds one.

    It holds the share `low` of a template's bigrams, hence one of any set that is larger than the others; of each
    template so many bigrams are covered by words, the longest first, where words of other templates don't do.
    """
    chosen: list[str] = []
    for row in sorted(known.select("template", "b", "tn").collect(), key=lambda r: (r.tn, r.template)):
        least = row.tn - math.ceil(row.tn * low - 1e-9) + 1
        left = [pair for pair in row.b if not any(w in pair for w in chosen)]
        while row.tn - len(left) < least:
            word = max((w for pair in left for w in pair.split(" ")), key=lambda w: (len(w), w))
            chosen.append(word)
            left = [pair for pair in left if word not in pair]
    return chosen


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id, th (what equal keys and texts share), text, and the row as given."""
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"))


def _holds(text, words: list[str]):
    """Whether the lower-cased text has one of the words somewhere; it is lower-cased once."""
    return F.exists(F.array(F.lower(text)), lambda t: functools.reduce(lambda x, y: x | y, (F.contains(t, F.lit(w)) for w in words), F.lit(False)))


def scan(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with licence (of the best line), dice (double) and licence_lines (long, lines that reach the threshold).

    A line counts if twice the bigrams it shares with a template are at least threshold times the bigrams of both. The
    best line has the largest dice, then the first licence by name. Texts without such a line, null and empty ones
    have null, null and 0. Rows with equal key and text get equal results; null keys are keys. Lines of one word have
    no bigram and never match. Columns named as the new ones are replaced, all others stay.

    Work: texts, then lines, without any of the few words that a match can't do without are passed over before they
    are normalised. Line texts never cross the network; bigrams meet the broadcast templates first, and only those
    that match are counted by line. The documents then meet the few that have a licence by key.
    """
    spark = docs.sparkSession
    docs = without(docs, "licence", "dice", "licence_lines")
    known = _known(spark, templates)
    sizes = sorted({r.tn for r in known.select("tn").distinct().collect()})
    fits = F.lit(False)
    low = threshold / (2 - threshold) - 1e-9
    for n in sizes:
        fits = fits | F.col("ln").between(low * n, n / low)
    keyed = _keyed(docs, text, key)
    words = _words_to_hold(known, low)
    lines = keyed.where(_holds(F.col("text"), words)).select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line", "s")).where(_holds(F.col("s"), words))
    lines = lines.withColumn("w", normal_words("s")).where(F.size("w") >= 2).withColumn("b", bigrams("w")).withColumn("ln", F.size("b")).where(fits)
    pairs = lines.select("id", "th", "line", "ln", F.explode("b").alias("bigram"))
    table = known.select("template", "licence", "tn", F.explode("b").alias("bigram"))
    met = pairs.join(F.broadcast(table), "bigram").where((F.col("ln") >= low * F.col("tn")) & (F.col("ln") <= F.col("tn") / low))
    dice = met.groupBy("id", "th", "line", "ln", "template", "licence", "tn").agg(F.countDistinct("bigram").alias("common")).withColumn("dice", 2 * F.col("common") / (F.col("ln") + F.col("tn"))).where(F.col("dice") >= threshold)
    best = dice.groupBy("id", "th").agg(F.max("dice").alias("dice"), F.countDistinct("line").alias("licence_lines"), F.min_by("licence", F.struct(-F.col("dice"), "licence")).alias("licence"))
    out = keyed.join(best, ["id", "th"], "left")
    return out.select(*(F.col("given").getField(c).alias(c) for c in docs.columns), "licence", "dice", F.coalesce("licence_lines", F.lit(0).cast("long")).alias("licence_lines"))


def scan_runs(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES + WHOLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with licence (of the best run of words) and dice (double); newlines are spaces, so a notice may be wrapped
    or lie inside a longer line, and a text of a template's size is such a run itself.

    Against a template of n bigrams all runs of n * low to n / low bigrams are taken, where low is threshold / (2 -
    threshold): with others no set of n can reach the threshold, but for runs that repeat their own bigrams. The best
    run has the largest dice, then the first licence by name. Other rules are those of scan().

    Work: texts without any of the words that a match can't do without are passed over, as in scan(). A run that loses an end which isn't in the template gains, so runs begin where the text has a bigram of the
    template. Texts are dealt with where they lie; only those that hold a share of low of a template's bigrams are
    looked at run by run.
    """
    spark = docs.sparkSession
    docs = without(docs, "licence", "dice")
    known = _known(spark, templates)
    low = threshold / (2 - threshold)
    keyed = _keyed(docs, text, key)
    n = F.greatest(F.size("w") - 1, F.lit(0))
    texts = keyed.where(_holds(F.col("text"), _words_to_hold(known, low))).select("id", "th", normal_words("text").alias("w")).select("id", "th", F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda x, y: F.concat(x, F.lit(" "), y)).alias("s"))
    table = F.broadcast(known.withColumn("share", F.ceil(F.col("tn") * F.lit(low) - F.lit(1e-9))))
    # One pass over the words drops what no template knows, before each template is asked
    every = F.broadcast(known.select(F.explode("b").alias("x")).agg(F.collect_set("x").alias("every")))
    held = texts.crossJoin(every).withColumn("d", F.array_intersect("s", "every")).drop("every")
    met = held.join(table, F.size(F.array_intersect("d", "b")) >= F.col("share")).select("id", "th", "s", "template", "licence", "b", "tn", "share")
    most = F.floor(F.col("tn") / low + 1e-9).cast("int")
    # Runs are cut out before they are dealt out, so that no row carries the words of a whole text along
    begins = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.array_contains("b", F.get("s", i)))
    runs = met.select("id", "th", "template", "licence", "b", "tn", "share", F.explode(F.transform(begins, lambda i: F.slice("s", i + 1, most))).alias("r"))
    runs = runs.where((F.size("r") >= F.col("share")) & (F.size(F.array_intersect("r", "b")) >= F.col("share")))

    def dice(length):
        own = F.slice("r", 1, length)
        return 2 * F.size(F.array_intersect(own, "b")) / (F.size(F.array_distinct(own)) + F.col("tn"))

    scored = runs.withColumn("dice", F.array_max(F.transform(F.sequence(F.col("share").cast("int"), F.size("r")), dice))).where(F.col("dice") >= threshold)
    best = scored.groupBy("id", "th").agg(F.max("dice").alias("dice"), F.min_by("licence", F.struct(-F.col("dice"), "licence")).alias("licence"))
    out = keyed.join(best, ["id", "th"], "left")
    return out.select(*(F.col("given").getField(c).alias(c) for c in docs.columns), "licence", "dice")
