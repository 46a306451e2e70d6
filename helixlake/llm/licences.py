"""Licence scan: sparse TF-IDF cosine of licence files and headers to templates, then inheritance from the nearest directory.

Three kinds of units of a text are compared with the templates: the whole text, its header (the lines before the first
blank one), and each line that speaks of a licence, alone and with the one or two lines after it (notices are wrapped).
Only texts with such a line have units. The best similarity of a file's units, from `least` on, gives its own licence. A
file whose unit holds at least `file_share` of its words, or whose name is that of a licence file, licences its
directory; files without a licence of their own take that of the nearest directory above them. Terms are runs of a-z and
0-9 after lower-casing. Inverse document frequencies of the templates' terms are counted over all files; a term that no
template has weighs as one that no file has. All of it is DataFrame operations.

Short licences have their full text among the templates; long ones the notice that they ask for, and their title.

Defined cases: a null or empty text has no licence of its own and may inherit; a null path is a file in no directory; a null
file number has no licence of its own; of equally similar templates the first by name counts, of equally similar units the
one with most words; of several licence files in a directory the most similar, then the first by licence; a text of any
length is taken whole; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.common import store

#: Usual wordings of licence notices, titles, and full texts of short licences.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
        OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    ),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
        copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
        received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
LICENCE_LINE = "(?i)licen[cs]e|copyright|public domain|redistribut"
LICENCE_NAME = "(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
SPLIT = "[^a-z0-9]+"


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def _template_terms(spark: SparkSession) -> DataFrame:
    """template, licence, term, tf: some hundred rows, given by TEMPLATES."""
    rows = spark.createDataFrame([(k, name, wording) for k, (name, wording) in enumerate(TEMPLATES)], "template int, licence string, wording string")
    return rows.select("template", "licence", F.explode(_terms(F.col("wording"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))


def weights(files: DataFrame) -> DataFrame:
    """term and idf of the templates' terms, over all files."""
    spark = files.sparkSession
    vocabulary = sorted({t for _, wording in TEMPLATES for t in re.findall("[a-z0-9]+", wording.lower())})
    own = F.array_intersect(_terms(F.col("text")), F.array(*[F.lit(t) for t in vocabulary]))
    # A null for each file counts the files.
    counts = files.select(F.explode(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = counts.where("term is null").select(F.col("df").alias("n"))
    terms = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    idf = F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    return terms.join(counts, "term", "left").crossJoin(F.broadcast(total)).select("term", idf.alias("idf"), (F.log(1.0 + F.col("n")) + 1).alias("none"))


#: Units of a text, as SQL over its lines l: the whole text, the header, and each licence line with none, one and two of
#: the lines after it.
UNITS = f"""array_distinct(concat(array(array_join(l, '\n'), array_join(slice(l, 1, first - 1), '\n')),
  flatten(transform(filter(sequence(1, size(l)), i -> l[i - 1] rlike '{LICENCE_LINE}'), i -> transform(array(1, 2, 3), n -> array_join(slice(l, i, n), '\n'))))))"""
FIRST_BLANK = "coalesce(nullif(array_position(transform(l, x -> trim(x) = ''), true), 0), size(l) + 1)"


def units(files: DataFrame) -> DataFrame:
    """file, unit and its wording. files: file, text."""
    speaking = files.where(F.col("text").rlike(LICENCE_LINE)).dropDuplicates(["file"])  # of repeated rows
    lines = speaking.select("file", F.split(F.regexp_replace("text", "\r", ""), "\n").alias("l")).withColumn("first", F.expr(f"cast({FIRST_BLANK} as int)"))
    return lines.select("file", F.posexplode(F.expr(UNITS)).alias("unit", "wording"))


def similar_units(files: DataFrame, idf: DataFrame) -> DataFrame:
    """file, licence, similarity and words of every unit's best template. files: file, text."""
    spark = files.sparkSession
    idf = F.broadcast(idf)  # one row for each template term
    terms = units(files).select("file", "unit", F.explode(_terms(F.col("wording"))).alias("term")).groupBy("file", "unit", "term").agg(F.count("*").alias("tf"))
    rest = idf.agg(F.max("none").alias("rest"))
    weighed = terms.join(idf.select("term", "idf"), "term", "left").crossJoin(F.broadcast(rest)).withColumn("w", F.col("tf") * F.coalesce("idf", "rest"))
    weighed = store(weighed.select("file", "unit", "term", "tf", "w"), "licence-terms")
    norms = weighed.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    template = _template_terms(spark).join(idf.select("term", "idf"), "term").select("template", "licence", "term", (F.col("tf") * F.col("idf")).alias("v"))
    lengths = template.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    dots = weighed.join(F.broadcast(template), "term").groupBy("file", "unit", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("length")), 6)
    scored = dots.join(F.broadcast(lengths), "template").join(norms, ["file", "unit"]).select("file", "unit", "words", "licence", cosine.alias("similarity"))
    best = F.min(F.struct((-F.col("similarity")).alias("less"), "licence", "words")).alias("best")
    return scored.groupBy("file", "unit").agg(best).select("file", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("similarity"), F.col("best.words").alias("words"))


def scan(files: DataFrame, least: float = 0.7, file_share: float = 0.5) -> DataFrame:
    """file, path, licence, origin (own, inherited or none), similarity and licence_dir for every row of files (file: a
    unique number; path; text)."""
    idf = store(weights(files), "idf")
    best = F.min(F.struct((-F.col("similarity")).alias("less"), "licence", (-F.col("words")).alias("fewer"))).alias("best")
    own = similar_units(files, idf).where(F.col("similarity") >= least).groupBy("file").agg(best)
    own = own.select("file", F.col("best.licence").alias("own"), (-F.col("best.less")).alias("similarity"), (-F.col("best.fewer")).alias("words"))
    named = files.select("file", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.size(F.coalesce(_terms(F.col("text")), F.array().cast("array<string>"))).alias("all_words"))
    named = store(named.join(own, "file", "left"), "licences")
    sources = named.where(F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(LICENCE_NAME) | (F.col("words") >= file_share * F.col("all_words"))))
    by_dir = sources.groupBy(F.col("dir").alias("licence_dir")).agg(F.min(F.struct((-F.col("similarity")).alias("less"), F.col("own").alias("licence"))).alias("best"))
    by_dir = by_dir.select("licence_dir", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("dir_similarity"))
    # Directories, not files, walk up the tree: a directory with very many files is looked up once.
    parts = F.split("dir", "/")
    above = named.where("own is null and path is not null").select("dir").distinct()
    above = above.withColumn("licence_dir", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit("")))))
    # Both sides have one row for each directory, however many files it holds.
    nearest = above.distinct().join(by_dir, "licence_dir").groupBy("dir").agg(F.max_by(F.struct("licence_dir", "licence", "dir_similarity"), F.length("licence_dir")).alias("near"))
    inherited = F.col("own").isNull() & F.col("near").isNotNull()
    return named.join(nearest, "dir", "left").select(
        "file", "path", F.coalesce("own", "near.licence").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.coalesce("similarity", "near.dir_similarity").alias("similarity"), F.when(inherited, F.col("near.licence_dir")).alias("licence_dir"),
    )
