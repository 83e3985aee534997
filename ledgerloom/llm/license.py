"""License scans with DataFrame functions only.

A file's units are its lines, its paragraphs (what blank lines, or the begin and end of comments, part) and, if its name
is that of a licence file, its whole text.  Units and notices are vectors of term counts weighted by idf over all files.
Every unit of every file is scored against every notice; the best cosine of a file's units that reaches ``LEAST`` gives
it its license.  A tag (SPDX-License-Identifier) is no text to compare: an expression of known identifiers is that license with
score 1, and one with an unknown identifier names none.  A file without a license inherits that of the licence file in its nearest ancestor directory.

The notices' terms, without ``COMMON`` words, are the vocabulary, which is broadcast, being as large as the notices
given.  A unit's other words count as terms of their own with the weight of a term that every so many files hold, the
square root of all.  No unit whose weight outside the vocabulary is so great that no notice can reach ``LEAST`` meets the
notices; that is a bound, not a choice of words.  Only counts of vocabulary terms are shuffled, never texts.
Inheritance joins directories, not files: a directory's ancestors meet the directories that hold a licence file, and
what is found joins the files by directory.

Defined cases: a null text or path counts as empty; a file of which no unit reaches ``LEAST`` has license null and origin
``none`` unless it inherits; of equal scores the first license by name wins; of several licence files in one directory the best
score, then the first path; rows of one path share what any of them has; repeated rows give repeated rows; very long
lines and texts are units like others; an empty table gives no row; columns other than row, path and text aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable, stored

LEAST = 0.6
#: Scores are rounded to so many digits before they are compared with LEAST, so that one a little below reaches it, whatever the unit's length.
DIGITS = 6
LICENCE_FILE = r"(?i)(^|/)((un)?licen[cs]e|copying|notice)([-_.][^/]*)?$"
#: Names of common licenses by identifier, the wordings in which they are named, and the texts of notices and licence files.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL v3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL v3"),
    "MIT": ("MIT License", "MIT-style License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense",),
}
WORDINGS = ("{0}", "Released under the {0}.", "Licensed under the {0}.", "Licensed under {0}.", "This work is licensed under the {0}.", "This program is free software released under the terms of the {0}.", "This source code is licensed under the {0} found in the LICENSE file in the root directory of this source tree.", "Use of this source code is governed by a {0} that can be found in the LICENSE file.", "Distributed under the {0}, see the accompanying file LICENSE or copy.")
#: A tag and the expression after it; what may stand at an identifier's end; an exception, which changes no license.
TAG, TAG_LINE = r"(?i)SPDX-License-Identifier:[ \t]*([a-z0-9.+() -]*[a-z0-9.+)])", r"(?i)SPDX-License-Identifier:[^\n]*"
VERSIONS, EXCEPTION = r"(?i)(-only|-or-later|\+)$", r"(?i) +with +[^ ()]+"
OPERATORS = ("AND", "OR")
PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
NO_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GNU_FREE = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
GNU_HOPE = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
GNU_COPY = "You should have received a copy of the GNU {1} along with this {0}. If not, see https://www.gnu.org/licenses/."
GNU_TITLE = "GNU {1} Version {2} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
GNU = {
    "AGPL-3.0": ("program", "Affero General Public License", "3"),
    "GPL-2.0": ("program", "General Public License", "2"),
    "GPL-3.0": ("program", "General Public License", "3"),
    "LGPL-2.1": ("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": ("library", "Lesser General Public License", "3"),
}
APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
APACHE_END = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
TEXTS = [
    ("MIT", PERMIT), ("MIT", f"{PERMIT} {KEEP}"), ("MIT", f"MIT License Copyright (c) {PERMIT} {KEEP} {NO_WARRANTY}"),
    ("BSD-2-Clause", f"Copyright (c) All rights reserved. {BSD_HEAD} {BSD_SOURCE} {BSD_BINARY} {BSD_END}"), ("BSD-2-Clause", f"{BSD_HEAD} {BSD_SOURCE} {BSD_BINARY}"),
    ("BSD-3-Clause", f"Copyright (c) All rights reserved. {BSD_HEAD} {BSD_SOURCE} {BSD_BINARY} {BSD_NAMES} {BSD_END}"), ("BSD-3-Clause", BSD_NAMES), ("BSD-3-Clause", f"{BSD_HEAD} {BSD_SOURCE} {BSD_BINARY} {BSD_NAMES}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", APACHE), ("Apache-2.0", f"{APACHE} {APACHE_END}"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"), ("Apache-2.0", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."), ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."), ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
]
COMMON = "a an and any are as at be but by can for from have if in is it its not of on one or shall should so such that the this to with you your".split()
TERM = "[^a-z0-9]+"
#: How comments begin, and what stands for that in a text made ready: a control character, which is in no term.
COMMENT, MARK = "(?md)^[ \\t]*(?:/{2,}|/?\\*+|#+|;+|-{2,}|<!-+)", "\x01"


def notices() -> list[tuple[str, str]]:
    """(license, notice): names in all wordings, and texts."""
    named = [(k, w.format(n)) for k, names in NAMES.items() for n in names for w in WORDINGS]
    gnu = [(k, t.format(*x)) for k, x in GNU.items() for t in (GNU_FREE, f"{GNU_FREE} {GNU_HOPE} {GNU_COPY}", f"{GNU_FREE} {GNU_HOPE}", GNU_TITLE)]
    return sorted({*named, *gnu, *TEXTS})


def templates(spark: SparkSession, given: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(given or notices(), "license string, notice string")


def _terms(text) -> F.Column:
    return F.filter(F.split(F.lower(text), TERM), lambda t: (t != "") & ~t.isin(COMMON))


def _units(path: F.Column, text: F.Column) -> F.Column:
    """Lines, paragraphs of more than one line, and the whole text of a licence file."""
    marked = F.regexp_replace(text, COMMENT, MARK)
    marked = F.regexp_replace(marked, f"(?md)^([^{MARK}\n][^\n]*)\n{MARK}", f"$1\n\n{MARK}")
    marked = F.regexp_replace(marked, f"(?md)^({MARK}[^\n]*)\n([^{MARK}\n])", "$1\n\n$2")
    paragraphs = F.filter(F.split(marked, f"\n[ \t\r{MARK}]*\n"), lambda p: p.contains("\n"))
    whole = F.when(path.rlike(LICENCE_FILE), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.split(text, "\n"), paragraphs, whole)


def tagged(text: F.Column) -> F.Column:
    """The licenses that tags of a text name: an identifier, or identifiers with AND and OR between them as written, without
    brackets and exceptions.  An expression with an identifier that isn't known names none."""
    known = F.create_map(*(F.lit(x) for k in NAMES for x in (k.lower(), k)))
    plain = F.transform(F.regexp_extract_all(text, F.lit(TAG), 1), lambda e: F.filter(F.split(F.regexp_replace(e, EXCEPTION, ""), "[ ()]+"), lambda t: t != ""))

    words = F.transform(plain, lambda e: F.transform(e, lambda t: F.when(F.upper(t).isin(*OPERATORS), F.upper(t)).otherwise(F.try_element_at(known, F.lower(F.regexp_replace(t, VERSIONS, ""))))))
    return F.transform(F.filter(words, lambda e: (F.size(e) > 0) & F.forall(e, lambda w: w.isNotNull())), lambda e: F.array_join(e, " "))


def scores(files: DataFrame, given: DataFrame) -> DataFrame:
    """path, license, score: the best notice of each path that reaches LEAST."""
    total = files.count()
    held = given.distinct().withColumn("notice", F.struct("license", "notice")).select("license", "notice", F.explode(_terms(F.col("notice.notice"))).alias("term")).groupBy("license", "notice", "term").agg(F.count("*").alias("tf"))
    vocabulary = held.select("term").distinct()
    marked = files.select(F.monotonically_increasing_id().alias("file"), "path", "text")  # by itself, so that a file's units share the number
    units = marked.select("file", "path", F.posexplode(_units(F.col("path"), F.regexp_replace(F.coalesce("text", F.lit("")), TAG_LINE, ""))).alias("u", "unit"))
    words = units.select("file", "path", "u", _terms(F.col("unit")).alias("terms")).select("file", "path", "u", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    hits = stored(words.join(F.broadcast(vocabulary), "term").groupBy("file", "path", "u", "n", "term").agg(F.count("*").alias("tf")))
    df = durable(hits.groupBy("term").agg(F.countDistinct("file").alias("df")))
    idf = F.log((1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1
    own = held.join(df, "term", "left").select("license", "notice", "term", (F.col("tf") * idf).alias("v"))
    norm = own.groupBy("notice").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    own = durable(own.join(norm, "notice").select("license", F.xxhash64("notice").alias("no"), "term", (F.col("v") / F.col("norm")).alias("v")))
    weighed = hits.join(F.broadcast(df), "term").select("file", "path", "u", "n", "term", "tf", (F.col("tf") * idf).alias("w"))
    unit = weighed.groupBy("file", "path", "u", "n").agg(F.sum(F.col("w") * F.col("w")).alias("inside"), F.sum("tf").alias("known"), F.collect_list(F.struct("term", "w")).alias("terms"))
    other = F.lit(other_weight(total))
    unit = unit.withColumn("length", F.sqrt(F.col("inside") + other * other * (F.col("n") - F.col("known")))).where(F.sqrt("inside") >= (LEAST - 10.0**-DIGITS) * F.col("length"))
    dots = unit.select("file", "path", "u", "length", F.explode("terms").alias("t")).select("file", "path", "u", "length", "t.*").join(F.broadcast(own), "term").groupBy("file", "path", "u", "length", "license", "no").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    exact = files.where(F.contains(F.lower("text"), F.lit("spdx-license-identifier:"))).select("path", F.explode(tagged(F.col("text"))).alias("license"), F.lit(1.0).alias("score"))
    best = dots.select("path", "license", F.round(F.col("dot") / F.col("length"), DIGITS).alias("score")).where(F.col("score") >= LEAST).unionByName(exact)
    return best.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("b")).select("path", "b.license", (-F.col("b.less")).alias("score"))


def other_weight(total: int) -> float:
    """The idf of a term that the square root of all files hold."""
    return math.log((1 + total) / (1 + math.sqrt(total))) + 1


def _directory(path: F.Column) -> F.Column:
    """What stands before the last slash."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def license_scan(files: DataFrame, notices: DataFrame) -> DataFrame:
    """files: row (any column), path, text.  row, path, license, score, origin (header, file, inherited, none) and licensed_by, a path."""
    files = files.withColumn("path", F.coalesce("path", F.lit("")))
    found = durable(scores(files, notices))
    grants = found.where(F.col("path").rlike(LICENCE_FILE)).groupBy(_directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("less"), "path", "license")).alias("g"))
    directories = files.select(_directory(F.col("path")).alias("home")).distinct()
    steps = F.split("home", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, F.lit(1), i), "/").alias("dir")))
    ancestors = directories.select("home", F.explode(up).alias("a")).select("home", "a.*")
    nearest = ancestors.join(grants, "dir").groupBy("home").agg(F.max(F.struct("depth", "g")).alias("n"))
    nearest = durable(nearest.select("home", F.col("n.g.license").alias("from_license"), (-F.col("n.g.less")).alias("from_score"), F.col("n.g.path").alias("licensed_by")))
    own = files.select("row", "path", _directory(F.col("path")).alias("home")).join(found, "path", "left").join(nearest, "home", "left")
    by_name = F.col("path").rlike(LICENCE_FILE)
    has = F.col("license").isNotNull()
    return own.select(
        "row", "path", F.coalesce("license", "from_license").alias("license"), F.coalesce("score", "from_score").alias("score"),
        F.when(has & by_name, "file").when(has, "header").when(F.col("from_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("licensed_by")).alias("licensed_by"),
    )


def op4_license(docs: DataFrame) -> DataFrame:
    """Documents as files.  They have no paths, so they are laid out: directories of 1,000 ids by source, in these
    directories of 50 ids; every second document that speaks of a licence is a licence file, half of these in the upper
    directory."""
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.lower(F.coalesce("text", F.lit("")))
    by_name = (F.pmod(doc, F.lit(2)) == 0) & text.contains("licens")
    upper = by_name & (F.pmod(doc, F.lit(4)) == 0)
    name = F.concat(F.when(by_name, "LICENSE-").otherwise(""), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    part = lambda n: F.floor(doc / n).cast("string")
    path = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("")), part(1000), F.when(~upper, part(50)), name)
    scanned = license_scan(docs.select(F.col("doc_id").alias("row"), path.alias("path"), "text"), templates(docs.sparkSession))
    return scanned.select(F.col("row").alias("doc_id"), "path", "license", "score", "origin", "licensed_by")
