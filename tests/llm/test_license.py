from collections import Counter
from math import log, sqrt
import re

import duckdb
import pytest

from ledgerloom.llm import license, queries

FILES = [
    (1, "/a/LICENSE", "Released under the MIT License."), (2, "/a/b/c/x.py", "hello"), (3, "/a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (4, "/z/y.py", None),
    (5, "/a/q.py", "x\nThis work is licensed under the GNU General Public License, version 3.\nfoo"), (6, None, "License to kill bananas quickly"), (7, "/a/w.py", ""),
    (8, "COPYING", "Licensed under CC BY-NC 4.0."), (8, "COPYING", "Licensed under CC BY-NC 4.0."), (9, "top.py", ""), (10, "/a/b/tie.py", "Licensed under CC BY 4.0.\nReleased under the ISC License."),
]


def scan(spark, rows):
    return license.license_scan(spark.createDataFrame(rows, "row int, path string, text string"), license.templates(spark)).collect()


def test_headers_files_and_inheritance(spark):
    got = {r.row: (r.license, r.origin, r.licensed_by) for r in scan(spark, FILES)}
    assert got == {
        1: ("MIT", "file", "/a/LICENSE"), 2: ("Apache-2.0", "inherited", "/a/b/LICENSE.txt"), 3: ("Apache-2.0", "file", "/a/b/LICENSE.txt"), 4: ("CC-BY-NC-4.0", "inherited", "COPYING"),
        5: ("GPL-3.0", "header", "/a/q.py"), 6: ("CC-BY-NC-4.0", "inherited", "COPYING"), 7: ("MIT", "inherited", "/a/LICENSE"), 8: ("CC-BY-NC-4.0", "file", "COPYING"), 9: ("CC-BY-NC-4.0", "inherited", "COPYING"),
        10: ("CC-BY-4.0", "header", "/a/b/tie.py"),
    }
    assert len(scan(spark, FILES)) == len(FILES) and scan(spark, [(1, "/x", None)])[0].origin == "none"


def plain_terms(s):
    return [t for t in re.split("[^a-z0-9]+", s.lower()) if t and t not in license.COMMON]


def plain_units(path, text):
    """Lines, paragraphs and whole licence files, line by line."""
    lines, paragraphs, held, was = text.split("\n"), [], [], None
    for line in [*lines, ""]:
        comment = re.match(r"[ \t]*(?:/{2,}|/?\*+|#+|;+|-{2,}|<!-+)", line)
        bare = line[comment.end() :] if comment else line
        blank = not bare.strip(" \t\r")
        if blank or was is not None and bool(comment) != was:
            paragraphs.append(held)
            held = []
        if not blank:
            held.append(bare)
        was = None if blank else bool(comment)
    return lines + ["\n".join(p) for p in paragraphs if len(p) > 1] + ([text] if re.search(license.LICENCE_FILE, path) else [])


def plain_scores(files):
    """path -> (license, score), by plain counting."""
    df, units = Counter(), []
    vocabulary = {t for _, n in license.notices() for t in plain_terms(n)}
    for path, text in files:
        own = [plain_terms(u) for u in plain_units(path, text or "")]
        units.append((path, own))
        df.update({t for u in own for t in u} & vocabulary)
    n = len(files)
    weight = lambda t: log((1 + n) / (1 + df[t])) + 1 if t in vocabulary else log((1 + n) / (1 + sqrt(n))) + 1
    vector = lambda terms: {t: c * weight(t) for t, c in Counter(terms).items()}
    known = [(name, vector(plain_terms(notice))) for name, notice in license.notices()]
    best = {}
    for path, own in units:
        for terms in own:
            if set(terms) & vocabulary:
                v = vector([t for t in terms if t in vocabulary])
                length = sqrt(sum(x * x for x in v.values()) + sum(weight(t) ** 2 for t in terms if t not in vocabulary))
                for name, w in known:
                    score = round(sum(x * w.get(t, 0) for t, x in v.items()) / length / sqrt(sum(x * x for x in w.values())), 6)
                    if score >= license.LEAST:
                        best[path] = min(best.get(path, (0, "")), (-score, name))
    return {p: (name, -score) for p, (score, name) in best.items()}


def test_scores_against_brute_force(spark, texts):
    lines = ["Licensed under the Apache License", "Released under the MIT License, really", "copyright nobody at all", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0.", license.PERMIT, "word " * 3000 + "MIT"]
    files = [*((f"/f{i}", x) for i, x in enumerate(lines)), *((f"/t{k}", v) for k, v in texts.items()), ("/d/LICENSE", f"MIT\n\n{license.KEEP}\nother words\n\n{license.NO_WARRANTY}")]
    got = {r.path: (r.license, r.score) for r in scan(spark, [(i, *f) for i, f in enumerate(files)]) if r.origin != "inherited" and r.license}
    assert got == plain_scores(files) and {"/f0", "/f1", "/f3", "/f5", "/d/LICENSE"} <= set(got) and "/f6" not in got


def test_a_score_that_rounds_up_to_the_least(spark):
    """0.59999962, of a unit so long that its weights differ by more than the score."""
    files = [("/a/x.txt", "unlicense " * 251 + "zzz " * 112002)]
    got = scan(spark, [(1, *files[0])])[0]
    assert {"/a/x.txt": (got.license, got.score)} == plain_scores(files) == {"/a/x.txt": ("Unlicense", 0.6)}


GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
import os
"""
APACHE = """/*
 * Copyright 2020 Somebody
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() { return 0; }
"""


@pytest.mark.parametrize("path,text,want", [
    ("/a/LICENSE", f"MIT License\n\nCopyright (c) 2021 Some Body\n\n{license.PERMIT}\n\n{license.KEEP}\n\n{license.NO_WARRANTY}", "MIT"), ("/a/LICENSE", f"{license.PERMIT}\n\n{license.KEEP}\n", "MIT"),
    ("/a/x.py", "# SPDX-License-Identifier: MIT\nprint()", "MIT"), ("/a/x.c", "// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("/a/x.c", "/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"),
    ("/a/x.py", GPL, "GPL-3.0"), ("/a/x.py", GPL.splitlines()[0][2:] + "\nmore\n", None), ("/a/x.c", APACHE, "Apache-2.0"), ("/a/x.js", "// This source code is licensed under the MIT license found in the\n// LICENSE file in the root directory of this source tree.\nfoo()", "MIT"),
    ("/a/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n\nPreamble\n" + "and much more about it " * 500, "GPL-2.0"),
    ("/a/LICENSE", "\n\n".join([license.BSD_HEAD, license.BSD_SOURCE, license.BSD_BINARY, license.BSD_NAMES, license.BSD_END]), "BSD-3-Clause"), ("/a/LICENSE", "\n\n".join([license.BSD_HEAD, license.BSD_SOURCE, license.BSD_BINARY, license.BSD_END]), "BSD-2-Clause"),
    ("/a/readme", "A license to kill. The software of the warranty was free of charge, as the copyright of the public work.", None),
])
def test_real_notices(spark, path, text, want):
    """Among many files of prose, so that usual words weigh little."""
    prose = [(i, f"/p/{i}", f"Some words of file {i} about the version of a work and how you may use it.\nAnd more software.") for i in range(60)]
    got = next(r for r in scan(spark, [*prose, (100, path, text)]) if r.row == 100)
    assert got.license == want


def test_query_against_the_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    rel = con.sql(queries.ORACLES["op4_license"])
    want = sorted(map(repr, (dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall())))
    rows = queries.op4_license(spark, sf_dir).select(*rel.columns).collect()
    assert sorted(repr(r.asDict()) for r in rows) == want and {r.origin for r in rows} >= {"none", "inherited", "file"}


def test_query_and_odd_documents(spark, sf_dir, texts, odd_docs, no_docs):
    rows = queries.op4_license(spark, sf_dir).collect()
    names = {"Apache": "Apache-2.0", "MIT": "MIT", "GNU General": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0"}
    for r in rows:
        held = [n for k, n in names.items() if re.search(f"(?i)licen[^\n]*{k}|released under the {k}", texts[r.doc_id])]
        assert r.license == (held[0] if held else None) or not held and r.origin == "inherited"
    assert len(rows) == len(texts)
    assert license.op4_license(odd_docs).count() == odd_docs.count() and license.op4_license(no_docs).count() == 0


def test_only_built_in_operations(docs):
    plan = license.op4_license(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


@pytest.mark.parametrize("line,want", [
    ("// SPDX-License-Identifier: EPL-2.0", None), ("/* SPDX-License-Identifier: (GPL-2.0 OR MIT) */", "GPL-2.0 OR MIT"), ("# spdx-license-identifier: apache-2.0", "Apache-2.0"),
    ("<!-- SPDX-License-Identifier: MIT -->", "MIT"), ("// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0"), ("// SPDX-License-Identifier: MIT AND EPL-2.0", None),
    ("// SPDX-License-Identifier: LGPL-2.1+", "LGPL-2.1"), ("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", "MIT OR Apache-2.0 AND BSD-3-Clause"), ("// SPDX-License-Identifier:", None), ("see SPDX for details", None),
])
def test_tags_are_terms_of_their_own(spark, line, want):
    files = spark.createDataFrame([(1, "/a/x.c", f"{line}\nint main(void);\n"), (2, "/a/y.c", "int other;")], "row int, path string, text string")
    found = {r.row: (r.license, r.score, r.origin) for r in license.license_scan(files, license.templates(spark)).collect()}
    assert found[1] == ((want, 1.0, "header") if want else (None, None, "none")) and found[2][0] is None
