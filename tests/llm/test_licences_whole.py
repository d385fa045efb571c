"""Licence files and headers as they stand in repositories, and a plain cosine."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from accordant.llm import license_scan
from accordant.llm.queries import op1_license_scan

GPL = """ * This program is free software%s you can redistribute it and/or modify
 * it under the terms of the GNU %s as published by
 * the Free Software Foundation; either version %s of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
CODE = "\n\nint main(void) {\n    return step(7);\n}\n\nstatic long total_of(long a) { return a; }\n"


def header(kind, version, mark=";"):
    return "/*\n * frob.c: frobs\n *\n" + GPL % (mark, kind, version) + " */" + CODE * 40


def wrapped(text, mark="", width=9):
    words = text.split(" ")
    return "\n".join(mark + " ".join(words[i : i + width]) for i in range(0, len(words), width))


FILES = {
    "GPL-2.0": [header("General Public License", "2"), "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n" + "other terms of the text " * 50],
    "GPL-3.0": [header("General Public License", "3", ":"), "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + "other terms of the text " * 50],
    "AGPL-3.0": [header("Affero General Public License", "3", ":"), "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007\n\nmore"],
    "LGPL-2.1": [header("Lesser General Public License", "2.1").replace("program", "library")],
    "LGPL-3.0": [header("Lesser General Public License", "3", ":")],
    "BSD-2-Clause": ["Copyright (c) 2019, A. Person\nAll rights reserved.\n\n" + wrapped(license_scan._BSD) + "\n\n" + wrapped(license_scan._AS_IS)],
    "BSD-3-Clause": [
        "Copyright (c) 2019, A. Person\nAll rights reserved.\n\n" + wrapped(license_scan._BSD) + "\n" + wrapped(license_scan._BSD_NAMES) + "\n\n" + wrapped(license_scan._AS_IS),
        "# Copyright 2011 Someone\n#\n" + wrapped(license_scan._BSD, "# ") + "\n#\n" + wrapped(license_scan._BSD_NAMES, "# ") + "\n#\n" + wrapped(license_scan._AS_IS, "# ") + CODE * 60,
    ],
    "MIT": ["MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrapped(license_scan._MIT_GRANT) + "\n\n" + wrapped(license_scan._MIT_REST.strip())],
    "ISC": ["ISC License\n\nCopyright (c) 2020, A. Person\n\n" + wrapped(license_scan._ISC) + "\n\n" + wrapped(license_scan._ISC_REST.strip())],
    "Unlicense": [wrapped(license_scan._UNLICENSE + license_scan._UNLICENSE_REST)],
    "Apache-2.0": ["// Copyright 2021 Someone\n//\n" + wrapped(license_scan._APACHE + license_scan._APACHE_REST, "// ") + CODE * 30, "   Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS " * 2],
    "EPL-2.0": [" * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/" + CODE],
    None: ["This program is free software and everyone likes it", "we may redistribute the parcels and modify the route", "x " * 5000, ""],
}


def test_files_of_each_licence(spark):
    rng = random.Random(4)
    other = [" ".join(rng.choice(("river", "stone", "of", "the", "and", "a", "to", "is", "software", "2", "3", "bank", "open")) for _ in range(30)) for _ in range(300)]
    wanted = [(license, text) for license, texts in FILES.items() for text in texts]
    rows = [(i, f"p{i}/f", text) for i, text in enumerate([t for _, t in wanted] + other)]
    got = {r.doc_id: r.own_license for r in license_scan.own_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {i: got[i] for i, _ in enumerate(wanted)} == {i: license for i, (license, _) in enumerate(wanted)}
    assert len(got) == len(rows) and all(got[i] is None for i in range(len(wanted), len(rows)))


def words(text):
    return re.findall(r"[^\W_]+", text.lower(), re.A) if text.isascii() else []


def plain(texts, threshold):
    """Own licence and score of each text: every unit against every template, all weights of all words."""
    lines = [line for t in texts for line in t.split("\n")]
    frequency = {}
    for line in lines:
        for w in set(words(line)):
            frequency[w] = frequency.get(w, 0) + 1
    weight = lambda w: math.log((1 + len(lines)) / (1 + frequency.get(w, 0))) + 1

    def vector(text):
        out = {}
        for w in words(text):
            out[w] = out.get(w, 0) + weight(w)
        return out

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / norm if norm else 0.0

    templates = [(name, vector(t)) for name, t in license_scan.TEMPLATES]

    def units(text):
        each = text.split("\n")
        yield text
        yield from each
        for inside in (lambda line: words(line), lambda line: line.strip()[:1] in set("#/*;-%!")):
            run = []
            for line in each:
                if inside(line) and line.strip():
                    run.append(line)
                else:
                    yield "\n".join(run)
                    run = []
            yield "\n".join(run)

    out = []
    for text in texts:
        best = (0.0, 0, None)
        for unit in set(units(text)):
            scores = [(round(cosine(vector(unit), v), 9), -i, name) for i, (name, v) in enumerate(templates)]
            top = max(scores)
            if top[0] >= threshold and not any(n != top[2] and s > top[0] - license_scan.MARGIN for s, _, n in scores):
                best = max(best, top, key=lambda x: x[:2])
        out.append((best[2], best[0]))
    return out


def test_against_plain_cosine(spark):
    rng = random.Random(11)
    pieces = [w for _, t in license_scan.TEMPLATES for w in t.split()]
    texts = [t[:3000] for of in FILES.values() for t in of]
    for _ in range(60):
        template = rng.choice(license_scan.TEMPLATES)[1].split()
        mixed = [rng.choice(pieces) if rng.random() < 0.25 else w for w in template[: rng.randint(4, 60)]]
        texts.append("\n".join(rng.choice(("# ", "", "// ")) + " ".join(mixed[i : i + 8]) + rng.choice(("", "\n", "\n#")) for i in range(0, len(mixed), 8)))
    texts += texts[:5]
    got = license_scan.own_licenses(spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_id long, path string, text string")).collect()
    assert len(got) == len(texts)
    expected = plain(texts, license_scan.THRESHOLD)
    for r in got:
        license, score = expected[r.doc_id]
        assert (r.own_license, pytest.approx(r.own_score, abs=1e-6)) == (license, score), texts[r.doc_id]
    assert sum(e[0] is not None for e in expected) > 40


def test_odd_rows(spark):
    rows = [(None, None, None, "x"), (None, None, None, "x"), (1, "a/b", "Released under the MIT License.", "y"), (1, "a/b", "Released under the MIT License.", "y"), (2, "a/c", "\n\n#\n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, units string").withColumn("row", F.lit(1)).withColumn("word", F.lit("w"))
    got = sorted((r.doc_id or 0, r.own_license or "", r.origin) for r in license_scan.license_scan(df).collect())
    assert got == [(0, "", "none"), (0, "", "none"), (1, "MIT", "own"), (1, "MIT", "own"), (2, "", "none")]


def test_query_has_every_origin(spark):
    got = {(r.origin, r["count"] > 0) for r in op1_license_scan(spark, "/root/testdata/sf0.01").groupBy("origin").count().collect()}
    assert got == {("own", True), ("inherited", True), ("none", True)}
