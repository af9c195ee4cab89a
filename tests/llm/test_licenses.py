import re

from mnemora.llm.licenses import TEMPLATES, scan_licenses


def grams(line):
    w = re.sub(r"[^\w]|_", " ", line.lower()).split()
    return {(a, b) for a, b in zip(w, w[1:])} if len(w) > 1 else {(x,) for x in w}


def brute(rows, percent):
    out = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            for name, texts in TEMPLATES.items():
                for n, x in enumerate(texts):
                    a, b = grams(line), grams(x)
                    if a and 200 * len(a & b) >= percent * (len(a) + len(b)):
                        out.append((i is None, i or 0, k, name, n, len(a & b), len(a), len(b)))
    return sorted(out)


def test_scan_equals_brute_force(spark, docs, rows, empty):
    more = [(1, "x\nLicensed under the apache licence, Version 2.0!\ny"), (2, "Released   under the MIT-License"), (3, "Licensed under the Apache License, Version 2.0. " * 3), (None, "Licensed under CC BY-NC 4.0"), (4, "this work is licensed under the gnu general public license version 2"), (5, "MIT"), (6, None)]
    more += [(i, t) for i, t, _ in rows] + [more[1]]
    d = spark.createDataFrame([(i, t, "x") for i, t in more], "doc_id long, text string, line string")
    for percent in (80, 60):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.line, r.license, r.template, r.common, r.size_line, r.size_template) for r in scan_licenses(d, percent=percent).collect())
        assert got == brute(more, percent) and got
    assert scan_licenses(empty).count() == scan_licenses(docs, templates={}).count() == 0
