import random
import re
import textwrap
from pathlib import Path

import pytest

from mnemora.llm.licenses import BODIES, PASSAGES, TEMPLATES, find_passages, scan_licenses
from mnemora.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def words(text):
    return re.sub(r"[^\w]|_", " ", (text or "").lower()).split()


def brute(text, templates, percent):
    """Every run from every word, and of those that overlap the best."""
    w, out = words(text), []
    for name, texts in templates.items():
        for k, x in enumerate(texts):
            t = words(x)
            m, longest, found = set(zip(t, t[1:])), (200 - percent) * (len(t) - 1) // percent, []
            for i in range(len(w) - 1):
                for n in range(1, min(longest, len(w) - 1 - i) + 1):
                    a = set(zip(w[i : i + n], w[i + 1 : i + n + 1]))
                    c = len(a & m)
                    if 200 * c >= percent * (len(a) + len(m)):
                        found.append((-2.0 * c / (len(a) + len(m)), i, n + 1, c, len(a)))
            kept = []
            for f in sorted(found):
                if all(f[1] + f[2] <= g[1] or g[1] + g[2] <= f[1] for g in kept):
                    kept.append(f)
            out += [(f[1], f[2], name, k, f[3], f[4], len(m)) for f in kept]
    return sorted(out)


def got(spark, texts, **more):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in find_passages(d, **more).collect():
        out[r.doc_id].append((r.word, r.words, r.license, r.template, r.common, r.size_passage, r.size_template))
    return [sorted(out[i]) for i in range(len(texts))]


def test_runs_equal_brute_force(spark):
    short = {"A": ["one two three one two four five"], "B": ["two three four", "six seven eight nine ten eleven"], "C": ["a b"]}
    rng = random.Random(3)
    say = "one two three four five six seven eight nine ten eleven a b x".split()
    texts = [" ".join(rng.choice(say) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    for k in range(40):  # copies with words left out, put in and changed
        w = [x for t in rng.sample([x for v in short.values() for x in v], 2) for x in t.split()] * rng.randrange(1, 3)
        texts.append(rng.choice(" \n").join(rng.choice([x, x, x, x, x, "x", f"{x} x", ""]) for x in w))
    texts += [None, "", "one", " \n"]
    for percent in (80, 60):
        assert got(spark, texts, templates=short, percent=percent) == [brute(t, short, percent) for t in texts]


@pytest.mark.parametrize("license,template", [(n, k) for n, v in PASSAGES.items() for k in range(len(v))][::5])
def test_wrapped_embedded_and_full_texts_are_found(spark, license, template):
    notice = PASSAGES[license][template]
    filler = " ".join(f"filler{i} word{i % 7}" for i in range(300))
    texts = ["\n".join(" * " + x for x in textwrap.wrap(notice, 40)), f"{filler} {notice} {filler}", "\n".join(textwrap.wrap(f"{filler} {notice} {filler} {notice}", 60)), filler]
    counts = [sum(f[2:4] == (license, template) for f in found) for found in got(spark, texts)]
    assert counts == [1, 1, 2, 0]


def test_a_full_licence_is_found_where_lines_are_not(spark):
    full = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + "\n\n".join(textwrap.fill(x, 70) for x in BODIES["MIT"])
    d = spark.createDataFrame([(1, full), (None, full), (1, full)], "doc_id long, text string")
    found = sorted((r.doc_id is None, r.license, r.template, r.dice) for r in find_passages(d).collect())
    n = len(TEMPLATES["MIT"])
    assert found == sorted((none, "MIT", n + k, 1.0) for none in (False, False, True) for k in range(2))
    assert scan_licenses(d).count() == 0
    assert find_passages(d, templates={}).count() == find_passages(d.limit(0)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_the_query_finds_all_that_the_lines_have(spark):
    key = lambda q: {(r.doc_id, r.license, r.template) for r in QUERIES[q](spark, str(DATA)).collect()}
    lines, passages = key("op10_license_scan"), key("op10_license_passages")
    assert lines and lines <= passages


def test_whole_licences_are_found(spark):
    """Wrapped over lines, with a holder and a year, between other words."""
    from mnemora.llm.licenses import WHOLE

    holder = WHOLE["MIT"][0].replace("Copyright (c).", "Copyright (c) 2021 Somebody Else.")
    words = f"some code here {holder} and more of it".split()
    text = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    d = spark.createDataFrame([(1, text), (2, "nothing of the kind in here at all")], "doc_id long, text string")
    got = find_passages(d).collect()
    assert {r.doc_id for r in got} == {1} and {r.license for r in got} == {"MIT"}
    assert max(r.size_template for r in got) > 100 and max(r.dice for r in got if r.size_template > 100) > 0.95
