import random

import numpy as np
from pyspark.sql import functions as F

from mnemora.llm.toxicity import features, fit_model, packed, score_toxicity, train_classifier

BAD = ["grumblesnark", "vilewort", "scornlet"]


def corpus(n=900, seed=0):
    r = random.Random(seed)
    syllables = ["ba", "ko", "ri", "te", "lu", "mo", "shi", "na"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.choice([5, 40, 200]))]
        toxic = i % 6 == 0
        for _ in range(r.randrange(1, 4) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD).upper() if r.random() < 0.2 else r.choice(BAD))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = train_classifier(docs, labels, F.col("doc_id") % 3 != 1, sample=250)
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    held = [(got[i] >= 0.7, bool(y)) for i, _, y in rows if i % 3 == 1]
    assert np.mean([a == b for a, b in held]) >= 0.98
    assert not any(a and not b for a, b in held)


def test_odd_rows_have_a_score(spark, docs, rows, empty):
    train = [(i, t, y) for i, t, y in corpus(200)]
    model = fit_model([packed(features(t)) for _, t, _ in train], np.array([y for *_, y in train], bool), 0.2)
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not (r.text or "").strip()} == {model.score("")}
    assert score_toxicity(empty, model).count() == 0
    assert model.score("a" * 2_500_000 + " vilewort scornlet") > model.score("a" * 2_500_000)  # stretches, whole texts


def test_labels_of_one_kind_or_none(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert train_classifier(docs, labels, F.lit(True)).score("x") < 0.01
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 <= train_classifier(docs, none, F.lit(True)).score(None) <= 1
    assert 0 <= train_classifier(empty, labels, F.lit(True)).score("") <= 1


def test_all_labelled_rows_and_features_teach(spark):
    """Words of which each is in a tenth of the toxic texts: sixteen of these have too few of any."""
    r, words = random.Random(5), ["".join(random.Random(k).choices("qxzvwy", k=7)) for k in range(10)]
    plain = lambda: " ".join("".join(r.choices("abcdeo", k=4)) for _ in range(40))
    rows = [(i, f"{plain()} {words[i // 4 % 10]} {plain()}" if i % 4 == 0 else plain(), int(i % 4 == 0)) for i in range(480)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = train_classifier(docs, labels, F.lit(True), sample=16)
    assert all(model.score(f"{plain()} {w}") > model.score(plain()) + 0.2 for w in words)
    long = "".join(chr(0x4E00 + (i * i * 7 + i) % 20000) for i in range(60_000))  # more than 2**15 features
    docs = spark.createDataFrame([(i, (long if i < 6 else "") + f" text {i % 3}") for i in range(12)], "doc_id long, text string")
    model = train_classifier(docs, spark.createDataFrame([(i, int(i < 6)) for i in range(12)], "doc_id long, toxic int"), F.lit(True))
    assert (model.weight != 0).sum() > 2**15
