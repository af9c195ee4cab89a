"""Documents with every odd case, and plain helpers."""

import random
import zlib

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, slot string, score string, taken string, target string, class string, line string, _key string, id string"


def documents(seed=0, n=120):
    """(doc_id, text, source): copies, near copies, null and empty and long texts, null and repeated ids, equal rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 5))) for _ in range(80)]
    say = lambda k: " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(k))
    rows = []
    for i in range(n):
        if i % 5 == 4:
            old = rows[r.randrange(len(rows))][1] or ""
            w = old.split(" ")
            if i % 2:
                w[r.randrange(len(w))] = "changed"
            rows.append((i, " ".join(w), f"s{r.randrange(3)}"))
        else:
            rows.append((i, say(r.choice([1, 2, 5, 30, 60])), f"s{min(r.randrange(9), 4)}"))
    rows += [(900, None, "s0"), (901, "", "s0"), (902, " \n\t ", None), (903, say(30000), "s1"), (None, "no id here", None), (None, None, None)]
    rows += [(904, "twice the same row", "s2"), (904, "twice the same row", "s2"), (904, "another text of that id", "s2"), (905, "Ünï cödé 漢字 🙂 İ ſ", "S"), (906, "A\x1cB\x85C\xa0D A", "s1")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


def frame(spark, rows):
    """The rows as documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * 10) for i, t, s in rows], SHAPE)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def words_of(text):
    return (text or "").encode().lower().split()


def crc(i):
    return zlib.crc32(str(i).encode())
