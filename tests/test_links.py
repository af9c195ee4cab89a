"""The kept index of links against a rebuild from what holds at the end, and look-ups in it."""

import random

import pytest
from pyspark.sql import functions as F

from mnemora.operators.links import COLUMNS, LINK, LinkIndex, episode_links, fact_links, refs_in_texts, refs_of_speakers

FACTS = "id long, speaker_id string, speaker_name string, keywords array<string>, topic string, persona_id string"
EPISODES = "id long, participants array<struct<id string, name string>>, keywords array<string>, persona_id string"
WORDS = ["tea", "Tea ", "coffee", "x", "12", "我们", "下雨", "a name that is much too long to be one", None, ""]


def facts(seed, n=120):
    r = random.Random(seed)
    return {i: (i, f"s{i % 7 if i % 3 else 0}", r.choice(["ann", "bob", "tea", None]), r.choice([None, r.choices(WORDS, k=3)]), r.choice(["tea", "music", None]), r.choice(["", "p1", None])) for i in range(n)}


def episodes(seed, n=40):
    r = random.Random(seed)
    return {i: (i, [(f"s{i % 7}", r.choice(["ann", "tea"])), ("bot_self", "robot"), (None, "guest")], r.choices(WORDS, k=2), "p1") for i in range(n)}


def name_of(x):
    x = "".join((x or "").lower().split())
    return x if 2 <= len(x) <= 20 and not x.isdigit() and x not in ("我们",) else ""


def rebuilt(fs, es):
    """By a plain loop: the last kind of a name counts."""
    out = {}
    for i, _, who, words, topic, persona in fs.values():
        for kind, names in (("person", [who]), ("keyword", words or []), ("topic", [topic])):
            for x in names:
                if name_of(x):
                    out[name_of(x), "fact", i] = (kind, persona or "")
    for i, people, words, persona in es.values():
        for kind, names in (("person", [n for p, n in people if p != "bot_self"]), ("keyword", words)):
            for x in names:
                if name_of(x):
                    out[name_of(x), "event", i] = (kind, persona or "")
    return {(*k, *v) for k, v in out.items()}


def all_links(spark, fs, es):
    return fact_links(spark.createDataFrame(list(fs.values()), FACTS)).unionByName(episode_links(spark.createDataFrame(list(es.values()), EPISODES)))


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_changes_equal_a_rebuild(spark, tmp_path):
    fs, es = facts(0), episodes(1)
    index = LinkIndex(spark, f"file://{tmp_path}", buckets=8)
    index.build(all_links(spark, fs, es))
    assert got(index.links()) == sorted(rebuilt(fs, es))
    # a speaker of a third of all facts gets another name
    fs = {i: (f[0], f[1], "newname" if f[1] == "s0" else f[2], *f[3:]) for i, f in fs.items()}
    es = {i: (i, [(p, "newname" if p == "s0" else n) for p, n in e[1]], *e[2:]) for i, e in es.items()}
    refs = refs_of_speakers(spark.createDataFrame(list(fs.values()), FACTS), spark.createDataFrame(list(es.values()), EPISODES), spark.createDataFrame([("s0",)], "speaker_id string"))
    one = index.relink(refs, all_links(spark, fs, es))
    assert got(index.links()) == sorted(rebuilt(fs, es))
    touched = {(r.ref, r.ref_id) for r in refs.collect()}
    assert {(r.ref, r.ref_id) for r in index.delta(one).collect()} <= touched and {i for x, i in touched if x == "fact"} == {i for i, f in fs.items() if f[1] == "s0"}
    # other words, and records that go; nothing that stays as it was is written
    gone = [i for i in fs if i % 10 == 0]
    fs = {i: (*f[:3], ["fresh", "tea"] if i % 4 == 1 else f[3], *f[4:]) for i, f in fs.items() if i not in gone}
    refs = spark.createDataFrame([("fact", i) for i in range(120) if i % 10 == 0 or i % 4 == 1 or i % 5 == 3], "ref string, ref_id long")
    before = set(got(index.links()))
    two = index.relink(refs, all_links(spark, fs, es))
    after = rebuilt(fs, es)
    assert got(index.links()) == sorted(after)
    assert {(tuple(r)[:5]) for r in index.delta(two).where("not gone").collect()} == after - before
    index.compact()
    assert got(index.links()) == sorted(after)
    assert got(index.of_names(spark.createDataFrame([("fresh",), ("none",)], "name string"))) == sorted(x for x in after if x[0] == "fresh")
    assert got(index.of_refs(spark.createDataFrame([("fact", 1), ("event", 1), ("fact", 10)], "ref string, ref_id long"))) == sorted(x for x in after if x[2] == 1)


def test_a_lost_version_is_overwritten(spark, tmp_path):
    index = LinkIndex(spark, f"file://{tmp_path}", buckets=2)
    with pytest.raises(ValueError):
        index.relink(spark.createDataFrame([], "ref string, ref_id long"), spark.createDataFrame([], LINK))
    assert got(index.links()) == []
    a, b = ("ann", "fact", 1, "person", ""), ("bob", "fact", 1, "person", "")
    index.build(spark.createDataFrame([a, a, ("ann", "fact", 1, "keyword", "")], LINK))
    assert got(index.links()) == [a]
    spark.createDataFrame([(*b, False)], f"{LINK}, gone boolean").write.parquet(f"file://{tmp_path}/rows-1")  # written, never committed
    assert got(index.links()) == [a]
    refs = spark.createDataFrame([("fact", 1), ("fact", 1)], "ref string, ref_id long")
    index.relink(refs, spark.createDataFrame([b, ("zed", "fact", 2, "person", "")], LINK))  # fact 2 was not named
    assert got(index.links()) == [b]
    index.relink(refs, spark.createDataFrame([], LINK))
    assert got(index.links()) == []
    index.build(spark.createDataFrame([], LINK))
    assert got(index.links()) == []


def test_records_of_names_in_texts(spark):
    links = spark.createDataFrame([("tea", "fact", 1, "keyword", ""), ("greentea", "fact", 2, "topic", "p1"), ("greentea", "event", 2, "keyword", "p2"), ("下雨", "fact", 3, "topic", "")], LINK)
    texts = spark.createDataFrame([(1, "I like Green Tea.", "p1"), (2, "今天下雨了", None), (3, None, ""), (4, "tea", "")], "id long, text string, persona string")
    rows = lambda **k: sorted(tuple(r) for r in refs_in_texts(texts, links, "id", "text", **k).collect())
    assert rows(persona_col="persona") == [(1, "fact", 1), (1, "fact", 2), (2, "fact", 3), (4, "fact", 1)]
    assert rows() == [(1, "event", 2), (1, "fact", 1), (1, "fact", 2), (2, "fact", 3), (4, "fact", 1)]
    assert rows(names=1) == [(1, "event", 2), (1, "fact", 2), (2, "fact", 3), (4, "fact", 1)]
    assert rows(most=1) == [(1, "event", 2), (2, "fact", 3), (4, "fact", 1)]
