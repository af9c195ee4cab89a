"""Requests look at all that they meet: nothing is left out before it is scored."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemora.operators import requests
from mnemora.plans import catalogue
from mnemora.plans import requests as plans
from mnemora.plans.requests import AS_OF, asked
from mnemora.sources.tables import memory_facts

DATA = "/root/testdata/sf0.01"

EPISODE = "id long, start_ts long, end_ts long, title string, summary string, event_speakers array<string>, event_window string, scope string, status string, review_status string, persona_id string, confidence double, importance double, pinned boolean"


def test_old_episodes_are_scored_too(spark):
    """The best of 300 is the oldest; each episode counts once, though it meets its request by two keys."""
    rows = [(i, AS_OF - i * 3600, AS_OF - i * 3600 + 60, "view day", "nothing new", ["9", "10"], "qq:GroupMessage:view", "owner" if i % 2 else "person", "live", "", "", 0.5, 0.5, False) for i in range(1, 301)]
    rows[-1] = (*rows[-1][:3], "error day", *rows[-1][4:])
    ask = asked(spark).where("request_id = 5")
    got = requests.ranked_episodes(ask, spark.createDataFrame(rows, EPISODE), 1000).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 301)) and {r.id for r in got} == set(range(1, 301))
    assert got[0].id == 300 and got[0].score > 2.5


def test_words_of_all_rows(spark):
    """Words are weighed over all rows of a request; one without words of its query has none, as has a query without words."""
    d = spark.createDataFrame([(1, i, "a b a", "a x" if i < 3 else "x") for i in range(400)] + [(2, 0, "?", "a"), (3, 0, "a", "")], "request_id int, id int, query string, content string")
    got = {(r.request_id, r.id): r.words for r in requests.with_words(d, F.col("content")).collect()}
    assert len(got) == 402 and {got[1, i] for i in range(3)} == {1.0} and not any(w for k, w in got.items() if k[0] > 1 or k[1] > 2)


def uncut(sql, *cuts):
    for cut in cuts:
        assert cut in sql
        sql = sql.replace(cut, "")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{DATA}/events.parquet')")
    return sorted(duck.execute(sql).fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_all_facts_are_ranked_for_a_pack(spark):
    """As the SQL of retrieve_ranks would without its cuts of candidates."""
    cuts = ("QUALIFY k <= 240", "QUALIFY a <= 240 OR (o = 1 AND b <= 200)")
    want = uncut(f"WITH {plans._RANKED} SELECT request_id, id, rank, round(w, 6) FROM rk", *cuts)
    got = requests.ranked_facts(asked(spark), memory_facts(spark, DATA), AS_OF, cut=False)
    assert sorted(tuple(r) for r in got.select("request_id", "id", "rank", F.round("words", 6)).collect()) == want
    assert want != uncut(f"WITH {plans._RANKED} SELECT request_id, id, rank, round(w, 6) FROM rk")


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_all_histories_are_ranked_for_a_pack(spark):
    """As the SQL of history_rank would without its cut."""
    want = uncut(f"WITH {plans._PAST} SELECT request_id, id, rank, round(score, 6) FROM rk", "QUALIFY k <= 240")
    asks = asked(spark).withColumn("end", F.when(F.col("end") == 0, AS_OF).otherwise(F.col("end")))
    got = requests.histories(asks, memory_facts(spark, DATA), 12, cut=False).select("request_id", "id", "rank", F.round("score", 6))
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_a_pack_holds_what_is_ranked_of_all(spark):
    """The pack's facts are those of the buckets of all facts, not of the first few hundred."""
    facts = memory_facts(spark, DATA)
    found = requests.blocks(requests.bundles(asked(spark), facts, AS_OF, cut=False)).where("bucket = 'core'").collect()
    packs = {r.request_id: r.pack for r in catalogue.QUERIES["retrieve_pack"](spark, DATA).collect()}
    assert found and all(r.content in packs[r.request_id] for r in found if r.position == 1)
