"""Every event is looked up, whatever its type and id."""

from pathlib import Path

import pytest

from mnemora.plans import catalogue, people  # noqa: F401  these register queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def test_every_event_is_looked_up(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    rows = catalogue.QUERIES["merge_target_all"](spark, str(DATA)).collect()
    assert sorted(r.id for r in rows) == sorted(r.event_id for r in events.collect())
    assert {r.id % 2 for r in rows if r.found is not None and r.found % 2 == 0} == {0, 1}
