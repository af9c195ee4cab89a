"""Every query with SQL beside it, on the smallest tables; streams against their folds."""

import math
from pathlib import Path

import duckdb
import pytest

from mnemora.plans import catalogue, ingest, panels, people, records, replies, requests, streams  # noqa: F401  these register queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalogue.ORACLE[name])
    other = table([d[0] for d in cur.description], cur.fetchall())
    assert mine[0] == other[0]
    assert len(mine[1]) == len(other[1])
    assert all(same(x, y) for a, b in zip(mine[1], other[1]) for x, y in zip(a, b))


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_stream_debounce_equals_a_fold(spark):
    got = sorted((r.key, r.first_us, r.last_us, r.fragments, r.merged) for r in catalogue.QUERIES["stream_debounce"](spark, str(DATA)).collect())
    rows = duckdb.connect().execute(f"select user_id::varchar, epoch_us(ts), event_type, event_id from '{DATA}/events.parquet' order by ts, event_id").fetchall()
    held, want, hour = {}, [], 3600 * 10**6
    for key, t, piece, _ in rows:
        h = held.get(key)
        if h and (t - h[1] > hour or t - h[0] > 4 * hour or h[2] >= 4):
            want.append((key, *h))
            h = None
        held[key] = (h[0], t, h[2] + 1, f"{h[3]} {piece}") if h else (t, t, 1, piece)
    end = rows[-1][1]
    still = {k for k, h in held.items() if h[1] + hour >= end - 2000}
    want += [(k, *h) for k, h in held.items() if k not in still]
    assert [g for g in got if g in want] == sorted(want)
    assert all(g[0] in still for g in got if g not in want)
