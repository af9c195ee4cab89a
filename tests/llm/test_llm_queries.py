"""The registered queries: against SQL where there is some, and the pipeline stage by stage against brute force."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from test_mixing import targets
from test_ngram_join import brute

import corpus_pipeline
from mnemora.llm import queries
from mnemora.llm.common import written

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def duck(sql):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    cur = c.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    columns, rows = duck(queries.ORACLE[name])
    assert sorted(columns) == sorted(df.columns)
    mine = sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr)
    other = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows), key=repr)
    same = lambda x, y: x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6))
    assert len(mine) == len(other) and all(same(x, y) for a, b in zip(mine, other) for x, y in zip(a, b))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = written(stages["toxicity"](spark, docs, str(DATA)), "t1")
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()

    kept = written(stages["near-copies"](spark, clean, str(DATA)), "t2")
    rows = [(r.doc_id, r.text) for r in clean.orderBy("doc_id").collect()]
    _, group, sets = brute(rows, 5, 80)
    first = {}
    for (i, _), g, s in zip(rows, group, sets):
        first.setdefault(g if s else ("alone", i), i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())

    mixed = written(stages["mix"](spark, kept, str(DATA)), "t3")
    assert mixed.columns == docs.columns
    size = {r.doc_id: len((r.text or "").encode().split()) for r in kept.collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times.values()) <= {1, 2}
    source, taken = Counter(), Counter()
    for r in kept.collect():
        source[r.source] += size[r.doc_id]
        taken[r.source] += size[r.doc_id] * times[r.doc_id]
    for s, t in targets(dict(source)).items():
        assert abs(taken[s] - t) <= max(size[r.doc_id] for r in kept.collect() if r.source == s)

    coded = stages["encode"](spark, mixed, str(DATA))
    assert coded.count() == mixed.count()
    assert corpus_pipeline.run(spark, str(DATA)).count() == mixed.count()
