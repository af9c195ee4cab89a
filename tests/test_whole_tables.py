"""Queries take their whole tables: no rows or values are left out beforehand."""

from pathlib import Path

import pytest

from mnemora.plans import catalogue, people  # noqa: F401  these register queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def test_only_the_budget_cuts_a_context_pack(spark):
    live = catalogue.event_facts(spark, str(DATA)).where("status = 'live'").collect()
    values = {}
    for r in live:
        values.setdefault((r.speaker_id, r.attribute), set()).add(str(r.value))
    packs = {r.speaker_id: r.pack.split("\n") for r in catalogue.QUERIES["context_pack"](spark, str(DATA)).collect()}
    titles, checked = {f"{a}:" for _, a in values}, 0
    for (speaker, attribute), v in values.items():
        if len(v) <= 8 or attribute != "purchase":  # purchases are filled first: the whole budget is theirs
            continue
        lines, used = [], len(attribute) + 1
        for x in sorted(v):
            if used + 1 + len(x) <= 120:
                lines, used = [*lines, x], used + 1 + len(x)
        pack = packs[speaker]
        rest = pack[pack.index("purchase:") + 1 :]
        found = rest[: next((i for i, x in enumerate(rest) if x in titles), len(rest))]
        assert abs(len(found) - len(lines)) <= 1 and len(found) > 8
        checked += 1
    assert checked
