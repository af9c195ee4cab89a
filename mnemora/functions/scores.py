"""Column functions that score: decay, recency, similarity, importance, fused ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400.0


def age_days(as_of: Column, ts: Column) -> Column:
    return F.greatest(F.lit(0.0), (as_of - ts) / DAY)


def recency(as_of: Column, ts: Column, scale: float = 14.0) -> Column:
    return 1.0 / (1.0 + age_days(as_of, ts) / scale)


def decay_weight(importance: Column, confidence: Column, pinned: Column, accesses: Column, last: Column, as_of: Column, half_life: float = 30.0, reinforce: float = 0.5, most: float = 3.0) -> Column:
    """importance (else confidence) halved every half_life days, which accesses stretch up to `most` times; pinned: 1 at least."""
    base = F.when(importance > 0, importance).otherwise(confidence)
    life = half_life * F.least(1.0 + reinforce * F.greatest(accesses, F.lit(0)), F.lit(most))
    faded = base * F.pow(F.lit(0.5), F.when(last > 0, age_days(as_of, last)).otherwise(0.0) / life)
    return F.when(pinned, F.greatest(base, F.lit(1.0))).otherwise(faded)


def default_importance(manual: Column, passed: Column, correction: Column, first_person: Column) -> Column:
    base = F.when(manual, 1.0).when(passed, 0.8).otherwise(0.5)
    return F.least(F.lit(1.0), base + 0.1 * correction.cast("int") + 0.05 * first_person.cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null or zero vectors and for vectors of unlike length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(ok, dot(a, b) / norm).otherwise(0.0)


def local_score(text: Column, rec: Column, confidence: Column, own: Column, matched: Column, owner: Column, weight: Column, pinned: Column, stale: Column, importance_weight: float = 0.25) -> Column:
    flag = lambda c: c.cast("int")
    return text + 0.2 * rec + 0.25 * F.least(F.lit(1.0), confidence) + 0.15 * flag(own) + 2.5 * flag(matched) + 0.12 * flag(owner) + importance_weight * weight + 0.2 * flag(pinned) - 0.5 * flag(stale)


def fused_score(rrf: Column, text: Column, cos: Column, rec: Column, pinned: Column, own: Column, matched: Column, stale: Column) -> Column:
    flag = lambda c: c.cast("int")
    return rrf + 0.15 * text + 0.1 * cos + 0.05 * rec + 0.05 * flag(pinned) + 0.08 * flag(own) + 2.0 * flag(matched) - 0.1 * flag(stale)


def event_score(text: Column, age: Column, confidence: Column, weight: Column, pinned: Column, matched: Column, route: Column, ended_before: Column, linked: Column, link_weight: float = 0.0) -> Column:
    """Of an episode, age days after its end; ended_before: whether it ended within the time asked for."""
    flag = lambda c: c.cast("int")
    own = text + 0.25 / (1.0 + age / 14.0) + 0.2 * F.least(F.lit(1.0), confidence) + 0.25 * weight + 0.25 * flag(pinned) + 2.5 * flag(matched)
    by_route = F.when((route == "current_status") & (age > 7), -0.4).when(route == "time_window", 0.15).when(route == "history", 0.15 + 0.1 * flag(ended_before)).otherwise(0.0)
    return own + by_route + link_weight * flag(linked)


def history_score(text: Column, age: Column, confidence: Column, pinned: Column, inside: Column, linked: Column, link_weight: float = 0.0) -> Column:
    """Of a fact that is over, age days after its last change; inside: whether it held within the time asked for."""
    flag = lambda c: c.cast("int")
    return text + 0.2 / (1.0 + age / 30.0) + 0.1 * F.least(F.lit(1.0), confidence) + 0.2 * flag(pinned) + 0.05 * flag(inside) + link_weight * flag(linked)


#: The dimensions of a judgement and their weights.
JUDGE = {"relevance": 0.3, "willingness": 0.25, "social": 0.25, "timing": 0.2}


def judge_score(values: Column) -> Column:
    """The weighted mean of the known dimensions of a map, each clamped to 0 .. 10."""
    known = {k: F.try_element_at(values, F.lit(k)).try_cast("double") for k in JUDGE}
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for (k, w), v in zip(JUDGE.items(), known.values())), F.lit(0.0))
    mean = sum((F.coalesce(F.least(F.greatest(v, F.lit(0.0)), F.lit(10.0)) * w, F.lit(0.0)) for w, v in zip(JUDGE.values(), known.values())), F.lit(0.0))
    return F.when(total > 0, mean / total)
