"""Who may see a fact, its history, or an episode: each rule as a column, over columns of the item and of who asks.

An asker has an array of ids (one person's accounts), a persona, a window, a kind of isolation (off, shared, owner,
strict) and an array of owners' ids. Each function gives 'visible' or the name of the first rule that hides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty

# Kinds of isolation, and attributes that stay true when a status is asked for.
ISOLATION = ("off", "owner", "strict", "shared")
LASTING = ("likes", "name", "identity")
#: Speakers that belong to everybody: nobody in particular, and the bot.
COMMON_IDS = ("", "bot_self")


def isolation_of(raw: Column) -> Column:
    mode = F.lower(F.trim(text_or_empty(raw)))
    return F.when(mode.isin(*ISOLATION), mode).otherwise("shared")


def private_window(tag: Column) -> Column:
    t = F.lower(text_or_empty(tag))
    return F.contains(t, F.lit("friend")) | F.contains(t, F.lit("private"))


def meet(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def other_persona(persona: Column, asked: Column) -> Column:
    p, q = text_or_empty(persona), text_or_empty(asked)
    return (p != "") & (q != "") & (p != q)


def persona_or_global(persona: Column, asked: Column) -> Column:
    """What a persona may use: its own, and what belongs to none; an asker without a persona may use all."""
    return (text_or_empty(asked) == "") | text_or_empty(persona).isin("") | (text_or_empty(persona) == text_or_empty(asked))


def _origin(scope: Column, speaker: Column, window: Column, ids: Column, owners: Column, ask_window: Column, isolation: Column) -> Column:
    """owner_private or private_origin where isolation hides an item, else null."""
    mine = F.array_union(ids, F.array(*map(F.lit, COMMON_IDS)))
    guarded = (scope == "owner") & (F.size(owners) > 0)
    away = ~private_window(ask_window) | ~F.array_contains(mine, speaker) | speaker.isin(*COMMON_IDS)
    return F.when((isolation != "off") & guarded, F.when(~meet(mine, owners), "owner_private")).when((isolation == "strict") & private_window(window) & away, "private_origin")


def _called(query: Column, name: Column, speaker: Column) -> Column:
    n, s, q = F.trim(text_or_empty(name)), F.trim(text_or_empty(speaker)), text_or_empty(query)
    return ((F.length(n) >= 2) & F.contains(q, n)) | ((F.length(s) >= 4) & F.contains(q, s))


def fact_reason(status: Column, expires: Column, persona: Column, scope: Column, speaker: Column, name: Column, window: Column, attribute: Column, updated: Column, *, as_of: Column, query: Column, route: Column, ids: Column, ask_persona: Column, ask_window: Column, isolation: Column, owners: Column) -> Column:
    hidden = _origin(scope, speaker, window, ids, owners, ask_window, isolation)
    mine = F.array_contains(F.array_union(ids, F.array(*map(F.lit, COMMON_IDS))), speaker)
    stale = (route == "current_status") & (as_of - updated > 2 * 86400) & ~attribute.isin(*LASTING)
    return (
        F.when(status != "live", "not_live").when((expires > 0) & (expires < as_of), "expired").when(other_persona(persona, ask_persona), "other_persona")
        .when(hidden.isNotNull(), hidden).when(scope == "owner", "visible").when(mine & stale, "stale_for_status").when(mine, "visible")
        .when(_called(query, name, speaker), "visible").otherwise("other_speaker")
    )


def history_reason(persona: Column, scope: Column, speaker: Column, name: Column, window: Column, *, query: Column, ids: Column, ask_persona: Column, ask_window: Column, isolation: Column, owners: Column) -> Column:
    """As for facts, but neither status nor expiry hides: what is over is what is asked for."""
    hidden = _origin(scope, speaker, window, ids, owners, ask_window, isolation)
    mine = F.array_contains(F.array_union(ids, F.array(*map(F.lit, COMMON_IDS))), speaker)
    return F.when(other_persona(persona, ask_persona), "other_persona").when(hidden.isNotNull(), hidden).when((scope == "owner") | mine | _called(query, name, speaker), "visible").otherwise("other_speaker")


def episode_reason(status: Column, review: Column, persona: Column, scope: Column, speakers: Column, window: Column, *, route: Column, ids: Column, ask_persona: Column, ask_window: Column, isolation: Column, owners: Column) -> Column:
    """Of an episode with an array of speakers. Under strict isolation only the asker's own window tells."""
    alive = (status == "live") | ((route == "history") & (status == "archived"))
    here, own = text_or_empty(ask_window), meet(speakers, ids)
    shared = isolation.isin("off", "shared")
    owners_ask = meet(ids, owners)
    return (
        F.when(~alive, "not_live").when(text_or_empty(review) == "needs_review", "needs_review").when(other_persona(persona, ask_persona), "other_persona")
        .when(shared & (own | ((here != "") & (window == here)) | ((scope == "owner") & ((F.size(owners) == 0) | owners_ask))), "visible").when(shared, "other_speaker")
        .when((isolation == "strict") & (here != ""), "visible")
        .when((here == "") & (own | ((scope == "owner") & owners_ask)), "visible").otherwise("other_session")
    )


def in_card(window: Column, ask_window: Column, isolation: Column) -> Column:
    """Whether a profile card may show a fact: under strict isolation, nothing of a private window outside of one."""
    here, origin = F.trim(text_or_empty(ask_window)), F.trim(text_or_empty(window))
    return ~((isolation == "strict") & (here != "") & (origin != "") & private_window(origin) & ~private_window(here))
