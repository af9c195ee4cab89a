"""Queries over claims that the events make: guarded ingest, the facts that it leaves, and its stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators import ingest
from mnemora.sources.tables import EPOCH_SQL, table
from mnemora.streaming import decisions, jobs

from .catalogue import query
from .streams import _stateful

OWNERS = ("s0", "s5")
_ATTRIBUTES = ("likes", "likes", "habit", "promise", "name", "identity", "note", "status", "likes", "habit", "dislikes")
_WORDS = ("美式", "拿铁", "早起", "小王", "老王", "老板")
_SIGNS = ("", "不", "其实", "")
_VERBS = ("喝", "穿", "买", "")
_PREFIXES = ("我", "听说", "开玩笑", "改口", "", "我", "")


def _pick(options: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (at % len(options) + 1).cast("int"))


def event_claims(rows: DataFrame) -> DataFrame:
    """Events as claims of forty speakers: attributes, values and what is said are spliced by the event's number."""
    i, none = F.col("event_id"), F.lit("")
    value = F.concat(_pick(_SIGNS, F.floor(i / 3)), _pick(_WORDS, F.floor(i / 11)))
    return rows.select(
        i.alias("id"), F.expr(EPOCH_SQL).alias("ts"), F.when(i % 3 == 0, "p1").otherwise("").alias("persona_id"), F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("speaker_id"),
        none.alias("speaker_name"), none.alias("subject"), _pick(_ATTRIBUTES, i).alias("attribute"), value.alias("value"), F.concat(_pick(_PREFIXES, F.floor(i / 2)), _pick(_VERBS, i), value).alias("content"),
        none.alias("plain"), none.alias("topic"), (F.floor(F.col("value")) % 10 / 10.0).alias("confidence"), F.when(i % 8 == 0, 0.3).otherwise(0.0).alias("importance"), (i % 29 == 0).alias("pinned"),
        F.when(i % 13 == 0, "close").when(i % 37 == 0, "ignore").otherwise("create").alias("op"), F.when(i % 17 == 0, "manual").otherwise("").alias("origin"), none.alias("review_status"),
        F.lit(None).cast("boolean").alias("first_person"), F.lit(None).cast("boolean").alias("correction"),
    )


def speaker_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of five speakers below 25 go by the name of the one before them, some through two links."""
    n = F.col("n_nationkey")
    name = lambda k: F.concat(F.lit("s"), k.cast("string"))
    return table(spark, sf_dir, "nation").where(n % 5 > 0).where(n % 5 < 3).select(name(n).alias("alias"), name(n - 1).alias("canonical"))


def _list(options: tuple[str, ...], at: str) -> str:
    return f"[{', '.join(repr(x) for x in options)}][({at}) % {len(options)} + 1]"


#: The claims as `prepared` leaves them.
CLAIMS = f"""raw AS (
  SELECT event_id AS id, epoch_us(ts) // 1000000 AS ts, CASE WHEN event_id % 3 = 0 THEN 'p1' ELSE '' END AS p, user_id % 40 AS u, {_list(_ATTRIBUTES, "event_id")} AS attr,
    {_list(_SIGNS, "event_id // 3")} || {_list(_WORDS, "event_id // 11")} AS v, {_list(_PREFIXES, "event_id // 2")} || {_list(_VERBS, "event_id")} || v AS said,
    (floor(value)::BIGINT % 10) / 10.0::DOUBLE AS conf, CASE WHEN event_id % 8 = 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS imp, event_id % 29 = 0 AS pin, event_id % 13 = 0 AS close, event_id % 13 <> 0 AND event_id % 37 = 0 AS skip, event_id % 17 = 0 AS manual FROM events),
said AS (
  SELECT *, 's' || CASE WHEN u < 25 AND u % 5 IN (1, 2) THEN u - u % 5 ELSE u END AS who, regexp_replace(v, '^(不|其实)+', '') AS about, regexp_matches(said, '我|主人') AS first, contains(said, '改口') AS corr, contains(said, '听说') AS heard, contains(said, '开玩笑') AS joke,
    contains(said, '喝')::INT + contains(said, '拿铁')::INT AS drink, contains(said, '穿')::INT AS wear, contains(said, '玩')::INT AS fun FROM raw),
slotted AS (
  SELECT *, CASE WHEN drink > greatest(wear, fun) THEN '饮品' WHEN wear > greatest(drink, fun) THEN '穿搭' WHEN fun > greatest(drink, wear) THEN '娱乐' ELSE '' END AS guess, attr IN ('name', 'identity') AND contains(said, '老板') AS relation, who IN ('s0', 's5') AS mine,
    p || '|' || who || '|self|' || attr || CASE WHEN attr IN ('likes', 'dislikes', 'promise', 'habit') THEN '|' || about ELSE '' END AS k FROM said),
claims AS (
  SELECT *, CASE WHEN attr IN ('likes', 'dislikes') THEN guess ELSE '' END AS topic, CASE WHEN relation AND mine THEN 'note' ELSE attr END AS a, CASE WHEN relation AND mine THEN p || '|' || who || '|self|note' ELSE k END AS look,
    CASE WHEN skip THEN 'ignored' WHEN relation AND NOT mine THEN 'rejected_relation' WHEN joke AND NOT manual AND NOT corr THEN 'ignored_joke' END AS settled, heard AND NOT first AND NOT corr AS unsure,
    least(1.0::DOUBLE, CASE WHEN manual THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + 0.1::DOUBLE * corr::INT + 0.05::DOUBLE * first::INT) AS dimp FROM slotted),
grouped AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY ts, id) AS seq FROM (
    SELECT *, CASE WHEN a IN ('promise', 'habit') THEN '*|' || who || '|' || a WHEN mine AND a IN ('name', 'identity', 'note') THEN '*|' || who ELSE look END AS g FROM claims WHERE settled IS NULL))"""

_FACT = "STRUCT(id BIGINT, k VARCHAR, p VARCHAR, v VARCHAR, ab VARCHAR, conf DOUBLE, imp DOUBLE, acc BIGINT, pin BOOLEAN, topic VARCHAR, guess VARCHAR, upd BIGINT)"


def _top(key: str) -> str:
    """The surest, newest, first live fact of a slot."""
    return f"list_sort(list_transform(list_filter(s, lambda f: f.k = {key}), lambda f: {{'a': -f.conf, 'b': -f.upd, 'c': f.id, 'f': f}}))[1].f"


def _made(key: str, conf: str, imp: str = "CASE WHEN imp > 0 THEN imp ELSE dimp END", topic: str = "topic") -> str:
    return f"{{'id': id, 'k': {key}, 'p': p, 'v': v, 'ab': about, 'conf': {conf}, 'imp': {imp}, 'acc': 0::BIGINT, 'pin': pin, 'topic': {topic}, 'guess': guess, 'upd': ts}}"


#: The fold, claim by claim of every group at once.
FOLD = f"""run AS (
  SELECT DISTINCT g, 0::BIGINT AS seq, []::{_FACT}[] AS s, NULL::BIGINT AS id, NULL::VARCHAR AS action, NULL::VARCHAR AS reason, NULL::{_FACT} AS fact, NULL::BIGINT AS old_id, NULL::VARCHAR AS k FROM grouped
  UNION ALL
  SELECT g, seq, CASE WHEN fact IS NULL THEN s WHEN action = 'closed' THEN list_filter(s, lambda f: f.id <> fact.id) ELSE list_append(list_filter(s, lambda f: f.id <> fact.id AND f.id <> coalesce(old_id, -1)), fact) END AS s, id, action, reason, fact, old_id, k FROM (
    SELECT *, CASE
      WHEN unsure THEN {_made("k", "least(conf, 0.4::DOUBLE)")} WHEN action = 'insert' AND reason IS NULL THEN {_made("k", "conf")} WHEN action = 'insert' THEN {_made("cut", "conf")}
      WHEN action = 'closed' THEN o WHEN action = 'supersede' THEN {_made("coalesce(k2, k)", "conf", "CASE WHEN imp > 0 THEN imp ELSE o.imp END", "CASE WHEN topic <> '' THEN topic ELSE o.topic END")}
      WHEN action = 'refresh' THEN {{'id': o.id, 'k': CASE WHEN v = o.v THEN o.k WHEN o.k <> look AND (o.topic <> '' OR topic <> '') THEN look || '|' || CASE WHEN o.topic <> '' THEN o.topic ELSE topic END ELSE look END, 'p': o.p, 'v': v, 'ab': about, 'conf': greatest(o.conf, conf), 'imp': greatest(o.imp, imp),
        'acc': o.acc + 1, 'pin': o.pin, 'topic': CASE WHEN o.topic <> '' THEN o.topic ELSE topic END, 'guess': guess, 'upd': ts}} END AS fact,
      CASE WHEN action IN ('pending', 'supersede') THEN o.id END AS old_id FROM (
      SELECT *, CASE WHEN unsure THEN 'wrote_uncertain' WHEN o IS NULL THEN CASE WHEN close AND o1 IS NULL THEN 'ignored' ELSE 'insert' END WHEN close THEN 'closed' WHEN calm THEN CASE WHEN prefer AND topic <> '' AND dom = '' THEN 'pending' ELSE 'refresh' END
          WHEN o.pin OR NOT (first OR corr) OR (o.conf >= 0.8 AND o.acc >= 1 AND NOT corr) THEN 'pending' ELSE 'supersede' END AS action,
        CASE WHEN unsure THEN 'hearsay' WHEN o IS NULL THEN CASE WHEN o1 IS NOT NULL THEN 'domain_split' WHEN close THEN 'close_without_existing' END WHEN close THEN NULL WHEN calm THEN CASE WHEN prefer AND topic <> '' AND dom = '' THEN 'domain_needs_confirm' END
          WHEN o.pin THEN 'pinned_needs_confirm' WHEN NOT (first OR corr) THEN 'not_first_person_or_correction' WHEN o.conf >= 0.8 AND o.acc >= 1 AND NOT corr THEN 'high_evidence_needs_confirm' END AS reason FROM (
        SELECT *, o.v = v OR (o.v[1] = '不') = (v[1] = '不') AND (contains(o.v, v) OR contains(v, o.v)) AS calm FROM (
          SELECT *, CASE WHEN o1 IS NOT NULL AND splits THEN {_top("cut")} ELSE o1 END AS o FROM (
            SELECT *, coalesce(prefer AND topic <> '' AND dom <> '' AND topic <> dom, false) AS splits, o1.k || '|' || topic AS cut FROM (
              SELECT *, CASE WHEN o1.topic <> '' THEN o1.topic ELSE o1.guess END AS dom FROM (
                SELECT *, coalesce(t1, t2, t3) AS o1, CASE WHEN t1 IS NULL THEN t2.k END AS k2 FROM (
                  SELECT r.s, c.*, a IN ('likes', 'dislikes') AS prefer, {_top("look")} AS t1, CASE WHEN a IN ('likes', 'dislikes') AND topic <> '' THEN {_top("c.k || '|' || topic")} END AS t2,
                    CASE WHEN close AND a IN ('promise', 'habit') THEN coalesce(list_filter(late, lambda x: x.f.ab = about)[1].f, late[1].f) END AS t3
                  FROM (SELECT r.*, c.id AS cid, list_sort(list_transform(list_filter(r.s, lambda f: f.p IN ('', c.p)), lambda f: {{'a': -f.upd, 'b': f.id, 'f': f}}))[1:50] AS late FROM run r JOIN grouped c ON c.g = r.g AND c.seq = r.seq + 1) r JOIN grouped c ON c.g = r.g AND c.seq = r.seq + 1)))))))))"""

LOG = f"""log AS (
  SELECT id, action, reason, fact.id AS fact_id, old_id AS old_fact_id, coalesce(fact.k, k) AS slot_key, fact.v AS value, fact.conf AS confidence, fact.imp AS importance, fact.acc AS access_count, fact.topic AS topic, seq FROM run WHERE seq > 0
  UNION ALL
  SELECT id, settled, CASE settled WHEN 'ignored' THEN 'extractor_ignore' WHEN 'rejected_relation' THEN 'relation_claim_not_owner' ELSE 'joke_or_banter' END, NULL, NULL, k, NULL, NULL, NULL, NULL, NULL, 0 FROM claims WHERE settled IS NOT NULL)"""

_SHOWN = ("id", "action", "reason", "fact_id", "old_fact_id", "slot_key", "value", "confidence", "importance", "access_count", "topic")
INGEST_SQL = f"WITH RECURSIVE {CLAIMS}, {FOLD}, {LOG} SELECT {', '.join(_SHOWN)} FROM log"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_claims(event_claims(table(spark, sf_dir, "events")), speaker_aliases(spark, sf_dir), OWNERS)


@query(INGEST_SQL)
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every event does as a claim, with all actions and reasons."""
    return _log(spark, sf_dir).select(*_SHOWN)


@query(f"""WITH RECURSIVE {CLAIMS}, {FOLD}, {LOG},
  state AS (SELECT DISTINCT ON (fact_id) * FROM (SELECT log.*, ts FROM log JOIN claims USING (id)) WHERE fact_id IS NOT NULL ORDER BY fact_id, ts DESC, id DESC),
  gone AS (SELECT old_fact_id AS fact_id, fact_id AS superseded_by FROM log WHERE action = 'supersede')
  SELECT fact_id, CASE WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN action = 'closed' THEN 'archived' ELSE 'live' END AS status, slot_key, value, confidence, importance, access_count, topic, superseded_by FROM state LEFT JOIN gone USING (fact_id)""")
def ingest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that all claims leave."""
    return ingest.facts_after(_log(spark, sf_dir))


@query(f"WITH RECURSIVE {CLAIMS}, {FOLD}, {LOG} SELECT {', '.join(_SHOWN)} FROM log WHERE seq > 0")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims that reach their slots, as they stream in."""
    _stateful(spark)
    prep = ingest.prepared(event_claims(jobs.events(spark, sf_dir)), speaker_aliases(spark, sf_dir), OWNERS, cut=False)
    return jobs.drained(decisions.ingested(ingest.open_claims(prep)), "append").select(*_SHOWN)
