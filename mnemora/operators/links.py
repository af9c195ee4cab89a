"""Links between names and the facts and episodes that they occur in, kept in an inverted table by deltas.

A link is (name, ref, ref_id, kind, persona_id): ref says whether ref_id is a fact's or an episode's, kind whether the name is
a person's, a keyword or a topic. A name is linked once to a record; its last kind counts (person, keyword, topic).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions.matching import entity_name
from mnemora.functions.text import text_or_empty
from mnemora.storage import existing

from .joins import names_within

LINK = "name string, ref string, ref_id long, kind string, persona_id string"
COLUMNS = ("name", "ref", "ref_id", "kind", "persona_id")
KEY = ("name", "ref", "ref_id")
_REF = ("ref", "ref_id")


def _links(rows: DataFrame, ref: str, persons: Column, keywords: Column, topic: Column) -> DataFrame:
    clean = lambda names: F.transform(F.coalesce(names, F.array().cast("array<string>")), entity_name)
    d = rows.where("id is not null").select(F.lit(ref).alias("ref"), F.col("id").cast("long").alias("ref_id"), text_or_empty(F.col("persona_id")).alias("persona_id"), clean(persons).alias("_p"), clean(keywords).alias("_k"), entity_name(text_or_empty(topic)).alias("_t"))
    names = F.array_distinct(F.filter(F.concat("_p", "_k", F.array("_t")), lambda x: x != ""))
    kind = F.when(F.col("name") == F.col("_t"), "topic").when(F.array_contains("_k", F.col("name")), "keyword").otherwise("person")
    return d.withColumn("name", F.explode(names)).withColumn("kind", kind).select(*COLUMNS)


def fact_links(facts: DataFrame) -> DataFrame:
    """Links of facts (id, speaker_name, keywords array, topic, persona_id), row by row."""
    return _links(facts, "fact", F.array("speaker_name"), F.col("keywords"), F.col("topic"))


def episode_links(episodes: DataFrame) -> DataFrame:
    """Links of episodes (id, participants array of (id, name), keywords array, persona_id); the bot is no person."""
    people = F.filter("participants", lambda p: text_or_empty(p["id"]) != "bot_self")
    return _links(episodes, "event", F.transform(people, lambda p: p["name"]), F.col("keywords"), F.lit(""))


def refs_of_speakers(facts: DataFrame, episodes: DataFrame, speakers: DataFrame) -> DataFrame:
    """(ref, ref_id): the facts and episodes to link anew when speakers (speaker_id) got another name or id."""
    s = speakers.select("speaker_id").distinct()
    mine = facts.join(s, "speaker_id", "left_semi").select(F.lit("fact").alias("ref"), F.col("id").cast("long").alias("ref_id"))
    took = episodes.select(F.lit("event").alias("ref"), F.col("id").cast("long").alias("ref_id"), F.explode(F.transform("participants", lambda p: p["id"])).alias("speaker_id"))
    return mine.unionByName(took.join(s, "speaker_id", "left_semi").select(*_REF)).distinct()


class LinkIndex:
    """Links in a folder that the driver and all executors share, by buckets of names and by buckets of records.

    A base holds all links; each change is a version of its own, of links that came or changed and links that went. Both
    lie in buckets, so a change reads the buckets of its records, and a look-up those of its names. A version counts once
    it is committed; one that was lost on the way is overwritten. One writer at a time. `compact` makes a new base.
    """

    def __init__(self, spark: SparkSession, at: str, buckets: int = 64):
        self.spark, self.at, self.buckets = spark, at.rstrip("/"), buckets

    def _head(self) -> tuple[int, int] | None:
        """The last version, and that of its base."""
        found = existing(self.spark, f"{self.at}/commits/*")
        row = None if found is None else found.agg(F.max(F.struct("version", "base")).alias("h")).first()["h"]
        return None if row is None else (row["version"], row["base"])

    def _bucket(self, by: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int, base: int) -> int:
        path = f"{self.at}/rows-{version}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(rows.schema).parquet(path)
        for layout, by in (("name", ["name"]), ("ref", list(_REF))):
            # a bucket is as many files as its rows need, not one task: names with very many links are dealt by record too
            dealt = kept.withColumn("bucket", self._bucket(by)).repartition("bucket", F.pmod(F.xxhash64(*KEY), F.lit(4))).sortWithinPartitions("bucket", *by)
            dealt.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.at}/{layout}-{version}")
        self.spark.createDataFrame([(version, base)], "version long, base long").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/commits/{version}")
        return version

    def build(self, links: DataFrame) -> int:
        """A new base of all links (LINK); rows of one key are one link, of the largest kind and persona."""
        head = self._head()
        version = 0 if head is None else head[0] + 1
        return self._write(self._once(links).withColumn("gone", F.lit(False)), version, version)

    def _once(self, links: DataFrame) -> DataFrame:
        return links.groupBy(*KEY).agg(F.max(F.struct("kind", "persona_id")).alias("_l")).select(*KEY, "_l.kind", "_l.persona_id")

    def _layers(self, layout: str) -> DataFrame:
        head = self._head()
        if head is None:
            return self.spark.createDataFrame([], f"{LINK}, gone boolean, bucket int, version long")
        shape = f"{LINK}, gone boolean, bucket int"
        read = [self.spark.read.schema(shape).parquet(f"{self.at}/{layout}-{v}").withColumn("version", F.lit(v).cast("long")) for v in range(head[1], head[0] + 1)]
        out = read[0]
        for more in read[1:]:
            out = out.unionByName(more)
        return out

    def _newest(self, layers: DataFrame) -> DataFrame:
        last = layers.groupBy(*KEY).agg(F.max_by(F.struct("kind", "persona_id", "gone"), "version").alias("_l"))
        return last.where("not _l.gone").select(*KEY, "_l.kind", "_l.persona_id")

    def _met(self, layout: str, wanted: DataFrame, by: list[str]) -> DataFrame:
        d = wanted.withColumn("bucket", self._bucket(by))
        touched = [r["bucket"] for r in d.select("bucket").distinct().collect()]  # `buckets` numbers at most
        return self._layers(layout).where(F.col("bucket").isin(touched)).join(d, ["bucket", *by], "left_semi")

    def links(self) -> DataFrame:
        """All links as they are."""
        return self._newest(self._layers("name"))

    def of_names(self, names: DataFrame) -> DataFrame:
        """The links of names (name): their buckets are read."""
        return self._newest(self._met("name", names.select("name").distinct(), ["name"]))

    def of_refs(self, refs: DataFrame) -> DataFrame:
        """The links of records (ref, ref_id): their buckets are read."""
        return self._newest(self._met("ref", refs.select(*_REF).distinct(), list(_REF)))

    def relink(self, refs: DataFrame, links: DataFrame) -> int:
        """Links the records refs (ref, ref_id) anew: `links` are all that they have now; a record without any has gone.

        What is written are the differences alone: links that are new or changed, and those that no longer hold. Links of
        records outside refs are left out.
        """
        head = self._head()
        if head is None:
            raise ValueError("build the index first")
        wanted = self._once(links.join(refs.select(*_REF).distinct(), list(_REF), "left_semi"))
        old = self.of_refs(refs)
        came = wanted.join(old, list(COLUMNS), "left_anti").withColumn("gone", F.lit(False))
        went = old.join(wanted, list(KEY), "left_anti").withColumn("gone", F.lit(True))
        return self._write(came.unionByName(went), head[0] + 1, head[1])

    def delta(self, version: int) -> DataFrame:
        """The links of LINK that a version wrote, and whether each of them went."""
        return self.spark.read.parquet(f"{self.at}/rows-{version}")

    def compact(self) -> int:
        """Base and changes as a new base, which later versions start from."""
        return self.build(self.links())


def refs_in_texts(texts: DataFrame, links: DataFrame, id_col: str, text_col: str, persona_col: str | None = None, names: int = 8, most: int = 400) -> DataFrame:
    """(id, ref, ref_id): records that are linked to names within a text: its `names` longest, ties by name; the first `most`
    records. With persona_col, links of that persona and of none; a text with an empty or null persona sees all."""
    found = names_within(texts, links.select("name").distinct(), id_col, text_col, "name")
    longest = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(F.length("name")), "name"))
    few = found.withColumn("_n", longest).where(F.col("_n") <= names).drop("_n")
    met = few.join(links, "name")
    if persona_col is not None:
        who = texts.select(id_col, text_or_empty(F.col(persona_col)).alias("_persona"))
        met = met.join(who, id_col).where((F.col("_persona") == "") | F.col("persona_id").isin("") | (F.col("persona_id") == F.col("_persona")))
    refs = met.select(id_col, *_REF).distinct()
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(*_REF))
    return refs.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
