"""The queries of this subpackage, each an operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff_lm import score_texts
from .bpe import round_trip
from .common import crc_of_id, scratch_dir
from .decontamination import find_contamination
from .licenses import TEMPLATES, find_passages, scan_licenses
from .merkle import folded_root, leaf_digest, merkle_manifest, path_digest
from .mixing import mix_sources
from .ngram_join import jaccard_components
from .permutation_index import permutation_search
from .pivot_table import exact_search
from .sharding import histogram_shards
from .token_files import read_token_files, word_tokenizer, write_token_files
from .toxicity import score_toxicity, train_classifier
from .whitening import whiten


def _every_20th() -> Column:
    """The rows that are queries, over the searches' column id."""
    return F.col("id") % 20 == 0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_shards(_table(spark, sf_dir, "documents"), shards=40)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_search(_table(spark, sf_dir, "embeddings"), _every_20th(), k=20)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_of_id(F.col("doc_id")) % 5 == 1
    scored = score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 7).alias("base_score"), F.round("score", 7).alias("score"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/mnemora/token-files-{uuid.uuid4().hex}"
    encode = word_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    write_token_files(_table(spark, sf_dir, "documents"), encode, end_id=1, vocabulary=49_408, folder=folder)
    return read_token_files(spark, folder)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = crc_of_id(F.col("doc_id")) % 3 == 1
    model = train_classifier(docs, labels, ~held_out)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search(_table(spark, sf_dir, "embeddings"), _every_20th(), k=20, scale=64)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = F.when(crc_of_id(c("doc_id")) % 3 == 0, leaf_digest(c("doc_id"), c("source"), c("lang"), c("n_chars"), F.translate("text", upper, lower)))
    found = merkle_manifest(_table(spark, sf_dir, "documents"), carry={"changed": changed})
    shown = found.select("doc_id", "leaf", "subroot", "root", path_digest(c("path")).alias("proof_sha256"), folded_root(F.coalesce("changed", "leaf"), c("path")).alias("folded_root"))
    return shown.withColumn("verified", c("folded_root") == c("root"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = whiten(_table(spark, sf_dir, "embeddings"), components=32).select("*", F.posexplode("whitened").alias("_at", "_z"))
    component = F.col("_at") + 1
    return each.select("vec_id", component.alias("component"), "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.col("_z").alias("whitened"), F.element_at("explained", component).alias("explained"), "identity_error")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_histogram_shards, op2_permutation_index, op3_ngram_jaccard, op4_backoff_lm, op5_mix_sources, op6_byte_bpe, op7_token_files, op8_toxicity, op9_pivot_table, op10_license_scan, op10_license_passages, op11_merkle_manifest, op12_decontamination, op13_whitening, pipeline)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: A-Z alone: DuckDB's lower() changes other letters too.
_LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Unsigned CRC-32 of a short ASCII text: the table of the reflected polynomial, then byte by byte.
_CRC = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
),
crc AS (
  SELECT DISTINCT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1])), 4294967295) AS crc
  FROM documents, crc_table
)"""


def _license_sql() -> str:
    rows = ", ".join(f"('{n}', {k}, '{x.replace(chr(39), chr(39) * 2)}')" for n, xs in TEMPLATES.items() for k, x in enumerate(xs))
    norm = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    pairs = "list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)"
    return f"""WITH t AS (SELECT license, template, {pairs} AS g FROM (SELECT license, template::INT AS template, string_split({norm.format("x")}, ' ') AS w FROM (VALUES {rows}) v(license, template, x))),
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
words AS (SELECT doc_id, line, string_split(n, ' ') AS w FROM (SELECT doc_id, line, {norm.format("x")} AS n FROM lines) WHERE n <> ''),
sets AS (SELECT doc_id, line, {pairs} AS g FROM words),
met AS (SELECT doc_id, line, license, template, len(list_intersect(sets.g, t.g)) AS common, len(sets.g) AS a, len(t.g) AS b FROM sets, t WHERE len(sets.g) BETWEEN len(t.g) / 2 AND len(t.g) * 2)
SELECT doc_id, line::INT AS line, license, template, common::INT AS common, a::INT AS size_line, b::INT AS size_template, 2.0 * common / (a + b)::DOUBLE AS dice FROM met WHERE 200 * common >= 80 * (a + b)"""


def _merkle_sql() -> str:
    text = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda t: "sha256(" + " || ".join(map(text, ("doc_id", "source", "lang", "n_chars"))) + f" || {text(t)})"
    # a forest, level by level: hash of the nodes of each run, until one is left
    up = lambda name, start: f"""{name} AS (
  SELECT tree, 0 AS level, idx, h, n FROM {start}
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 8)"""  # noqa: E731
    # of each node of a level: its run's nodes to the left and to the right
    sides = lambda name, out: f"""{out} AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL)"""  # noqa: E731
    return f"""WITH RECURSIVE {_CRC},
rows_ AS (SELECT *, row_number() OVER () AS row_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf("low")} ELSE {leaf("text")} END AS shown
  FROM (SELECT *, {_LOWER_AZ.format("text")} AS low FROM documents LEFT JOIN crc USING (doc_id))),
leaves AS (SELECT row_id, doc_id, tree, leaf AS h, shown, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM rows_),
{up("t", "leaves")}, {sides("t", "s")},
subroots AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
{up("u", "subroots")}, {sides("u", "v")},
top AS (SELECT h AS root FROM u WHERE n = 1),
steps AS (
  SELECT row_id, level, l, r FROM leaves x JOIN s ON s.tree = x.tree AND s.idx = x.idx // (8 ** level)::BIGINT
  UNION ALL
  SELECT row_id, 1000 + level, l, r FROM leaves x JOIN subroots y ON y.name = x.tree JOIN v ON v.idx = y.idx // (8 ** level)::BIGINT),
paths AS (SELECT row_id, string_agg(l || r, '' ORDER BY level) AS proof, list(l || '|' || r ORDER BY level) AS p FROM steps GROUP BY row_id)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT x.doc_id, x.h AS leaf, y.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(shown, coalesce(p, [])), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root
  FROM leaves x JOIN subroots y ON y.name = x.tree LEFT JOIN paths USING (row_id), top)"""


def _decontamination_sql() -> str:
    words = lambda t: f"regexp_extract_all({_LOWER_AZ.format(f"coalesce({t}, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH items AS (SELECT item_id, {words("text")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS x FROM (
  SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS row_id, doc_id, {words("text")} AS w FROM documents),
places AS (SELECT row_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
found AS (SELECT row_id, i, windows.size AS size, item_id FROM places JOIN windows ON places.size = windows.size AND array_to_string(w[i:i + places.size - 1], ' ') = x),
hits AS (SELECT row_id, count(DISTINCT k) AS n_hit FROM (SELECT row_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY row_id),
named AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (row_id) LEFT JOIN named USING (row_id)"""


ORACLE = {
    "op11_merkle_manifest": _merkle_sql(),
    "op12_decontamination": _decontamination_sql(),
    "op9_pivot_table": """WITH q AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id)::INT AS rank
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0) WHERE rank <= 20""",
    "op4_backoff_lm": f"""WITH {_CRC},
tokens AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, crc % 5 <> 1 AS train
  FROM (SELECT doc_id, crc, list_append(list_transform({_WORDS}, lambda x: {_LOWER_AZ.format("x")}), ' ') AS w FROM documents JOIN crc USING (doc_id))),
pairs AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), '  ') AS h FROM tokens),
one AS (SELECT w, count(*) FILTER (WHERE train) AS c FROM tokens GROUP BY w),
two AS (SELECT h, w, count(*) FILTER (WHERE train) AS c FROM pairs GROUP BY h, w),
hist AS (SELECT h, count(*) FILTER (WHERE train) AS c FROM pairs GROUP BY h),
n AS (SELECT sum(c)::DOUBLE AS n, count(*) FILTER (WHERE c > 0)::DOUBLE AS v FROM one),
p AS (
  SELECT doc_id, train, one.c AS c1, log10((one.c + 0.5) / (n + 0.5 * (v + 1))) AS b,
    log10((two.c + 4.0 * ((one.c + 0.5) / (n + 0.5 * (v + 1)))) / (hist.c + 4.0)) AS s, n
  FROM pairs JOIN one USING (w) JOIN two USING (h, w) JOIN hist USING (h), n)
SELECT doc_id, NOT any_value(train) AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c1 > 0) AS n_known, any_value(n)::BIGINT AS train_tokens,
  round(sum(b), 7) AS base_score, round(sum(s), 7) AS score FROM p GROUP BY doc_id""",
    "op10_license_scan": _license_sql(),
}
