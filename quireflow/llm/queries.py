"""The registered queries of these operators, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, line_dedup, media, mixing, near_dedup, packing, quality, sharding, token_counts, token_store
from .shared import table, written


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.uniform_shards(table(spark, sf_dir, "documents"), 16)
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    return dealt.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media.to_media(table(spark, sf_dir, "documents")), "media", compression="zstd")
    return media.from_media(stored)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    return placed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_places(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).drop("text")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_class", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_fingerprints,
        op3_uniform_shards,
        op4_transport_streams,
        op5_pack_sequences,
        op6_token_store,
        op7_line_dedup,
        op8_token_counts,
        op9_quality,
        op10_near_dedup,
    )
}

#: Words as SQL finds them.
_WORD = "[^\\x20\\x09-\\x0D]+"

OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS nth FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE nth WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
t AS (SELECT sum(source_size)::DOUBLE AS total FROM w),
-- sources by the level at which they reach their cap; the level is right where all before it are capped and it isn't
l AS (
  SELECT source, weight, cap, (total - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w, t WHERE weight > 0
  WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, source LIMIT 1),
g AS (SELECT w.*, least(cap, level * weight) AS target FROM w, level),
h AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g),
r AS (SELECT *, target - whole * source_size AS rest FROM h),
o AS (
  SELECT d.*, source_size, target, whole, rest, sum(size) OVER (PARTITION BY d.source ORDER BY draw) AS upto
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
f AS (SELECT *, rest > 0 AND upto <= rest AS fits FROM o),
p AS (SELECT *, rest - max(CASE WHEN fits THEN upto ELSE 0 END) OVER (PARTITION BY source) AS gap FROM f),
x AS (
  SELECT source, draw FROM p WHERE NOT fits AND size < 2 * gap
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(gap - size), draw) = 1),
c AS (SELECT p.*, whole + CASE WHEN fits OR x.draw IS NOT NULL THEN 1 ELSE 0 END AS copies
  FROM p LEFT JOIN x ON p.source IS NOT DISTINCT FROM x.source AND p.draw = x.draw)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM c
"""

OP7_SQL = f"""
WITH split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
lines AS (SELECT *, len(regexp_extract_all(line, '{_WORD}'))::BIGINT AS w FROM split),
full_lines AS (
  SELECT doc_id, i, line, w, row_number() OVER d - 1 AS n, sum(w) OVER d AS upto
  FROM lines WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
-- the shortest runs of 50 words: from a line on, and up to a line
spans AS (
  SELECT s.doc_id, s.n AS a, min(e.n) AS b FROM full_lines s JOIN full_lines e ON e.doc_id = s.doc_id AND e.n >= s.n AND e.upto - s.upto + s.w >= 50 GROUP BY 1, 2
  UNION
  SELECT e.doc_id, max(s.n) AS a, e.n AS b FROM full_lines e JOIN full_lines s ON e.doc_id = s.doc_id AND e.n >= s.n AND e.upto - s.upto + s.w >= 50 GROUP BY 1, 3),
runs AS (
  SELECT s.doc_id, min(f.i) AS a, max(f.i) AS b, string_agg(f.line, chr(10) ORDER BY f.n) AS content
  FROM spans s JOIN full_lines f ON f.doc_id = s.doc_id AND f.n BETWEEN s.a AND s.b GROUP BY s.doc_id, s.a, s.b),
later AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM lines l JOIN later r ON l.doc_id = r.doc_id AND l.i BETWEEN r.a AND r.b),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

SQL: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op7_line_dedup": OP7_SQL}
