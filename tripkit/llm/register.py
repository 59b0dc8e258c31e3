"""The corpus operators bound to the test tables, next to their SQL where SQL can state them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripkit.llm import bpe, chat, collisions, learn, mixing, pivots, quality, simhash, slots, spelling, spotsigs, toxicity, warc, whitening
from tripkit.operators.layout import ensure_checkpoint_dir
from tripkit.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _ORACLES[name] = sql
        return query

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


@register("op1_mix_sources")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return mixing.mix(docs, carry=["doc_id"]).select(
        "row.doc_id",
        "size",
        "source_size",
        "target",
        mixing.taken_words().alias("taken"),
        F.transform("draws", lambda d: d["shard"]).alias("shards"),
    )


@register("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    model = toxicity.fit_toxicity(docs, labels, "toxic", folds=3, fold=1)
    return toxicity.with_toxicity(docs, model, keep=["doc_id"]).select(
        "doc_id",
        learn.held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@register("op5_quality_mil")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    model = quality.fit_quality(docs, labels, "quality", folds=5, fold=0)
    return quality.with_quality(docs, model, keep=["doc_id"]).select(
        "doc_id",
        learn.held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@register("op10_simhash_near_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(read_table(spark, folder, "documents"), words=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@register("op8_byte_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(read_table(spark, folder, "documents"), vocabulary, public_tokenizers.PATTERN)
    return bpe.decode(encoded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op9_pivot_permutation")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.embedding_groups(read_table(spark, folder, "embeddings"))


@register("op2_warc")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write_archives(read_table(spark, folder, "pages"), warc.archive_folder(spark))
    return warc.read_archives(manifest).select(
        F.col("page_id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


@register("op4_spotsigs")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.compare_edited(read_table(spark, folder, "documents")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@register("op7_virtual_slots")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").withColumn("text_crc32", slots.text_crc32(F.col("text")))
    # The first run of a corpus: version 1 of its map is made, stored and read back.
    folder = f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid.uuid4()}"
    return slots.shard(docs, shards=16, carry=["doc_id", "text_crc32"], map_folder=folder).select(
        "row.doc_id",
        "size",
        "row.text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


@register("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(read_table(spark, folder, "embeddings"))
    return white.select(
        "vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of")
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "of.whitened",
        "of.explained",
        "identity_error",
    )


@register("op12_spelling_variants")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(read_table(spark, folder, "documents"))


@register("op13_collision_search")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collisions.nearest(read_table(spark, folder, "embeddings"))


def escaped_sql(column: str) -> str:
    for plain, safe in chat.ESCAPES:
        column = f"replace({column}, '{plain}', '{safe}')"
    return column


PERSPECTIVES_SQL = f"""
WITH slim AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body
  FROM conversations),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, body) - 1 AS place FROM slim),
people AS (SELECT DISTINCT conv_id, speaker AS participant FROM slim WHERE speaker <> 'system'),
seen AS (
  SELECT r.conv_id, participant, r.place // 64 AS part, r.place, speaker = participant AS own,
         CASE WHEN speaker = participant THEN '<|assistant|>' || chr(10)
              WHEN speaker = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || {escaped_sql('speaker')} || '|>' || chr(10) END AS head,
         {escaped_sql('body')} || '<|end|>' || chr(10) AS tail
  FROM ranked r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(tail)) OVER (
              PARTITION BY conv_id, participant, part ORDER BY place
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head_at
  FROM seen)
SELECT conv_id, participant, CAST(part AS BIGINT) AS part, count(*) AS n_turns,
       string_agg(head || tail, '' ORDER BY place) AS rendered,
       string_agg(head_at || ':' || length(head) || ':0 ' || (head_at + length(head)) || ':' || length(tail) || ':'
                  || CAST(own AS INT), ' ' ORDER BY place) AS spans
FROM placed
GROUP BY conv_id, participant, part
"""


@register("op6_perspectives", PERSPECTIVES_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rotated = chat.rotate_perspectives(read_table(spark, folder, "conversations"))
    span = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["length"], s["mask"]))
    return rotated.withColumn("spans", F.array_join(span, " "))
