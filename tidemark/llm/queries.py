"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, langid, linededup, ngramjoin, ogg, packing, secrets, sharding, sptok, warc
from tidemark.llm.common import bounded_batches, cut, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return ogg.digests(ogg.decode(ogg.encode(table(spark, sf_dir, "documents"))))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return ngramjoin.classes(table(spark, sf_dir, "documents"))


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(sharding.shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8, stable=False))


def op4_unigram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    shipped = sptok.ship(spark, sptok.zipf(sptok.load(tokenizer_path("piece_bpe_32k.model"))))
    coded = sptok.decode(sptok.encode(table(spark, sf_dir, "documents"), shipped), shipped)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, count_col="lines_removed")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents"), columns=["doc_id"]))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.sample(docs))
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark, 64)
    rows = cut(warc.digests(warc.archive(table(spark, sf_dir, "pages"))), "warc-rows")
    return warc.resolved(rows)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP10_ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p),
d AS (SELECT *, CAST(from_hex(h) AS BIT)::VARCHAR AS bits FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, 'ok' AS status
FROM d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ogg_media, op2_ngram_jaccard_join, op3_hypergeometric_shards, op4_unigram_tokens, op5_packing, op6_line_dedup, op7_secret_scan, op8_language_id, op9_exact_dedup, op10_warc_segments, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": exact.ORACLE, "op10_warc_segments": OP10_ORACLE}
