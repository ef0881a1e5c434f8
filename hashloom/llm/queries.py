"""The queries of this subpackage, each its operator with production parameters over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdedup, linededup, media, merkle, packing, phrases, rankbytes, sentencepieces, sharding, simhash, statements, tokenio, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(_table(spark, sf_dir, "pages"), least=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = media.media_columns(_table(spark, sf_dir, "documents"))
    return probed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", media.feature(probed).alias("feature"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "threshold", "flagged")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenio.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), 16).drop("cut")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=2, width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.mine_phrases(_table(spark, sf_dir, "documents"), longest=3, least=10, top=2000, covered=50)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_tiktoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = rankbytes.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_packing, op3_media, op4_toxicity, op5_tokens, op6_sharding, op7_lines, op8_sentencepiece, op9_exact, op10_simhash, op11_phrases, op12_tiktoken, op13_merkle, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op9_exact": statements.EXACT, "op11_phrases": statements.PHRASES, "op13_merkle": statements.MERKLE}
