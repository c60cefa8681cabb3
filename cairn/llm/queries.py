"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import binpack, bpe, chat, common, embed, langid, license, minhash, mixing, quality, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_matches(_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)], turns.schema)
    return chat.digests(chat.examples(turns.unionByName(probe)))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_binpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    listed = binpack.write(_table(spark, sf_dir, "documents"), common.new_dir(spark, "ids"), tokenizer, vocabulary=49_408, end_id=2, by_word=True)
    return binpack.read(spark, listed).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(_table(spark, sf_dir, "pages"))
    return found.select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to").alias("refers_to"))


def op10_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {"op1_quality": op1_quality, "op2_license": op2_license, "op3_chat": op3_chat, "op4_langid": op4_langid, "op5_bpe": op5_bpe, "op6_binpack": op6_binpack, "op7_minhash": op7_minhash, "op8_mixing": op8_mixing, "op9_warc": op9_warc, "op10_embed": op10_embed}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality.SQL, "op2_license": license.sql(), "op3_chat": chat.SQL, "op8_mixing": mixing.SQL, "op9_warc": warc.SQL}
