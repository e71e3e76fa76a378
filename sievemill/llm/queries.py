"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import bpe, hnsw, language, packing, pii, simhash, sketch, suffixes, toxicity, wordpiece
from sievemill.llm.common import crc_mod, keyed_text, table


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: in the folder that SIEVEMILL_TOKENIZERS names, else in the public_tokenizers package."""
    folder = os.environ.get("SIEVEMILL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: How byte-level vocabularies of this family split text before merging; a fixed value.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(keyed_text(table(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.learn(spark, docs.filter(~held_out))
    found = language.predict(spark, docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(keyed_text(table(spark, sf_dir, "documents")), tokenizer_path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed_text(table(spark, sf_dir, "documents"))
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), BYTE_PATTERN)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(spark, keyed_text(table(spark, sf_dir, "documents"))))


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, keyed_text(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(keyed_text(table(spark, sf_dir, "documents")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(spark, keyed_text(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed_text(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.learn(spark, docs, table(spark, sf_dir, "labels").filter(~held_out))
    found = toxicity.score(spark, docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_simhash_neardup": op4_simhash_neardup,
    "op5_fingerprints": op5_fingerprints,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_neardup": op10_embedding_neardup,
}
ORACLES: dict[str, str] = {}
