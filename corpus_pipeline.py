"""A corpus pipeline over ``documents``: toxicity, near copies, repeated passages, personal data, packing.

Each stage takes all that its predecessor kept and returns a DataFrame, which is written as Parquet and read again as the
next one's documents. All but the last return the columns of documents, with text and n_chars as the stage leaves them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import packing, pii, simhash, suffixes, toxicity
from sievemill.llm.common import crc_mod, keyed_text, shared_dir, table
from sievemill.llm.queries import BYTE_PATTERN, tokenizer_path

#: Ids that may be broadcast; with more, they are joined by shuffle.
BROADCAST_ROWS = 500_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of documents, with another text."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go. Learns from the labelled rows outside the held-out fold."""
    texts = keyed_text(docs)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.learn(spark, texts, table(spark, sf_dir, "labels").filter(~held_out))
    toxic = toxicity.flag(spark, docs.select(*COLUMNS), model)
    return toxic.filter(F.col("score") < 0.5).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of copies and near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    gone = simhash.redundant(spark, keyed_text(docs)).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    known = docs.withColumn("text_h", F.sha2(F.coalesce("text", F.lit("")), 256))
    return known.join(side, (known["doc_id"] == side["gone_id"]) & (known["text_h"] == side["gone_h"]), "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that documents with smaller ids have too are cut; documents left without text go."""
    rest = F.to_json(F.struct("lang", "source")).alias("extra")
    cut = suffixes.remove_repeats(spark, docs.select("doc_id", "text", rest), keep_text=True)
    cut = cut.filter((F.octet_length("kept") > 0) | (F.col("n_removed") == 0))
    extra = F.from_json("extra", "lang string, source string")
    return _with_text(cut.select("doc_id", "kept", extra["lang"].alias("lang"), extra["source"].alias("source")), F.col("kept"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by kind; terms that reveal it are generalised or removed."""
    found = pii.find(spark, docs.select(*COLUMNS))
    return _with_text(found, pii.sanitised(F.col("text"), F.col("spans")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of at most 2,048 tokens."""
    return packing.pack_documents(keyed_text(docs), tokenizer_path("byte_bpe_50k.json"), BYTE_PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_neardup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the classifier, the interleave refinement or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
