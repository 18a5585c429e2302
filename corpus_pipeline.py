"""A corpus pipeline of four stages over documents: quality, near-duplicates, mixing, token ids."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import bpe, mixing, quality, simhash
from barflow.llm.cluster import cut_lineage, unused
from barflow.llm.queries import ACCEPT, MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, RANKS, source_domain


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labelled rows of ``docs``."""
    forest = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score_")
    return quality.with_score(docs, forest, out=score).where(F.col(score) >= ACCEPT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target mix takes, once for each epoch that has them."""
    return mixing.mix(docs, source_domain(), MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED, keep_columns=True)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with their number and the digest of what they decode to."""
    encoded = bpe.with_tokens(docs.select("doc_id", "lang", "source", "text"), partial(public_tokenizers.path, RANKS), public_tokenizers.PATTERN, decoded="bytes")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", accept_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: A fitted classifier and 64-bit hashes are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are cut from their lineage before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
