"""The corpus pipeline: language, exact copies, near copies, mixture, tokens. Each stage works on all that the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellum.llm.bpe import encode_decode
from vellum.llm.common import Scratch, documents
from vellum.llm.exact import exact_dedup, keep_first
from vellum.llm.language import held_out, keep_identified, train
from vellum.llm.mixing import apply_mix, mix
from vellum.llm.near import keep_one, near_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or letterless texts) go."""
    langs, model = train(docs.filter(~held_out("doc_id")))
    return keep_identified(docs, langs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return keep_first(docs, exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id stays."""
    return keep_one(docs, near_dedup(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return apply_mix(docs, mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("tokens", tokens)]
#: Training, MinHash and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again by the next."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        kept = scratch.save(out)
        scratch.drop(docs)
        docs = kept
    return docs
