"""Queries of the token operators: binary records, and the merge-type piece vocabulary."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadence.llm import pieces, token_records
from cadence.llm.common import scratch


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch(spark, "token-records")
    token_records.write_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_records.records_digest(spark, path)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pieces.piece_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))
