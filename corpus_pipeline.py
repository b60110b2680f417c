"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

1. language: documents without a recognisable language go: no text, no letter in it, or text that the
   automata of the learned languages parse far worse than unseen text of those languages;
2. lines: lines that a smaller document holds go from the texts;
3. near: of each group of near duplicates one document stays;
4. mix: the documents are put in the order that mixes their sources to the target weights; it is
   the order of the rows in the written files, all documents stay;
5. pieces: every text as piece ids, decoded again, with its place in the mixed sequence (mix_slot,
   mix_place: order by both).

All stages but the last return the columns of ``documents``, and keep further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from cadence.llm.common import shipped, stage
from cadence.llm.language import predict_language, recognised, training_sample
from cadence.llm.line_dedup import line_dedup
from cadence.llm.minhash import keep_unlike
from cadence.llm.mixing import in_mixed_order, mix_sources, places_in_files, with_file_order
from cadence.llm.pieces import digest_texts
from cadence.llm.q_mixing import BLOCK, SEED, WEIGHTS

#: Near duplicates share this many hundredths of their five-word shingles, or more.
NEAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    training = training_sample(docs)
    found = predict_language(docs, training)
    return found.filter(recognised(training)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_unlike(docs, percent=NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mixed_order(mix_sources(docs, WEIGHTS, BLOCK, seed=SEED)).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of a document in the mixed sequence is where the mixed files hold it: file and row,
    taken along with the digests, in blocks of ``BLOCK`` rows."""
    found = stage(digest_texts(with_file_order(docs), public_tokenizers.path("piece_bpe_32k.model")), "digests")
    return places_in_files(found, BLOCK).select("doc_id", "text.*", "mix_slot", "mix_place")


STAGES = [(f.__name__, shipped(f)) for f in (language, lines, near, mix, pieces)]
#: SQL cannot say cross-parsing or piece merges: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
