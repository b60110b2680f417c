"""Queries of the operators that look at one text at a time: personal data, language, secrets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cadence.llm import secrets
from cadence.llm.language import identify
from cadence.llm.pii import find_pii


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs).drop("text")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    return found.select("doc_id", *[f"n_{r.kind}" for r in secrets.RULES], "base_sha256", "spans")


def _spans_sql(place: int, rule: secrets.Rule) -> str:
    """Spans of one rule: the sizes of the pieces between the matches and of the matches before."""
    pattern = rule.pattern
    if rule.either_case:  # written out, as case folding differs beyond A-Z
        words, rest = pattern.split(")", 1)
        pattern = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words) + ")" + rest
    pattern = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, lo + length(m) AS hi, lo
FROM (SELECT doc_id, i, unnest(found[i:i]) AS m, tested[i] AS tested,
             CAST(list_sum([length(x) FOR x IN parts[1:i]]) + coalesce(list_sum([length(x) FOR x IN found[1:i - 1]]), 0)
                  AS BIGINT) AS lo
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i
            FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS parts,
                         regexp_extract_all(coalesce(text, ''), '{pattern}', 0) AS found,
                         regexp_extract_all(coalesce(text, ''), '{pattern}', {rule.group}) AS tested
                  FROM documents)))
WHERE length(tested) >= {max(rule.least, 1)}"""


def _secrets_sql() -> str:
    rules = list(enumerate(secrets.RULES))
    told = "string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, place)"
    counts = ", ".join(f"count(*) FILTER (WHERE place = {i}) AS n_{r.kind}" for i, r in rules)
    return f"""
WITH spans AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in rules)})
SELECT doc_id, {counts},
       sha256(coalesce({told} FILTER (WHERE place < {len(secrets.BASE)}), '')) AS base_sha256,
       coalesce({told}, '') AS spans
FROM documents LEFT JOIN spans USING (doc_id) GROUP BY doc_id
"""


SECRETS_SQL = _secrets_sql()
