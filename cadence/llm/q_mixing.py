"""Query of the source mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadence.llm.mixing import REST, mix_sources, shares

#: Target weights, as parts of their sum: 100 for the largest source, 60 for each of nine, 36 for each
#: of ten more; other sources together weigh one of those.
WEIGHTS = {"src0": 0.100, **{f"src{i}": 0.060 for i in range(1, 10)},
           **{f"src{i}": 0.036 for i in range(10, 20)}, None: 0.036}
BLOCK, SEED = 32, 7


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs, WEIGHTS, BLOCK, seed=SEED).select(
        "doc_id", "source", "mix_slot", "mix_place")


def _sql() -> str:
    """The schedule of a frame as a recursion over its slots: of the blocks released, the one with
    the earliest deadline."""
    named = {s: w for s, w in WEIGHTS.items() if s is not None}
    slots = shares({**named, REST: WEIGHTS[None]})
    order, frame = sorted(slots), sum(slots.values())
    text = lambda s: "''" if s == REST else f"'{s}'"
    names = ", ".join(text(s) for s in order)
    sizes = ", ".join(str(slots[s]) for s in order)
    return f"""
WITH RECURSIVE w AS (SELECT [{names}] AS names, [{sizes}] AS a),
frame(t, done, pick) AS (
  SELECT -1, [0 FOR x IN a], 0 FROM w
  UNION ALL
  SELECT t + 1, [done[i] + (i = p)::INT FOR i IN range(1, len(a) + 1)], p
  FROM (SELECT f.t, f.done, w.a, list_position(due, list_min(due)) AS p
        FROM (SELECT t, done, [CASE WHEN done[i] * {frame} // a[i] <= t + 1
                               THEN -((-(done[i] + 1) * {frame}) // a[i]) ELSE 1000000 END
                               FOR i IN range(1, len(a) + 1)] AS due
              FROM frame, w WHERE t < {frame} - 1) f, w)),
plan AS (
  SELECT names[pick] AS s, t AS slot, a[pick] AS each,
         row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS i
  FROM frame, w WHERE t >= 0),
named AS (
  SELECT doc_id, source, CASE WHEN list_contains(names, source) AND source <> '' THEN source ELSE '' END AS s
  FROM documents, w),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('{SEED}:' || coalesce(doc_id::VARCHAR, ''))) - 1 AS n
  FROM named)
SELECT doc_id, source, (n // {BLOCK}) // p.each * {frame} + p.slot AS mix_slot,
       CAST(n % {BLOCK} AS INTEGER) AS mix_place
FROM numbered JOIN plan p ON p.s = numbered.s AND p.i = (n // {BLOCK}) % p.each
"""


SQL = _sql()
