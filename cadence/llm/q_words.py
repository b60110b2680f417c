"""Query of the spelling variant operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.spelling import count_words, group_variants, runs_of


def misspelt(doc_id: Column, run: Column) -> Column:
    """A run without one code point, where the crc32 of document and run says so; a null id as is."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(199)) == 0, cut).otherwise(run)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    runs = docs.select("doc_id", F.explode(runs_of(F.col("text"))).alias("run"))
    return group_variants(count_words(runs.select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))))


SQL = """
WITH RECURSIVE crc AS (
  SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1
          THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FOR i IN range(256)] AS t),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END
                          FOR c IN string_split(doc_id || ':' || run, '')]) AS b FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || [CAST(x AS BIGINT) FOR x IN b],
                     lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc),
spelt AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
  SELECT word, n, p, word[1:p - 1] || word[p + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b
  ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
found AS (
  SELECT w.word, w.n, CASE WHEN b.m >= 5 * w.n THEN b.other END AS form, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk(word, root) AS (
  SELECT word, word FROM found
  UNION SELECT walk.word, found.form FROM walk JOIN found ON found.word = walk.root WHERE found.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN found ON found.word = walk.root WHERE found.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM found JOIN ends USING (word)
"""
