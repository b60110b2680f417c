"""Line dedup, with DataFrame functions only.

Lines are exploded, normalised and hashed; each hash gets its smallest document by a
map-side combined aggregate; lines over the threshold go everywhere else, and the text is put
together again by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import BLANKS, UPPER, id_key, stage


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
               min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop each line whose key is found in ``min_docs`` documents, save in the smallest one.

    A key is the line without blanks at its ends, A-Z in lower case; keys of fewer than
    ``min_chars`` code points are never dropped. Returns the columns of ``docs`` with ``text``
    cut down, and n_lines (before), n_dropped. Input columns of those two names are replaced.

    A null text is one empty line and becomes ''. A null id is one id, smaller than all others.
    Rows that repeat an id are one document: a line on both is no repeat. An empty table gives
    an empty result.

    Scale: only hashes are grouped (two 64-bit hashes and an id a line), with partial
    aggregation, so a line of every document costs one row a task. The lines of a hot key come
    back by a plain join, which adaptive execution can split. The text moves once, to meet the
    positions of its dropped lines.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                    id_key(doc_id).alias("k"),
                    F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    d = d.withColumn("h", F.xxhash64("t"))
    key = F.translate(F.btrim(F.col("line"), F.lit(BLANKS)), UPPER, UPPER.lower())
    lines = (d.select("k", "h", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
             .select("k", "h", "pos", key.alias("key"))
             .filter(F.length("key") >= min_chars)
             .select("k", "h", "pos", F.xxhash64("key").alias("a"),
                     F.xxhash64(F.lit("second"), "key").alias("b")))
    lines = stage(lines, "lines")
    if min_docs == 2:  # two documents: the smallest is not the largest
        often = lines.groupBy("a", "b").agg(F.min("k").alias("first"), F.max("k").alias("last"))
        often = often.filter("first < last").drop("last")
    else:  # one row for each key and document first, so that the count stays combinable
        often = (lines.groupBy("a", "b", "k").agg(F.lit(1).alias("one")).groupBy("a", "b")
                 .agg(F.min("k").alias("first"), F.count("one").alias("n"))
                 .filter(F.col("n") >= min_docs).drop("n"))
    drops = (lines.join(often, ["a", "b"]).filter("k > first")
             .groupBy("k", "h").agg(F.collect_set("pos").alias("drops")))
    parts = F.split("t", "\n", -1)
    out = (d.join(drops, ["k", "h"], "left")
           .withColumn("parts", parts)
           .withColumn("n", F.size("parts"))
           .withColumn("keep", F.when(F.col("drops").isNotNull(), F.array_except(
               F.sequence(F.lit(0), F.col("n") - 1), F.col("drops"))))
           .withColumn("kept", F.when(F.col("drops").isNull(), F.col("t")).otherwise(F.array_join(
               F.transform("keep", lambda i: F.get("parts", i)), "\n"))))
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c)
                        for c in cols],
                      F.col("n").cast("long").alias("n_lines"),
                      F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"))
