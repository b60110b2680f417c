"""Skew check: rows per task when a third of all rows share one stream.

    python tools/skew_check.py [sf_dir]

lineitem is read with a derived stream id: every third order goes to stream
0, the rest to its supplier.  Compared: hash partitioning by stream (what
``Window.partitionBy(stream)`` does) and the range-partitioned dense index.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def main() -> None:
    from pyspark.sql import functions as F

    from cadence.operators.rowindex import with_row_index
    from cadence.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(shuffle_partitions=16)
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    df = li.select(F.when(F.pmod("l_orderkey", F.lit(3)) == 0, F.lit(0)).otherwise(F.col("l_suppkey")).alias("s"),
                   "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    n = df.count()
    hot = df.filter("s = 0").count()
    hashed = df.repartition(16, "s").groupBy(F.spark_partition_id().alias("p")).count().collect()
    ranged = (with_row_index(df, ["s", "l_shipdate", "l_orderkey", "l_linenumber"], num_partitions=16)
              .groupBy(F.spark_partition_id().alias("p")).count().collect())
    for name, parts in (("hash by stream", hashed), ("range index", ranged)):
        sizes = sorted(r["count"] for r in parts)
        print(f"{name:15s} rows={n} hot={hot / n:.2f} partitions={len(sizes)} "
              f"max={sizes[-1]} mean={n / 16:.0f} max/mean={sizes[-1] / (n / 16):.2f}")


if __name__ == "__main__":
    main()
