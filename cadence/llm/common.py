"""Helpers shared by the corpus operators: ids, scratch tables, batch slices."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null id takes part as an id smaller than every other.
NULL_ID = -(1 << 63)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of an Arrow batch.
ARROW_ROWS = 1000
#: The white space of words and of line ends: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"


def id_key(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def id_back(col: Column) -> Column:
    """The id of an ``id_key``: null for the key of a null id."""
    return F.when(col != F.lit(NULL_ID), col)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which the executors share.

    Only a ``local[...]`` session without that setting (tests) gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        base = tempfile.mkdtemp(prefix="cadence-llm-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that queries run wherever they
    were started from (where it is installed on the executors this is not needed), and keep Arrow
    batches small unless the session says how large they are."""
    sc = spark.sparkContext
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":  # Spark's default: tens of MB of texts in each task
        spark.conf.set(batch, str(ARROW_ROWS))
    if getattr(sc, "_cadence_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='cadence-')}/{package.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    sc._cadence_sent = True


def shipped(query: Callable) -> Callable:
    """``query(spark, ...)`` after ``ship(spark)``."""
    @wraps(query)
    def run(spark: SparkSession, *rest):
        ship(spark)
        return query(spark, *rest)
    return run


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to a scratch table and read it again: later steps do not repeat its work,
    and losing an executor loses none of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that nothing refers to any more: their
    results are in scratch tables."""
    gc.collect()
    spark.range(1).count()  # the session holds on to the query that ran last
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of ``texts`` with about ``limit`` characters each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
             "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
             "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in ddl.split(", "))])
