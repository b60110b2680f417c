"""Sources, sinks and table checks.

Outputs of a run go to a fresh folder under the cluster's shared checkpoint
folder (``spark.checkpoint.dir``); only a ``local[...]`` session may do
without one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadence.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder (never reused) under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/cadence-out/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a scratch table, and that table: later passes do not repeat its work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             header: bool = True, infer: bool = False) -> DataFrame:
    """CSV with a header.  An explicit schema is the default; inference
    (a full extra pass over the data) only when asked."""
    r = spark.read.option("header", header)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", infer).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None,
                 where=None) -> DataFrame:
    """Parquet scan; the projection and the filter reach the scan
    (``ReadSchema`` / ``PushedFilters``)."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("split",)) -> str:
    """S3: overwrite as Parquet, partitioned by split for partition pruning."""
    w = df.write.mode("overwrite")
    parts = [c for c in partition_by if c in df.columns]
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV result sink with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_scoring_input(spark: SparkSession, path: str, schema: StructType | str,
                       fmt: str = "csv", multiline: bool = False) -> DataFrame:
    """Feature rows to score, from CSV or JSON (``multiline=True`` for
    files that hold one JSON array each, ``read_json_array``)."""
    if fmt == "csv":
        return read_csv(spark, path, schema)
    if multiline:
        return read_json_array(spark, path, schema)
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of files that each hold one JSON array of objects, over many lines or in one line; a file
    is split over tasks wherever it is cut.

    The files are read in pieces that end with ``}``. A piece's quotes say whether it ends inside a
    string if it began outside one, or the other way round; so the running parity of all earlier
    quotes tells where it began, and its braces outside strings how deep it ends. Prefix sums over
    the pieces (``rowindex.with_prefix_sum``, no single task) give both, and a closing brace back at
    the array's own depth ends an element. Only the pieces of one element meet."""
    from cadence.operators.rowindex import RN, with_prefix_sum, with_row_index
    pieces = (spark.read.option("lineSep", "}").text(path)
              .select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"))
              .withColumn("i", F.monotonically_increasing_id()))
    ix = with_row_index(pieces, ["f", "at", "i"], tiebreak=False)
    told = F.split(F.regexp_replace("value", r"\\.", ""), '"', -1)  # without escaped characters

    def deeper(first: int):
        """Braces and brackets that open, less those that close, in every second part."""
        parts = F.filter(told, lambda _, i: i % 2 == first)
        return F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(F.regexp_replace(p, r"[^\[{]", ""))
                           - F.length(F.regexp_replace(p, r"[^\]}]", "")))
    ends = ix.groupBy("f").agg(F.max(RN).alias("end"))  # behind its last brace a file only closes the array
    ix = ix.join(ends, "f").select(RN, "value", (F.col(RN) == F.col("end")).alias("last"), deeper(0).alias("d0"),
                                   deeper(1).alias("d1"), (F.size(told) - 1).cast("double").alias("quotes"))
    ix, _ = with_prefix_sum(ix, "quotes", "before")
    inside = (F.col("before") + F.col("quotes")) % 2 == 1  # the piece ends in a string
    closed = F.when(inside | F.col("last"), 0).otherwise(1)
    step = F.when(F.col("before") % 2 == 1, F.col("d1")).otherwise(F.col("d0")) - closed
    ix, _ = with_prefix_sum(ix.withColumn("step", step.cast("double")), "step", "depth")
    closes = (closed == 1) & (F.col("depth") + F.col("step") == 1)
    ix, _ = with_prefix_sum(ix.withColumn("closes", closes.cast("int").cast("double")), "closes", "element")
    parts = F.transform(F.sort_array(F.collect_list(F.struct(RN, "value"))), lambda p: p["value"])
    whole = (ix.filter("NOT last").groupBy("element")
             .agg(F.concat(F.array_join(parts, "}"), F.lit("}")).alias("t"), F.max("closes").alias("closes"))
             .filter("closes = 1"))
    row = F.from_json(F.regexp_replace("t", r"^[\s,\[]+", ""), schema)
    return whole.select(row.alias("row")).select("row.*")


def write_json_arrays(df: DataFrame, path: str, files: int, key: str) -> str:
    """Rows as ``files`` files of one JSON array each, dealt by a hash of ``key``."""
    from pyspark.sql import Window
    part = F.pmod(F.xxhash64(key), F.lit(files)).cast("int")
    n = F.row_number().over(Window.partitionBy("_p").orderBy("_k"))
    rows = (df.select(F.col(key).cast("string").alias("_k"), part.alias("_p"), F.to_json(F.struct(*df.columns)).alias("_t"))
            .withColumn("_n", n).select("_p", "_n", F.concat(F.when(F.col("_n") == 1, "[").otherwise(","), "_t").alias("value")))
    ends = rows.groupBy("_p").agg((F.max("_n") + 1).alias("_n")).select("_p", "_n", F.lit("]").alias("value"))
    (rows.union(ends).repartitionById(files, "_p").sortWithinPartitions("_p", "_n").select("value")
     .write.mode("overwrite").text(path))
    return path


def cached_sql_summary(df: DataFrame, split: str = "split",
                       target: str = "CycleTime_sec") -> DataFrame:
    """Temp view, ``CACHE TABLE``, SQL aggregate per split.  Only the two
    columns that the aggregate reads are cached; view and cache are released
    once its result, a row for each split, is known."""
    spark = df.sparkSession
    view = f"features_{uuid.uuid4().hex[:8]}"
    df.select(F.col(split).alias("split"), F.col(target).alias("CycleTime_sec")).createOrReplaceTempView(view)
    spark.sql(f"CACHE TABLE {view}")
    try:
        out = spark.sql(f"SELECT split, AVG(CycleTime_sec) AS avg_cycle, COUNT(*) AS n "
                        f"FROM {view} GROUP BY split ORDER BY split")
        return spark.createDataFrame(out.collect(), out.schema)
    finally:
        spark.sql(f"UNCACHE TABLE IF EXISTS {view}")
        spark.catalog.dropTempView(view)


def column_profile(df: DataFrame) -> DataFrame:
    """Per column its name, type, rows and NULLs, from ONE aggregate over
    all columns, unpivoted with ``stack``; the type comes from the schema."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(F.col(f.name).isNull()).alias(f"_n{i}") for i, f in enumerate(fields)]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{f.name}', '{f.dataType.simpleString()}', _n{i}" for i, f in enumerate(fields))
    return wide.selectExpr(f"stack({len(fields)}, {parts}) AS (column, type, nulls)", "_rows AS rows")


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Rows written (counted while writing, with ``observe``: no second
    pass) against rows read back; one row (written, read, match)."""
    from pyspark.sql import Observation
    obs = Observation(f"written_{uuid.uuid4().hex[:8]}")
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    written = obs.get["rows"]
    back = df.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("read"))
    return back.select(F.lit(written).cast("long").alias("written"), "read",
                       (F.col("read") == F.lit(written)).alias("match"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Content fingerprint, independent of row order and file layout: the
    row count and the sums of two 60-bit parts of the md5 of each row's text.
    Repeated rows add up (they do not cancel)."""
    from pyspark.sql.types import MapType
    cols = [F.array_sort(F.map_entries(F.col(f.name))) if isinstance(f.dataType, MapType) else F.col(f.name)
            for f in df.schema.fields]          # a map as its sorted entries (canonical)
    text = [F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols]
    h = F.md5(F.concat_ws("\x1f", *text))
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
    return df.agg(part(1).cast("string").alias("fingerprint_a"), part(16).cast("string").alias("fingerprint_b"),
                  F.count(F.lit(1)).alias("rows"))
