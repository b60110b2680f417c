"""Statistics, imputation, scaling, flags.

Train statistics are one aggregate (partial aggregation, one row out) and are
applied by a broadcast cross join of that one-row frame: nothing goes through
the driver, the broadcast has a fixed size (one value per feature).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.operators.splits import seeded_unit
from cadence.roles import SPLIT, TARGET

# Reference thresholds and floors.
LONG_THRESHOLD = 90.0
RATE_FLOOR = 1e-6
STD_FLOOR = 1e-8
DECISION = 0.5
ZERO_STD_EPS = 10 * 2.220446049250313e-16


# --- P10-P13: row expressions --------------------------------------------------

def long_flag(target: Column | str, threshold: float = LONG_THRESHOLD) -> Column:
    """P10: 1 when target >= threshold."""
    t = F.col(target) if isinstance(target, str) else target
    return (t >= F.lit(threshold)).cast("int")


def log_target(c: Column) -> Column:
    """P11 forward."""
    return F.log1p(c)


def inverse_log_target(c: Column) -> Column:
    """P11 inverse."""
    return F.expm1(c)


def finite_or_null(c: Column) -> Column:
    """NaN and +-inf become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def decide(prob: Column, cut: float = DECISION) -> Column:
    """Class from probability."""
    return (prob >= F.lit(cut)).cast("int")


# --- G6-G11 -----------------------------------------------------------------------

def target_stats(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Row count and max target in one aggregate."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.max(target).alias("max_target"))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas, SQL ``quantile_cont``)
    of several columns, without sorting them and without a hot task.

    ``df`` is evaluated twice (``rowindex.values_at_fractions``): counts and
    sketches, then the few values around the ranks floor/ceil of p*(n-1).
    NULL, NaN and infinities are skipped.  Output: (feature, p, value), one
    row per column and p."""
    from cadence.operators.rowindex import values_at_fractions
    v = {c: finite_or_null(F.col(f"`{c}`").cast("double")) for c in columns}
    between = lambda n, p: (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))
    counts, got = values_at_fractions(df, v, list(probs), between)
    rows = []
    for c in columns:
        n = counts[c]
        for p in probs if n else []:
            at = p * (n - 1)
            lo, hi = got[c, math.floor(at)], got[c, math.ceil(at)]
            rows.append((c, float(p), lo + (at - math.floor(at)) * (hi - lo)))
    return df.sparkSession.createDataFrame(rows, "feature string, p double, value double")


def describe(df: DataFrame, columns: list[str], exact: bool = True,
             accuracy: int = 10_000) -> DataFrame:
    """Pandas ``describe().T``: one row per column with count, mean,
    sample std, min, quartiles, max.  Moments come from one aggregate;
    quartiles are exact (``exact_quantiles``, linear interpolation as
    pandas) or the mergeable ``percentile_approx`` sketch."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(x).cast("double").alias("count"),
                             F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                             F.min(x).alias("min"), F.max(x).alias("max")).alias(f"_{c}"))
    moments = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"_{c}") for c in columns])).alias("d")
                                   ).select("d.*")
    q = _quartiles(df, columns, [0.25, 0.5, 0.75], exact, accuracy)
    return moments.join(F.broadcast(q), "column").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _quartiles(df, columns, probs, exact, accuracy):
    """(column, p25, p50, p75)-style table, one row per column (bounded)."""
    names = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    if exact:
        q = exact_quantiles(df, columns, probs)
        return (q.groupBy(F.col("feature").alias("column"))
                 .agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(names[p]) for p in probs]))
    aggs = [F.struct(F.lit(c).alias("column"), *[
        F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy).cast("array<double>")[i]
        .alias(names[p]) for i, p in enumerate(probs)]).alias(f"_{c}") for c in columns]
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"_{c}") for c in columns])).alias("d")
                                ).select("d.*")


def train_stats(df: DataFrame, features: list[str], split: str | None = SPLIT,
                train_value: str = "train", median: bool = True, exact: bool = True,
                accuracy: int = 10_000) -> DataFrame:
    """Scaler table (feature, mean, std [population], median) over train rows.

    NULLs are skipped (nanmean); NaN/inf are treated as missing.  The median
    is exact (``exact_quantiles``) or from the ``percentile_approx`` sketch."""
    src = df.filter(F.col(split) == train_value) if split else df
    aggs = []
    for c in features:
        x = finite_or_null(F.col(c).cast("double"))
        aggs.append(F.struct(F.lit(c).alias("feature"), F.avg(x).alias("mean"),
                             F.stddev_pop(x).alias("std")).alias(f"_{c}"))
    wide = src.agg(*aggs)
    mom = wide.select(F.explode(F.array(*[F.col(f"_{c}") for c in features])).alias("s")).select("s.*")
    if not median:
        return mom.withColumn("median", F.lit(None).cast("double"))
    if exact:
        med = exact_quantiles(src, features, [0.5]).select("feature", F.col("value").alias("median"))
    else:
        med = src.agg(*[F.struct(F.lit(c).alias("feature"), F.percentile_approx(
            finite_or_null(F.col(c).cast("double")), 0.5, accuracy).cast("double").alias("median"))
            .alias(f"_{c}") for c in features]).select(
            F.explode(F.array(*[F.col(f"_{c}") for c in features])).alias("m")).select("m.*")
    return mom.join(F.broadcast(med), "feature", "left").select("feature", "mean", "std", "median")


def class_rate(df: DataFrame, target: str = TARGET, threshold: float = LONG_THRESHOLD,
               split: str | None = SPLIT, train_value: str = "train") -> DataFrame:
    """Long-cycle rate p of train rows and class weight (1-p)/p, p floored."""
    src = df.filter(F.col(split) == train_value) if split else df
    p = F.avg(long_flag(target, threshold).cast("double"))
    return (src.agg(p.alias("long_rate"))
               .withColumn("pos_weight", (F.lit(1.0) - F.col("long_rate"))
                           / F.greatest(F.col("long_rate"), F.lit(RATE_FLOOR))))


def stream_sizes(df: DataFrame, stream: str, window: int, top: int | None = None) -> DataFrame:
    """Every stream with at least ``window + 1`` rows; with ``top`` the
    listing of the largest ones, largest first."""
    sizes = (df.groupBy(stream).agg(F.count(F.lit(1)).alias("rows"))
               .filter(F.col("rows") >= window + 1))
    return sizes if top is None else sizes.orderBy(F.desc("rows"), F.asc(stream)).limit(top)


def train_mean(df: DataFrame, target: str = TARGET, split: str = SPLIT) -> DataFrame:
    """G11."""
    return df.filter(F.col(split) == "train").agg(F.avg(target).alias("train_mean"))


# --- M1-M4: row imputation and scaling -----------------------------------------

def _stats_row(stats: DataFrame, features: list[str]) -> DataFrame:
    """Scaler table -> one row with one struct per feature, by place."""
    pick = lambda f, v: F.max(F.when(F.col("feature") == f, F.col(v))).alias(v)
    return stats.agg(*[F.struct(*[pick(f, v) for v in ("mean", "std", "median")]).alias(f"_st{i}")
                       for i, f in enumerate(features)])


def _with_stats(df: DataFrame, features: list[str], stats: DataFrame, value) -> DataFrame:
    """Each feature replaced by ``value(column, its struct)`` in one projection;
    the statistics are one row, joined by broadcast."""
    place = {f: i for i, f in enumerate(features)}
    joined = df.crossJoin(F.broadcast(_stats_row(stats, features)))
    return joined.select(*[value(F.col(f"`{c}`"), F.col(f"_st{place[c]}")).alias(c) if c in place
                           else F.col(f"`{c}`") for c in df.columns])


def impute(df: DataFrame, features: list[str], stats: DataFrame, how: str = "median",
           all_null: float | None = 0.0) -> DataFrame:
    """M1 (``median``) / M2 (``mean``): fill missing and non-finite values with
    the train statistic; a feature with no train value gets ``all_null``."""
    def value(c: Column, st: Column) -> Column:
        fill = st[how] if all_null is None else F.coalesce(st[how], F.lit(all_null))
        return F.coalesce(finite_or_null(c.cast("double")), fill)
    return _with_stats(df, features, stats, value)


def standardize(df: DataFrame, features: list[str], stats: DataFrame,
                zero_std: str = "one") -> DataFrame:
    """M4: (x - mean) / std with train mean and population std.  A zero std
    leaves the value unscaled (``zero_std="one"``, sklearn) or is floored at
    1e-8 (``"floor"``, the scoring path)."""
    def value(c: Column, st: Column) -> Column:
        mu, sd = F.coalesce(st["mean"], F.lit(0.0)), st["std"]
        if zero_std == "one":
            # a std within float noise of zero counts as zero (as sklearn's scaler)
            tiny = F.lit(ZERO_STD_EPS) * F.greatest(F.abs(mu), F.lit(1.0))
            sd = F.when(sd.isNull() | (sd <= tiny), F.lit(1.0)).otherwise(sd)
        else:
            sd = F.greatest(F.coalesce(sd, F.lit(0.0)), F.lit(STD_FLOOR))
        return (c - mu) / sd
    return _with_stats(df, features, stats, value)


# --- M3, M5: sequence windows ---------------------------------------------------

def window_cell_stats(windows: DataFrame, n_features: int, split: str | None = SPLIT,
                      train_value: str = "train") -> DataFrame:
    """One row: per-feature mean and population std over all N*T cells of the
    train windows (rows weighted by how many windows hold them, as the
    reference's ``mean(axis=(0,1))``), NaN/inf/NULL skipped for the mean."""
    src = windows.filter(F.col(split) == train_value) if split else windows
    cells = src.select(F.explode("X").alias("r"))
    xs = [finite_or_null(F.col("r")[j]) for j in range(n_features)]
    return cells.agg(F.array(*[F.avg(x) for x in xs]).alias("_mu"),
                     F.array(*[F.stddev_pop(x) for x in xs]).alias("_sd"))


def row_cell_stats(placed: DataFrame, features: list[str], length: int, target_inside: bool,
                   split: str | None = SPLIT, train_value: str = "train",
                   imputed: bool = False) -> DataFrame:
    """``window_cell_stats`` without windows: every row of ``rowindex.with_place`` counts as often as
    windows hold it.  The windows must not cross ``split``.  ``imputed``: mean and std of the cells
    after missing ones got the mean (0 where a feature has none).  Two aggregates over rows: the
    means, then the squares around them."""
    from cadence.operators.rowindex import windows_holding
    src = placed.filter(F.col(split) == train_value) if split else placed
    rows = src.select(windows_holding(length, target_inside).cast("double").alias("_w"), *[
        finite_or_null(F.col(f"`{c}`").cast("double")).alias(f"_x{j}") for j, c in enumerate(features)])
    rows = rows.filter("_w > 0")
    xs = [F.col(f"_x{j}") for j in range(len(features))]
    held = [F.sum(F.when(x.isNotNull(), F.col("_w"))) for x in xs]
    mu = rows.agg(F.array(*[F.sum(F.col("_w") * x) / n for x, n in zip(xs, held)]).alias("_mu"))
    around = [F.sum(F.col("_w") * (x - F.col("_mu")[j]) * (x - F.col("_mu")[j])) for j, x in enumerate(xs)]
    sd = (rows.crossJoin(F.broadcast(mu))
          .agg(F.array(*[F.sqrt((F.coalesce(a, F.lit(0.0)) / F.sum("_w")) if imputed else a / n)
                         for a, n in zip(around, held)]).alias("_sd")))
    if imputed:
        mu = mu.select(F.transform("_mu", lambda m: F.coalesce(m, F.lit(0.0))).alias("_mu"))
    return mu.crossJoin(F.broadcast(sd))


def fit_row_scaler(placed: DataFrame, features: list[str], length: int, target_inside: bool = True,
                   split: str | None = SPLIT, train_value: str = "train") -> tuple[DataFrame, DataFrame]:
    """``fit_window_scaler`` from rows: train cell means for imputation, then mean and population
    std of the imputed cells."""
    scale = row_cell_stats(placed, features, length, target_inside, split, train_value, imputed=True)
    return scale.select("_mu"), scale


def impute_windows(windows: DataFrame, means: DataFrame) -> DataFrame:
    """M2 on windows: fill missing cells with the train cell mean (0 when a
    feature has none)."""
    m = F.broadcast(means.select("_mu"))
    return (windows.crossJoin(m)
                   .withColumn("X", F.transform("X", lambda r: F.transform(
                       r, lambda v, j: F.coalesce(finite_or_null(v), F.col("_mu")[j], F.lit(0.0)))))
                   .drop("_mu"))


def standardize_windows(windows: DataFrame, stats: DataFrame) -> DataFrame:
    """M5: (x - mu) / max(std, 1e-8) per feature on every cell."""
    s = F.broadcast(stats.select("_mu", "_sd"))
    sd = lambda j: F.greatest(F.coalesce(F.col("_sd")[j], F.lit(0.0)), F.lit(STD_FLOOR))
    return (windows.crossJoin(s)
                   .withColumn("X", F.transform("X", lambda r: F.transform(
                       r, lambda v, j: (v - F.col("_mu")[j]) / sd(j))))
                   .drop("_mu", "_sd"))


def fit_window_scaler(windows: DataFrame, n_features: int, split: str | None = SPLIT,
                      train_value: str = "train") -> tuple[DataFrame, DataFrame]:
    """The sequence trainer's scaler: train cell means for imputation, then
    mean and population std of the *imputed* train cells (one-row frames)."""
    means = window_cell_stats(windows, n_features, split, train_value)
    imputed = impute_windows(windows, means)
    return means, window_cell_stats(imputed, n_features, split, train_value)


def apply_window_scaler(windows: DataFrame, means: DataFrame, scale: DataFrame) -> DataFrame:
    """M2 + M5 on windows with a fitted scaler."""
    return standardize_windows(impute_windows(windows, means), scale)


def timestep_means(windows: DataFrame, n_features: int) -> DataFrame:
    """M3 statistic: one row, the mean of each feature at each timestep over
    the batch (L x F values, a fixed size)."""
    cells = windows.select(F.posexplode("X").alias("t", "r"))
    per_t = cells.groupBy("t").agg(F.array(*[
        F.avg(finite_or_null(F.col("r")[j])) for j in range(n_features)]).alias("m"))
    return per_t.agg(F.sort_array(F.collect_list(F.struct("t", "m"))).alias("_tm"))


def row_timestep_means(placed: DataFrame, features: list[str], length: int,
                       target_inside: bool) -> DataFrame:
    """``timestep_means`` without windows: the rows of ``rowindex.with_place`` that are timestep t of
    some window are averaged, L x F values in one aggregate."""
    from cadence.operators.rowindex import at_timestep
    mean = lambda c, ok: F.avg(F.when(ok, finite_or_null(F.col(f"`{c}`").cast("double"))))
    return placed.agg(F.array(*[
        F.struct(F.lit(t).alias("t"), F.array(*[mean(c, at_timestep(t, length, target_inside))
                                                for c in features]).alias("m"))
        for t in range(length)]).alias("_tm"))


def impute_per_timestep(windows: DataFrame, n_features: int, means: DataFrame | None = None) -> DataFrame:
    """M3: fill a missing cell with the batch mean of its feature at its timestep (``means``: from
    ``row_timestep_means``, else from the windows)."""
    tm = F.broadcast(timestep_means(windows, n_features) if means is None else means)
    return (windows.crossJoin(tm)
                   .withColumn("X", F.transform("X", lambda r, t: F.zip_with(
                       r, F.col("_tm")[t]["m"], lambda v, m: F.coalesce(finite_or_null(v), m))))
                   .drop("_tm"))


# --- M6: weighted oversampling ------------------------------------------------------

def oversample(df: DataFrame, key: str, weight: Column, seed: int = 42,
               draws: int | None = None) -> DataFrame:
    """M6: exactly ``draws`` rows (default: as many as there are), drawn with probability
    proportional to ``weight``: systematic sampling.

    The rows stand in the order of the seeded md5 of their key; the prefix sums of their weights
    (``rowindex.with_prefix_sum``, no single task) cut the line of length sum(w) into pieces, and
    draw k = 0 .. n-1 takes the row whose piece holds (k + u) * sum(w) / n, u from the seed.  So a
    row comes floor or ceil of n * w / sum(w) times.  Rows without a positive weight never come."""
    from cadence.operators.rowindex import RN, with_prefix_sum, with_row_index
    src = df.withColumn("_w", F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0)))
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    ix, total = with_prefix_sum(with_row_index(src, [order]), "_w", "_before")
    n = ix.count() if draws is None else draws
    if not total:
        return df.limit(0).withColumn("_draw", F.lit(0))
    u = seeded_unit(F.lit("draw"), seed)
    upto = lambda at: F.ceil(at * float(n) / F.lit(total) - u)  # noqa: E731 - draws before a place
    copies = (upto(F.col("_before") + F.col("_w")) - upto(F.col("_before"))).cast("int")
    return (ix.withColumn("_copies", copies).filter(F.col("_copies") > 0)
              .withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
              .drop("_copies", "_before", "_w", RN))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
