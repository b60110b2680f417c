"""Feature attribution tables.

For a linear model and an interventional background the attribution of
feature j on a row is exactly ``w_j * (x_j - mean_background(x_j))``: the value
a kernel or linear explainer estimates, here computed for every row with
column expressions, unpivoted with ``stack`` and averaged with ``groupBy``.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.models import RidgeModel, regression_metrics
from cadence.operators.rowindex import with_row_index

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package


def _stack(df: DataFrame, keep: list[str], pairs: dict[str, tuple]) -> DataFrame:
    """Unpivot: one row per (row, feature) with the given value columns."""
    n = len(pairs)
    width = len(next(iter(pairs.values())))
    args = []
    for name, cols in pairs.items():
        args.append(F.lit(name))
        args.extend(cols)
    names = ", ".join(["feature"] + [f"v{i}" for i in range(width)])
    tmp = df.select(*keep, *[c.alias(f"_a{i}") for i, c in enumerate(args)])
    expr = f"stack({n}, " + ", ".join(f"_a{i}" for i in range(len(args))) + f") AS ({names})"
    return tmp.selectExpr(*[f"`{k}`" for k in keep], expr)


def background_means(background: DataFrame, features: list[str]) -> DataFrame:
    """One row: the mean of each feature over the background rows."""
    return background.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])


def linear_attribution_rows(rows: DataFrame, model: RidgeModel, background: DataFrame,
                            keep: list[str]) -> DataFrame:
    """Long table (keys, feature, value, phi)."""
    bg = background_means(background, model.features)
    bg = bg.select(*[F.col(f).alias(f"_bg_{f}") for f in model.features])
    j = rows.crossJoin(F.broadcast(bg))
    pairs = {f: (F.col(f).cast("double"),
                 F.lit(float(w)) * (F.col(f).cast("double") - F.col(f"_bg_{f}")))
             for f, w in zip(model.features, model.coef)}
    return _stack(j, keep, pairs).withColumnRenamed("v0", "value").withColumnRenamed("v1", "phi")


def linear_attribution(rows: DataFrame, model: RidgeModel, background: DataFrame) -> DataFrame:
    """(feature, mean_abs_shap) over all explained rows."""
    long = linear_attribution_rows(rows, model, background, keep=[])
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))


def top_features(scores: DataFrame, k: int = 50, score: str = "mean_abs_shap") -> DataFrame:
    """O3: the k highest scores (ties by name)."""
    return scores.orderBy(F.desc(score), F.asc("feature")).limit(k)


def dependence_pairs(rows_long: DataFrame, scores: DataFrame, top: int = 2) -> DataFrame:
    """(value, phi) points of the ``top`` features, for dependence plots."""
    best = top_features(scores, top).select("feature")
    return rows_long.join(F.broadcast(best), "feature")


def window_attribution(win: DataFrame, weights: list[float], background: DataFrame,
                       feature_names: list[str]) -> DataFrame:
    """Attribution over all timesteps of L x F windows for a linear model
    on the flattened window (weights in row-major L x F order): mean abs phi
    over (row, timestep) per feature."""
    n_feat = len(feature_names)
    bg_cells = background.select(F.posexplode("X").alias("t", "r"))
    bg = bg_cells.groupBy("t").agg(F.array(*[F.avg(F.col("r")[j]) for j in range(n_feat)]).alias("m"))
    bgrow = bg.agg(F.sort_array(F.collect_list(F.struct("t", "m"))).alias("_bg"))
    w = F.array(*[F.lit(float(v)) for v in weights])
    cells = (win.crossJoin(F.broadcast(bgrow))
                .select(F.posexplode("X").alias("t", "r"), "_bg"))
    per = cells.select(F.explode(F.arrays_zip(
        F.array(*[F.lit(n) for n in feature_names]).alias("feature"),
        F.transform("r", lambda v, j: F.abs(w[F.col("t") * n_feat + j]
                                           * (v - F.col("_bg")[F.col("t")]["m"][j]))).alias("phi")
    )).alias("c"))
    return per.groupBy(F.col("c.feature").alias("feature")).agg(F.avg("c.phi").alias("mean_abs_shap"))


# --- R8: permutation importance without sorting ---------------------------------------

#: Rounds of the shuffle, and the prime of its hash (fits 64-bit products).
ROUNDS, PRIME = 24, (1 << 31) - 1


def _hash(a, b):
    """A number under ``PRIME`` from two; of Python numbers or of columns (none negative)."""
    u = (a % PRIME * 48271 + b) % PRIME
    return (u * u % PRIME * 69621 + u) % PRIME


def shuffle_keys(n: int, seed: int) -> tuple[list[int], list[int]]:
    """Per round of a shuffle of 0..n-1: the sum that two partners have, and the hash's key."""
    sums = [(_hash(r, seed) * PRIME + _hash(r + ROUNDS, seed)) % n for r in range(ROUNDS)]
    return sums, [_hash(r + 2 * ROUNDS, seed) for r in range(ROUNDS)]


def swap_or_not(x: np.ndarray, sums, keys, n: int) -> np.ndarray:
    """Where a keyed bijection of 0..n-1 takes the places ``x``: in each round two places with the same
    sum modulo n swap, or not, as a hash of the larger says.  ``sums`` and ``keys``: one a round, or
    one of each for every place."""
    def mod(v):  # by PRIME, one less than a power of two
        v = (v & PRIME) + (v >> 31)
        v = (v & PRIME) + (v >> 31)
        return np.where(v == PRIME, 0, v)
    for s, k in zip(sums, keys):
        partner = s - x
        partner += n * (partner < 0)
        u = mod(mod(np.maximum(x, partner)) * 48271 + k)
        odd = (mod(mod(u * u) * 69621 + u) >> 12) & 1
        x = np.where(odd == 1, partner, x)
    return x


def shuffled_place(df: DataFrame, place: str, sums: str, keys: str, n: int, name: str) -> DataFrame:
    """``name``: where ``swap_or_not`` takes ``place`` with the row's own ``sums`` and ``keys``.

    Only arithmetic on the row itself, for any n: nothing is sorted, ranked or exchanged."""
    def to(x: pa.Array, s: pa.Array, k: pa.Array) -> pa.Array:
        rounds = [c.flatten().to_numpy().reshape(len(x), -1).T for c in (s, k)]
        return pa.array(swap_or_not(x.to_numpy(), *rounds, n))
    return df.withColumn(name, F.arrow_udf(to, "long")(F.col(place).cast("long"), sums, keys))


def shuffled_places(df: DataFrame, place: str, plans: list[tuple], n: int, name: str) -> DataFrame:
    """``name``: an array of where ``swap_or_not`` takes ``place``, with the sums and keys of each of ``plans``."""
    plans = [tuple(np.array(c, np.int64) for c in p) for p in plans]

    def to(x: pa.Array) -> pa.Array:
        at = np.stack([swap_or_not(x.to_numpy(), *p, n) for p in plans], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(plans), pa.int32()), pa.array(at.ravel()))
    return df.withColumn(name, F.arrow_udf(to, "array<long>")(F.col(place).cast("long")))


def scored_by(model, df: DataFrame, name: str = "pred") -> DataFrame:
    """``df`` with the prediction of a ridge model or of any fitted ``PipelineModel``."""
    if isinstance(model, RidgeModel):
        return df.withColumn(name, model.predict(name))
    return model.transform(df).withColumnRenamed("pred", name)


def permutation_importance(rows: DataFrame, model, key: str, label: str, repeats: int = 1, seed: int = 42,
                           metric: str = "mae", features: list[str] | None = None) -> DataFrame:
    """(feature, importance, spread): mean and population std over ``repeats`` of the rise of MAE
    (or the fall of R2) when one feature is shuffled; of a ridge model, or of any fitted
    ``PipelineModel`` that reads ``features``.

    The rows are numbered once in key order (``rowindex``). Each (feature, repeat) has a bijection of
    the positions, so the position of a row's donor is computed, and the donor's value is fetched by a
    hashed equi-join on it: no copy of the rows is ranked or sorted."""
    feats = list(model.features) if features is None else list(features)
    ix = with_row_index(rows.select(key, label, *feats), [key], name="_p").drop(key)
    n = ix.count()
    if not n:
        return ix.sparkSession.createDataFrame([], "feature string, importance double, spread double")
    plans = [shuffle_keys(n, _hash(seed, j * 1009 + r)) for j in range(len(feats)) for r in range(repeats)]
    copies = shuffled_places(ix, "_p", plans, n, "_to").select(label, *feats, F.posexplode("_to").alias("_q", "_donor"))
    donors = ix.select(F.col("_p").alias("_donor"), F.array(*[F.col(f).cast("double") for f in feats]).alias("_values"))
    met = copies.join(donors.hint("shuffle_hash"), "_donor")
    shuffled = met.select("_q", label, *[
        F.when(F.col("_q").between(j * repeats, (j + 1) * repeats - 1), F.get("_values", F.lit(j)))
        .otherwise(F.col(f).cast("double")).alias(f) for j, f in enumerate(feats)])
    m = regression_metrics(scored_by(model, shuffled), label, "pred", ["_q"])
    of = F.array(*[F.lit(f) for f in feats for _ in range(repeats)])
    m = m.select(F.get(of, F.col("_q")).alias("feature"), "mae", "r2")
    b = regression_metrics(scored_by(model, ix.withColumn("_g", F.lit(1))), label, "pred", ["_g"])
    out = m.crossJoin(F.broadcast(b.select(F.col("mae").alias("_bmae"), F.col("r2").alias("_br2"))))
    change = (F.col("mae") - F.col("_bmae")) if metric == "mae" else (F.col("_br2") - F.col("r2"))
    return out.groupBy("feature").agg(F.avg(change).alias("importance"), F.stddev_pop(change).alias("spread"))
