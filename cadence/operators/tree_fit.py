"""Forests and boosting fitted on sums of cells.

A tree on binned features only asks in which bins a row lies, so all that it needs of the rows is, for
each occupied cell (a bin of every feature), the summed weight and the summed weight times label of the
sampled rows.  The rows are placed in their cells once.  One pass then draws the samples of hundreds of
trees (every row anew for every tree) and adds them up per cell, in each task and then per tree.

* A forest's trees are grown where the sums of one tree meet: the passes hold no level of a tree, and
  all trees grow in parallel.
* In boosting the samples do not depend on the predictions, and rows of a cell have one prediction, so
  the residuals of a round follow from its sums: a round is arithmetic on cells, not passes over rows.

The number of cells is bounded by the bins (32 a feature), whatever the rows; if the bins of a table
make more than ``CELLS``, ``fit_on_cells`` says so (None) and MLlib's fit on rows is the way.
Splits, samples and stopping rules are MLlib's, and so is the model that comes back: it is written in
the layout of MLlib's saved trees and loaded.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.sources.io import scratch_path, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package

#: Cells that bins may make, at most.
CELLS = 1 << 20
#: Sums (trees x cells) that a task holds, at most; rows that it samples at once.
SUMS, ROWS = 1 << 21, 1 << 18
#: Values that the bins of a feature are chosen from, as ranks of a sketch.
RANKS, ACCURACY = 1024, 10_000
_SUMS = "t int, w binary, s binary"
_NODES = ("t int, id int, prediction double, w double, s double, gain double, left int, right int, "
          "feature int, cut double")
_NODE_SCHEMA = pa.schema([("t", pa.int32()), ("id", pa.int32()), ("prediction", pa.float64()), ("w", pa.float64()),
                          ("s", pa.float64()), ("gain", pa.float64()), ("left", pa.int32()), ("right", pa.int32()),
                          ("feature", pa.int32()), ("cut", pa.float64())])


def cut_points(values: list[float], bins: int) -> np.ndarray:
    """Thresholds from values at equal ranks: between all distinct ones if the bins allow, else at
    equal shares of the rows."""
    seen = np.unique(np.asarray(values, float))
    if len(seen) <= bins:
        low = seen[:-1]
    else:
        low = np.unique(np.asarray(values, float)[[i * (len(values) - 1) // bins for i in range(1, bins)]])
        low = low[low < seen[-1]]
    return np.unique((low + seen[np.searchsorted(seen, low) + 1]) / 2)


def grow(bins: np.ndarray, cuts: list[np.ndarray], w: np.ndarray, s: np.ndarray, depth: int, subset: int,
         rng) -> tuple[list[np.ndarray], np.ndarray]:
    """A regression tree on cells: columns of ``_NODES`` from id on (children behind their parents),
    and the prediction of every cell.  ``bins``: (features, cells); at each node ``subset`` features
    drawn at random may split."""
    n = bins.shape[1]
    at = np.zeros(n, int)  # the node of each cell
    kind = [("w", float), ("s", float), ("gain", float), ("left", int), ("right", int), ("feature", int), ("cut", float)]
    levels = [np.array([(w.sum(), s.sum(), -1.0, -1, -1, -1, 0.0)], kind)]
    start, made = 0, 1
    for _ in range(depth):
        nodes = levels[-1]
        k = len(nodes)
        live = np.flatnonzero(at >= start)
        own, lw_, ls_ = at[live] - start, w[live], s[live]
        best, feature, where = np.zeros(k), np.full(k, -1), np.zeros(k, int)
        chosen = np.argsort(rng.random((k, len(cuts))), axis=1) < subset
        for f, cut in enumerate(cuts):
            b = len(cut) + 1
            if b == 1:
                continue
            flat = own * b + bins[f, live]
            left_w = np.bincount(flat, lw_, k * b).reshape(k, b).cumsum(1)[:, :-1]
            left_s = np.bincount(flat, ls_, k * b).reshape(k, b).cumsum(1)[:, :-1]
            right_w, right_s = nodes["w"][:, None] - left_w, nodes["s"][:, None] - left_s
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (left_s ** 2 / left_w + right_s ** 2 / right_w
                        - (nodes["s"] ** 2 / nodes["w"])[:, None]) / nodes["w"][:, None]
            gain[(left_w < 1) | (right_w < 1) | ~chosen[:, f:f + 1]] = -1.0
            top = gain.argmax(1)
            gain = gain[np.arange(k), top]
            better = gain > best
            best[better], feature[better], where[better] = gain[better], f, top[better]
        # below the noise of the sums there is nothing to gain
        split = np.flatnonzero((feature >= 0) & (best > 1e-14 * (nodes["s"] / np.maximum(nodes["w"], 1)) ** 2))
        if not len(split):
            break
        nodes["gain"][split], nodes["feature"][split] = best[split], feature[split]
        nodes["cut"][split] = [cuts[feature[i]][where[i]] for i in split]
        nodes["left"][split] = made + 2 * np.arange(len(split))
        nodes["right"][split] = nodes["left"][split] + 1
        moves = live[nodes["left"][own] >= 0]
        own = at[moves] - start
        right = bins[feature[own], moves] > where[own]
        at[moves] = np.where(right, nodes["right"][own], nodes["left"][own])
        kids = np.zeros(2 * len(split), kind)
        kids["w"] = np.bincount(at[moves] - made, w[moves], len(kids))
        kids["s"] = np.bincount(at[moves] - made, s[moves], len(kids))
        kids["gain"], kids["left"], kids["right"], kids["feature"] = -1.0, -1, -1, -1
        levels.append(kids)
        start, made = made, made + len(kids)
    tree = np.concatenate(levels)
    value = tree["s"] / np.maximum(tree["w"], 1)
    columns = [np.arange(made), value, *[tree[c] for c in ("w", "s", "gain", "left", "right", "feature", "cut")]]
    return columns, value[at]


def nodes_table(t: int, columns: list[np.ndarray]) -> pa.Table:
    parts = [np.full(len(columns[0]), t), *columns]
    return pa.table([pa.array(c, f.type) for c, f in zip(parts, _NODE_SCHEMA)], schema=_NODE_SCHEMA)


def poisson_cuts() -> np.ndarray:
    """Where a 32-bit draw becomes one more in a Poisson number of mean 1."""
    below = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)])
    return np.minimum(np.floor(below * 2.0 ** 32), 2.0 ** 32 - 1).astype(np.uint32)


def sampled_sums(placed: DataFrame, cells: np.ndarray, trees: range, rate: float | None, seed: int) -> DataFrame:
    """(t, w, s): per tree of ``trees`` and task, the sums of every cell of weights and of weights times
    label. Weights are Poisson numbers of mean 1 (with replacement), or 1 for a share ``rate`` of the rows."""
    steps = poisson_cuts() if rate is None else None
    limit = None if rate is None else np.uint64(round(rate * 2.0 ** 32))
    n = len(cells)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.SFC64([seed, trees.start, TaskContext.get().partitionId()]))
        w, s = np.zeros((len(trees), n)), np.zeros((len(trees), n))

        def add(held):
            at = np.searchsorted(cells, np.concatenate([c for c, _ in held]))
            y = np.concatenate([v for _, v in held])
            for i in range(len(trees)):
                draw = rng.integers(0, 1 << 32, len(y), dtype=np.uint32)
                if steps is None:
                    took = np.flatnonzero(draw < limit)
                    w[i] += np.bincount(at[took], minlength=n)
                    s[i] += np.bincount(at[took], y[took], n)
                else:
                    times = np.zeros(len(y), np.uint8)
                    for c in steps:
                        times += draw >= c
                    w[i] += np.bincount(at, times, n)
                    s[i] += np.bincount(at, times * y, n)
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column("cell").to_numpy(), b.column("y").to_numpy()))
            size += b.num_rows
            if size >= max(ROWS, n):
                add(held)
                held, size = [], 0
        if held:
            add(held)
        for i, t in enumerate(trees):
            yield pa.record_batch([pa.array([t], pa.int32()), pa.array([w[i].tobytes()]), pa.array([s[i].tobytes()])],
                                  names=["t", "w", "s"])
    return placed.mapInArrow(run, _SUMS)


def added(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """A tree's sums over all tasks, in an order that does not depend on which came first."""
    parts = lambda c: sum(np.frombuffer(b) for b in sorted(x.as_py() for x in table.column(c)))
    return table.column("t")[0].as_py(), parts("w"), parts("s")


def fit_on_cells(rows: DataFrame, features: list[str], label: str, estimator):
    """The model that ``estimator`` (MLlib's random forest or boosting, squared error) stands for, or
    None: no rows, or more cells than ``CELLS``. A NULL or NaN label is an error, as in MLlib."""
    spark = rows.sparkSession
    x = [F.col(f"`{f}`").cast("double") for f in features]
    y = F.col(f"`{label}`").cast("double")
    ranks = [i / RANKS for i in range(RANKS + 1)]
    n, bad, *values = rows.agg(F.count(F.lit(1)), F.count_if(y.isNull() | F.isnan(y)),
                               *[F.percentile_approx(c, ranks, ACCURACY) for c in x]).first()
    if not n:
        return None
    if bad:
        raise ValueError(f"{bad} training rows have a label that is NULL or NaN")
    get = estimator.getOrDefault
    cuts = [cut_points(v, get("maxBins")) for v in values]
    widths = [len(c) + 1 for c in cuts]
    if math.prod(widths) > CELLS:
        return None

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.zeros(b.num_rows, np.int32)
            for f, (cut, width) in enumerate(zip(cuts, widths)):
                cell = cell * width + np.searchsorted(cut, b.column(f).to_numpy(), "left")
            yield pa.record_batch([pa.array(cell, pa.int32()), b.column("y")], names=["cell", "y"])
    given = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], y.alias("y"))
    tasks = spark.sparkContext.defaultParallelism
    if given.rdd.getNumPartitions() < tasks:  # few files: the passes would run in few tasks
        given = given.repartition(tasks)
    placed = staged(given.mapInArrow(place, "cell int, y double"), "cells")
    cells = np.sort(placed.select("cell").distinct().toArrow()["cell"].to_numpy())
    bins = np.array(np.unravel_index(cells, widths))
    forest = estimator.hasParam("numTrees")
    depth, seed = get("maxDepth"), get("seed")
    strategy = get("featureSubsetStrategy")
    subset = len(features) if strategy == "all" else math.ceil(float(strategy) * len(features))
    count = get("numTrees") if forest else get("maxIter")
    each = max(1, SUMS // len(cells))
    passes = [range(i, min(i + each, count)) for i in range(0, count, each)]
    if forest:
        def tree(table: pa.Table) -> pa.Table:
            t, w, s = added(table)
            return nodes_table(t, grow(bins, cuts, w, s, depth, subset, np.random.default_rng([seed, t]))[0])
        parts = [staged(sampled_sums(placed, cells, p, None, seed).groupBy("t").applyInArrow(tree, _NODES), "trees")
                 for p in passes]
        nodes, weights = parts[0], [1.0] * count
        for p in parts[1:]:
            nodes = nodes.unionByName(p)
    else:
        def total(table: pa.Table) -> pa.Table:
            t, w, s = added(table)
            return pa.table([pa.array([t], pa.int32()), pa.array([w.tobytes()]), pa.array([s.tobytes()])], names=["t", "w", "s"])
        found, guess, weights = [], np.zeros(len(cells)), [1.0] + [get("stepSize")] * (count - 1)
        for p in passes:
            sums = sampled_sums(placed, cells, p, get("subsamplingRate"), seed).groupBy("t").applyInArrow(total, _SUMS)
            for r in sorted(sums.collect(), key=lambda r: r.t):
                w, s = np.frombuffer(r.w), np.frombuffer(r.s)
                # the first tree fits the labels, the others the negative gradient of the squared error
                target = s if r.t == 0 else 2.0 * (s - w * guess)
                columns, value = grow(bins, cuts, w, target, depth, subset, np.random.default_rng([seed, r.t]))
                found.append(nodes_table(r.t, columns))
                guess = guess + weights[r.t] * value
        nodes = spark.createDataFrame(pa.concat_tables(found))
    return as_model(spark, estimator, nodes, weights, len(features))


def as_model(spark, estimator, nodes: DataFrame, weights: list[float], n_features: int):
    """The MLlib model of these trees, by way of the layout in which MLlib saves one."""
    forest = estimator.hasParam("numTrees")
    kind = RandomForestRegressionModel if forest else GBTRegressionModel
    path = scratch_path(spark, "tree-model")
    own = lambda m: {p.name: v for p, v in m.items()}
    head = {"timestamp": 0, "sparkVersion": spark.version, "paramMap": own(estimator._paramMap),
            "defaultParamMap": own(estimator._defaultParamMap)}
    text = {**head, "class": f"org.apache.spark.ml.regression.{kind.__name__}", "uid": estimator.uid,
            "numFeatures": n_features, "numTrees": len(weights)}
    spark.createDataFrame([(json.dumps(text),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    tree = {k: {p: v for p, v in head[k].items() if p in
                ("cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth",
                 "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed")}
            for k in ("paramMap", "defaultParamMap")}
    trees = [(t, json.dumps({**head, **tree, "class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel",
                             "uid": f"{estimator.uid}_{t}"}), w) for t, w in enumerate(weights)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    cut = F.when(F.col("left") >= 0, F.array("cut")).otherwise(F.array().cast("array<double>"))
    data = F.struct(
        "id", "prediction", F.lit(-1.0).alias("impurity"),  # the sums hold no squares: no impurity, no sum of squares
        F.array(F.col("w"), F.col("s"), F.lit(float("nan"))).alias("impurityStats"), F.col("w").cast("long").alias("rawCount"),
        "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"), cut.alias("leftCategoriesOrThreshold"),
                 F.lit(-1).alias("numCategories")).alias("split"))
    nodes.select(F.col("t").alias("treeID"), data.alias("nodeData")).write.parquet(f"{path}/data")
    return kind.load(path)
