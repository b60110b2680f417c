"""R7 for forests and boosting: exact attribution of tree ensembles.

The value of a set S of features on a row is the expected prediction when only those are known: at a
split on an unknown feature both sides count, as often as training rows went there.  A feature's
attribution is its Shapley value in that game.

A leaf with value v, reached by conditions on the features 1..m of its path, contributes
v * prod(o_i for i in S) * prod(z_i for i not in S), where o_i is 1 if the row meets the conditions on
i (else 0) and z_i is the share of training rows that do.  The Shapley sum of such a product is

    phi_j = v * (o_j - z_j) * integral over t in (0, 1) of prod(z_i (1 - t) + o_i t, i != j)

a polynomial in t of degree m - 1, which Gauss-Legendre nodes integrate exactly.  It depends on the row
through the bits o only, so each leaf has a small table of what it adds.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.sources.io import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package

#: Features of a path whose bits are tabulated; longer paths are integrated row by row.
TABLED = 10
#: Attributions that a task keeps.
KEPT = 1 << 17


@dataclass
class Leaf:
    """Value (times the tree's weight), and per feature of the path: its index, the open lower and
    closed upper end of what passes, and the share of training rows that pass."""
    value: float
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves_of(nodes: dict[int, tuple], weight: float) -> Iterator[Leaf]:
    """The leaves of a tree of nodes id -> (left, right, feature, threshold, value, rows)."""
    open_ = [(0, {})]
    while open_:
        at, path = open_.pop()
        left, right, feature, cut, value, rows = nodes[at]
        if left < 0:
            keys = sorted(path)
            ends = np.array([path[k] for k in keys], float).reshape(-1, 3)
            yield Leaf(value * weight, np.array(keys, int), ends[:, 0], ends[:, 1], ends[:, 2])
            continue
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, ends in ((left, (low, min(high, cut))), (right, (max(low, cut), high))):
            open_.append((child, {**path, feature: (*ends, share * nodes[child][5] / rows)}))


def shapley(leaf: Leaf, met: np.ndarray) -> np.ndarray:
    """(rows, features of the path): what the leaf adds, for rows of bits ``met``."""
    m = len(leaf.feature)
    t, w = np.polynomial.legendre.leggauss(m // 2 + 1)
    t, w = (t + 1) / 2, w / 2
    out = np.zeros(met.shape)
    for tq, wq in zip(t, w):
        factor = leaf.share * (1 - tq) + met * tq  # never 0: shares are positive, nodes inside (0, 1)
        out += wq * factor.prod(axis=1, keepdims=True) / factor
    return leaf.value * (met - leaf.share) * out


class Remembered:
    """Rows that lie between the same ends of conditions (``ends``: per feature) have the same result,
    which is worked out once and kept, ``KEPT`` of them at most."""

    def __init__(self, ends: dict[int, np.ndarray]):
        self.ends, self.known, self.found = ends, np.zeros(0, np.int64), None

    def work_out(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def look_up(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or math.prod(len(e) + 1 for e in self.ends.values()) >= 1 << 62 or np.isnan(x).any():
            return self.work_out(x)
        code = np.zeros(len(x), np.int64)
        for f, e in self.ends.items():
            code = code * (len(e) + 1) + np.searchsorted(e, x[:, f], "left")
        codes, row, back = np.unique(code, return_index=True, return_inverse=True)
        new = ~np.isin(codes, self.known, assume_unique=True)
        if self.found is None or len(self.known) + new.sum() > KEPT:
            self.known, self.found, new = codes, self.work_out(x[row]), np.zeros(len(codes), bool)
        if new.any():
            known = np.concatenate([self.known, codes[new]])
            order = np.argsort(known)
            self.known, self.found = known[order], np.concatenate([self.found, self.work_out(x[row[new]])])[order]
        return self.found[np.searchsorted(self.known, codes)][back]


class Ensemble(Remembered):
    """The leaves of a fitted forest or boosted ensemble, as plain numbers."""

    def __init__(self, leaves: list[Leaf]):
        self.leaves = leaves
        self.base = float(sum(x.value * x.share.prod() for x in leaves))
        self.tables = []
        for x in leaves:
            m = len(x.feature)
            bits = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1 if m <= TABLED else None
            self.tables.append(None if bits is None else shapley(x, bits.astype(float)))

        ends = {}
        for x in leaves:
            for f, lo, hi in zip(x.feature, x.low, x.high):
                ends.setdefault(int(f), set()).update(e for e in (lo, hi) if np.isfinite(e))
        super().__init__({f: np.array(sorted(e)) for f, e in sorted(ends.items())})

    def attribute(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) attributions."""
        return self.look_up(x)

    def work_out(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for leaf, table in zip(self.leaves, self.tables):
            if not len(leaf.feature):
                continue
            part = x[:, leaf.feature]
            met = (part > leaf.low) & (part <= leaf.high)
            if table is None:
                out[:, leaf.feature] += shapley(leaf, met.astype(float))
            else:
                out[:, leaf.feature] += table[met @ (1 << np.arange(len(leaf.feature)))]
        return out


class Scorer(Remembered):
    """Predictions of an ensemble of trees of nodes id -> (left, right, feature, threshold, value, rows)."""

    def __init__(self, trees: list[tuple[float, dict[int, tuple]]]):
        self.trees = [(w, [np.array(c) for c in zip(*[nodes[i][:5] for i in range(len(nodes))])]) for w, nodes in trees]
        ends: dict[int, set] = {}
        for _, (left, _, feature, cut, _) in self.trees:
            for f in np.unique(feature[left >= 0]):
                ends.setdefault(int(f), set()).update(cut[(left >= 0) & (feature == f)].astype(float))
        super().__init__({f: np.array(sorted(e)) for f, e in sorted(ends.items())})

    def work_out(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for weight, (left, right, feature, cut, value) in self.trees:
            at = np.zeros(len(x), int)
            while (inner := left[at] >= 0).any():
                goes = np.where(x[rows, feature[at]] <= cut[at].astype(float), left[at], right[at])
                at = np.where(inner, goes, at)
            out += weight * value[at]
        return out


def read_trees(spark, model) -> list[tuple[float, dict[int, tuple]]]:
    """Weight and nodes of every tree of a fitted MLlib tree model (regression, continuous features),
    from the node table that it saves: its size is the model's, whatever the data."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        data = data.select("treeID", "nodeData.*")
        weights = dict(enumerate(model.treeWeights))
        # a forest averages its trees, boosting adds them up
        scale = 1.0 / len(weights) if "Forest" in type(model).__name__ else 1.0
    else:
        data, weights, scale = data.withColumn("treeID", F.lit(0)), {0: 1.0}, 1.0
    trees: dict[int, dict[int, tuple]] = {}
    cut = F.coalesce(F.get("split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("cut")
    for r in data.select("treeID", "id", "leftChild", "rightChild", "split.featureIndex", cut, "prediction",
                         "rawCount").collect():
        trees.setdefault(r.treeID, {})[r.id] = tuple(r)[2:]
    return [(weights[i] * scale, nodes) for i, nodes in sorted(trees.items())]


def read_ensemble(spark, model) -> Ensemble:
    """The leaves of a fitted MLlib tree model."""
    return Ensemble([x for weight, nodes in read_trees(spark, model) for x in leaves_of(nodes, weight)])


def tree_scores(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``pred`` of a pipeline that ends in trees: the trees are walked once for all rows of
    a task that lie between the same cuts."""
    scorer = Scorer(read_trees(df.sparkSession, model.stages[-1]))
    ready = df
    for stage in model.stages[:-1]:
        ready = stage.transform(ready)
    ready = ready.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{k}`") for k in keep]).alias("row"),
                         vector_to_array("features").alias("x"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.record_batch([b.column("row"), pa.array(scorer.look_up(x))], names=["row", "pred"])
    kind = ready.schema["row"].dataType.simpleString()
    return ready.mapInArrow(run, f"row {kind}, pred double").select("row.*", "pred").drop("_")


def tree_attribution_rows(rows: DataFrame, model: PipelineModel, features: list[str],
                          keep: list[str]) -> DataFrame:
    """(keep, feature, value, phi, base, pred): the attribution of every feature on every row, exact;
    base plus the row's phi is its prediction.  ``value`` is the feature as the model's last stage sees
    it (imputed and scaled).  Narrow: the leaves travel with the tasks."""
    spark = rows.sparkSession
    ensemble = read_ensemble(spark, model.stages[-1])
    ready = rows
    for stage in model.stages:
        ready = stage.transform(ready)
    ready = ready.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{k}`") for k in keep]).alias("row"),
                         vector_to_array("features").alias("x"), F.col("pred"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            phi = ensemble.attribute(x)
            ends = pa.array(np.arange(b.num_rows + 1) * x.shape[1], pa.int32())
            yield pa.record_batch([b.column("row"), b.column("x"), pa.ListArray.from_arrays(ends, pa.array(phi.ravel())),
                                   b.column("pred")], names=["row", "x", "phi", "pred"])
    kind = ready.schema["row"].dataType.simpleString()
    found = ready.mapInArrow(run, f"row {kind}, x array<double>, phi array<double>, pred double")
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("x", F.lit(j)).alias("value"),
                               F.get("phi", F.lit(j)).alias("phi")) for j, f in enumerate(features)])
    return (found.select("row", "pred", F.inline(parts))
            .select("row.*", "feature", "value", "phi", F.lit(ensemble.base).alias("base"), "pred").drop("_"))


def tree_attribution(rows: DataFrame, model: PipelineModel, features: list[str]) -> DataFrame:
    """R7 for a tree pipeline: (feature, mean_abs_shap) over all rows."""
    long = tree_attribution_rows(rows, model, features, keep=[])
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
