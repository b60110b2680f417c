"""R12 without windows: ridge on flattened L x F windows from lagged cross products of rows.

The Gram matrix of the windows has L * L parts of F x F: part (t, t + d) sums x_j x_{j+d}' over the
rows j that are timestep t of some window. Away from the ends of a group that is every row, so the
parts of one lag d share one sum; only the rows near an end, fewer than 2 L a group, make the
difference. So L products of rows give what L * L products of windows would, and no window is built:
each row moves once, a task sums its blocks, and L * L arrays a task are added up.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.models import RIDGE_ALPHA, WindowLinear
from cadence.operators.rowindex import RN, _blocks
from cadence.operators.stats import STD_FLOOR, finite_or_null
from cadence.roles import SPLIT, TARGET

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package


class Moments:
    """Sums over all windows of some blocks of rows: ``gram`` (L, L, F, F; upper parts), ``cross`` with
    the target (L, F), ``total`` of the cells (L, F), and of windows and targets."""

    def __init__(self, length: int, n: int, last: int):
        self.length, self.last = length, last
        self.gram = np.zeros((length, length, n, n))
        self.cross, self.total = np.zeros((length, n)), np.zeros((length, n))
        self.windows = self.target = 0.0

    def add(self, own: np.ndarray, place: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """A block: rows in order; its own ones come first, then those behind it."""
        length, k = self.length, int(own.sum())
        place, room = place[:k], size[:k] - length - self.last  # the last place where a window begins
        valid = [np.flatnonzero((place >= t) & (place - t <= room)) for t in range(length)]
        for d in range(length):
            every = (place >= length - 1 - d) & (place <= room)  # timestep t of a window for each t
            at = np.flatnonzero(every)
            shared = x[at].T @ x[at + d]
            for t in range(length - d):
                edge = valid[t][~every[valid[t]]]
                self.gram[t, t + d] += shared + x[edge].T @ x[edge + d]
        for t, at in enumerate(valid):
            self.cross[t] += y[at + length - 1 - t + self.last] @ x[at]
            self.total[t] += x[at].sum(axis=0)
        self.windows += len(valid[0])
        self.target += y[valid[0] + length - 1 + self.last].sum()

    def rows(self) -> list[tuple[int, np.ndarray]]:
        parts = [(t * self.length + s, self.gram[t, s]) for t in range(self.length) for s in range(t, self.length)]
        ends = [self.cross, self.total, np.array([self.windows, self.target])]
        return parts + [(self.length ** 2 + i, a) for i, a in enumerate(ends)]


SUMS = "key int, v array<double>"


def _sums(length: int, n: int, last: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, block, held = Moments(length, n, last), None, []

        def done() -> None:
            if held:
                cols = [np.concatenate(c) for c in zip(*held)]
                moments.add(*cols)
                held.clear()
        for b in batches:
            blk = np.asarray(b.column("_blk"))
            for part in np.split(np.arange(len(blk)), np.flatnonzero(np.diff(blk)) + 1):
                if not len(part):
                    continue
                if blk[part[0]] != block:
                    done()
                    block = blk[part[0]]
                rows = b.slice(part[0], len(part))
                x = rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), n)
                held.append((~rows.column("_end").to_numpy(zero_copy_only=False), np.asarray(rows.column("_place")),
                             np.asarray(rows.column("_size")), x, np.asarray(rows.column("y"))))
        done()
        yield _told(moments.rows())
    return run


def _told(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k for k, _ in rows], pa.int32()),
                            pa.array([np.ravel(v) for _, v in rows], pa.list_(pa.float64()))], names=["key", "v"])


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of one key, which follow each other, added up."""
    key, total = None, None
    for b in batches:
        for k, v in zip(b.column("key").to_pylist(), b.column("v")):
            v = v.values.to_numpy(zero_copy_only=False)
            if k != key:
                if total is not None:
                    yield _told([(key, total)])
                key, total = k, np.zeros(len(v))
            total += v
    if total is not None:
        yield _told([(key, total)])


def fit_window_ridge(placed: DataFrame, features: list[str], length: int, scaler: tuple[DataFrame, DataFrame], *,
                     target_inside: bool = True, target: str = TARGET, alpha: float = RIDGE_ALPHA,
                     split: str | None = SPLIT, train_value: str = "train") -> WindowLinear:
    """The ridge that ``fit_window_regressor`` fits on the train windows, imputed and scaled with
    ``scaler`` (one-row frames), from the rows of ``rowindex.with_place``. The windows must not cross
    ``split``. The driver gets the L F x L F matrix."""
    last = 0 if target_inside else 1
    src = placed.filter(F.col(split) == train_value) if split else placed
    means, scale = scaler
    src = src.crossJoin(F.broadcast(means.select(F.col("_mu").alias("_fill")).crossJoin(scale)))  # one row
    cell = lambda j, c: ((F.coalesce(finite_or_null(F.col(f"`{c}`").cast("double")), F.col("_fill")[j], F.lit(0.0))
                          - F.col("_mu")[j]) / F.greatest(F.coalesce(F.col("_sd")[j], F.lit(0.0)), F.lit(STD_FLOOR)))
    rows = src.select(RN, "_place", "_size", F.array(*[cell(j, c) for j, c in enumerate(features)]).alias("x"),
                      F.col(target).cast("double").alias("y"))
    rows, _ = _blocks(rows, 0, length - 1 + last, RN)
    sums = rows.repartition("_blk").sortWithinPartitions("_blk", RN).mapInArrow(_sums(length, len(features), last), SUMS)
    told = {r.key: np.array(r.v) for r in
            sums.repartition("key").sortWithinPartitions("key").mapInArrow(_added, SUMS).collect()}
    n = len(features)
    windows, total_y = told.get(length ** 2 + 2, (0, 0))
    if not windows:
        raise RuntimeError("fit_window_ridge: no training windows")
    gram = np.zeros((length, length, n, n))
    for t in range(length):
        for s in range(t, length):
            gram[t, s] = told[t * length + s].reshape(n, n)
            gram[s, t] = gram[t, s].T
    gram = gram.transpose(0, 2, 1, 3).reshape(length * n, length * n)
    mean, mean_y = told[length ** 2 + 1] / windows, total_y / windows
    centred = gram - windows * np.outer(mean, mean) + alpha * np.eye(length * n)
    coef = np.linalg.solve(centred, told[length ** 2] - windows * mean * mean_y)
    return WindowLinear(coef.tolist(), float(mean_y - mean @ coef))
