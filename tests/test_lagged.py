"""Ridge from lagged cross products against the windows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import models as M
from cadence.operators import rowindex as RI
from cadence.operators import stats as S
from cadence.operators.lagged import fit_window_ridge
from cadence.operators.sequences import window_index


@pytest.mark.parametrize("length, inside", [(5, True), (10, False)])
def test_coefficients_equal_those_of_windows(spark, monkeypatch, length, inside):
    monkeypatch.setattr(RI, "BLOCK", 32)  # several blocks, and groups that end inside them
    rng = np.random.default_rng(4)
    rows = []
    for stream, split, n in (("s", "train", 130), ("t", "train", 11), ("u", "train", 4), ("s", "val", 40)):
        x = rng.normal(size=(n, 2))
        x[rng.random(x.shape) < .1] = np.nan
        rows += [(stream, split, i, *map(float, r), float(100 + np.nansum(r) * 9 + rng.normal())) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "stream string, split string, at long, a double, b double, CycleTime_sec double")
    feats, part = ["a", "b"], ["split", "stream"]
    ix = window_index(df, feats, ["at"], [*part, "at"], part)
    placed = RI.with_place(ix, part)
    scaler = S.fit_row_scaler(placed, feats, length, inside)
    got = fit_window_ridge(placed, feats, length, scaler, target_inside=inside)
    win = RI.sliding_windows(ix, feats, length, target_inside=inside, meta=[*part, "at"], target="CycleTime_sec", same=part)
    want = M.fit_window_regressor(S.apply_window_scaler(win, *scaler).filter(F.col("split") == "train"))
    assert len(got.coef) == 2 * length
    assert np.allclose(got.coef, want.coef, rtol=1e-7, atol=1e-8) and got.intercept == pytest.approx(want.intercept, rel=1e-9)
    with pytest.raises(RuntimeError):
        fit_window_ridge(placed, feats, length, scaler, target_inside=inside, train_value="none")
