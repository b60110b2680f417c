"""Queries for models, metrics and attribution.

Ridge on two features is restated in DuckDB by Cramer's rule, ridge and logistic
regression on windows of five steps by elimination and Newton's steps.  Forests
and boosting are checked by bounds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.operators import attribution as AT
from cadence.operators import models as M
from cadence.operators import stats as S
from cadence.operators.rowindex import sliding_windows, with_place
from cadence.operators.sequences import window_index, windows
from cadence.plans.oracle import EVENTS_CT, REG_LINES, REG_SIGNAL, logit_newton, ts_text, wide_ridge, with_ctes
from cadence.plans.q_cycles import events_features
from cadence.plans.registry import query
from cadence.plans.registry import ts_text as sts
from cadence.plans.views import EVENTS_ROLES, reg_lines, reg_signal
from cadence.roles import ColumnRoles

ZF = ["l_quantity", "l_discount"]
FEATS = ["l_quantity", "l_discount", "tax_ratio"]
#: Depth of the forest of R2: the reference sets none, and MLlib grows 30 at most.
FOREST_DEPTH = 5


def ridge_ctes(src: str, alpha: float = 1.0, n: str = "") -> str:
    """Ridge on two features z1, z2 of ``src`` (split, y, z1, z2, ...), fitted on train by Cramer's
    rule: ``b`` holds b0, w1, w2 and the train means a1, a2; ``p`` the rows with ``pred``."""
    return f"""
m{n} AS (SELECT avg(z1) AS a1, avg(z2) AS a2, avg(y) AS ay FROM {src} WHERE split = 'train'),
c{n} AS (SELECT sum((z1 - a1) * (z1 - a1)) + {alpha} AS s11, sum((z2 - a2) * (z2 - a2)) + {alpha} AS s22,
             sum((z1 - a1) * (z2 - a2)) AS s12, sum((z1 - a1) * (y - ay)) AS s1y, sum((z2 - a2) * (y - ay)) AS s2y
      FROM {src} CROSS JOIN m{n} WHERE split = 'train'),
w{n} AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2 FROM c{n}),
b{n} AS (SELECT ay - w1 * a1 - w2 * a2 AS b0, w1, w2, a1, a2 FROM w{n} CROSS JOIN m{n}),
p{n} AS (SELECT {src}.*, b0 + w1 * z1 + w2 * z2 AS pred, w1, w2, a1, a2 FROM {src} CROSS JOIN b{n})"""


_Z = """
st AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md,
              stddev_pop(l_discount) AS sd FROM rl WHERE split = 'train'),
z AS (SELECT row_key, split, y, (l_quantity - mq) / sq AS z1, (l_discount - md) / sd AS z2 FROM rl CROSS JOIN st)"""
_RIDGE_SQL = with_ctes(REG_LINES, _Z, ridge_ctes("z"))
_METRICS = ("avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) * (y - pred))) AS rmse, "
            "1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) AS r2")
_MD = ("mae", "rmse", "r2")


def standardized(spark, sf_dir):
    """Standardised regression rows, written once to the shared checkpoint
    folder: the fit, the scoring and the attribution passes read these few
    columns instead of re-scanning and re-splitting lineitem."""
    from cadence.session import ensure_checkpoint_dir
    r = reg_lines(spark, sf_dir)
    z = S.standardize(r, ZF, S.train_stats(r, ZF, median=False)).select("row_key", "split", "y", *ZF)
    ensure_checkpoint_dir(spark)
    return z.checkpoint(eager=True)


def ridge(spark, sf_dir):
    z = standardized(spark, sf_dir)
    return z, M.ridge_fit(z.filter(F.col("split") == "train"), ZF, "y")


@query("R1_ridge_coefficients", _RIDGE_SQL + "SELECT 'l_quantity' AS feature, w1 AS coef FROM b UNION ALL "
       "SELECT 'l_discount', w2 FROM b UNION ALL SELECT '(intercept)', b0 FROM b", doubles=("coef",))
def r1_ridge_coefficients(spark, sf_dir):
    _, model = ridge(spark, sf_dir)
    return model.table(spark)


@query("R5_ridge_metrics", _RIDGE_SQL + f"SELECT 'Ridge' AS model, split, {_METRICS} "
       "FROM p WHERE split IN ('val', 'test') GROUP BY split", doubles=("mae", "rmse", "r2"))
def r5_ridge_metrics(spark, sf_dir):
    z, model = ridge(spark, sf_dir)
    scored = z.filter(F.col("split").isin("val", "test")).select(
        F.lit("Ridge").alias("model"), "split", "y", model.predict(name="pred"))
    return M.regression_metrics(scored, "y", "pred", ["model", "split"])


_PHI = ("SELECT 'l_quantity' AS feature, row_key, z1 AS value, w1 * (z1 - a1) AS phi FROM p WHERE split = 'test' "
        "UNION ALL SELECT 'l_discount', row_key, z2, w2 * (z2 - a2) FROM p WHERE split = 'test'")


def _attr(spark, sf_dir):
    z, model = ridge(spark, sf_dir)
    return (z.filter(F.col("split") == "test"), z.filter(F.col("split") == "train"), model)


@query("R7_linear_attribution", _RIDGE_SQL + f"SELECT feature, avg(abs(phi)) AS mean_abs_shap FROM ({_PHI}) "
       "GROUP BY feature", doubles=("mean_abs_shap",))
def r7_linear_attribution(spark, sf_dir):
    rows, bg, model = _attr(spark, sf_dir)
    return AT.linear_attribution(rows, model, bg)


@query("O3_top_features", _RIDGE_SQL + f"SELECT feature, avg(abs(phi)) AS mean_abs_shap FROM ({_PHI}) "
       "GROUP BY feature ORDER BY mean_abs_shap DESC, feature LIMIT 1", doubles=("mean_abs_shap",))
def o3_top_features(spark, sf_dir):
    rows, bg, model = _attr(spark, sf_dir)
    return AT.top_features(AT.linear_attribution(rows, model, bg), k=1)


@query("R9_attribution_rows", _RIDGE_SQL + _PHI, doubles=("value", "phi"))
def r9_attribution_rows(spark, sf_dir):
    rows, bg, model = _attr(spark, sf_dir)
    return AT.linear_attribution_rows(rows, model, bg, keep=["row_key"])


THREE = ["l_quantity", "l_discount", "l_tax"]
_THREE_SQL = with_ctes(REG_SIGNAL, "st AS (SELECT " + ", ".join(
    f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(THREE)) + " FROM rl WHERE split = 'train'),",
    "z AS (SELECT row_key, split, y, " + ", ".join(f"({f} - m{i}) / s{i} AS z{i + 1}" for i, f in enumerate(THREE))
    + " FROM rl CROSS JOIN st)", wide_ridge("z", ["z1", "z2", "z3"]),
    "long AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, row_key, z{i} AS value, w{i} * (z{i} - a{i}) AS phi FROM p WHERE split = 'test'"
        for i, f in enumerate(THREE, 1)) + ")",
    "top AS (SELECT feature FROM long GROUP BY feature ORDER BY avg(abs(phi)) DESC, feature LIMIT 2)")


@query("R9_dependence_pairs", _THREE_SQL + "SELECT feature, row_key, value, phi FROM long JOIN top USING (feature)",
       doubles=("value", "phi"))
def r9_dependence_pairs(spark, sf_dir):
    """(value, attribution) of the two features that matter most, for every test row."""
    r = reg_signal(spark, sf_dir)
    z = S.standardize(r, THREE, S.train_stats(r, THREE, median=False)).select("row_key", "split", "y", *THREE)
    z = z.checkpoint(eager=True)
    train, test = (z.filter(F.col("split") == s) for s in ("train", "test"))
    model = M.ridge_fit(train, THREE, "y")
    rows = AT.linear_attribution_rows(test, model, train, keep=["row_key"])
    return AT.dependence_pairs(rows, AT.linear_attribution(test, model, train), top=2)


def _shuffled_sql(repeats: int, seed: int = 42) -> str:
    """``copies``: every test row once for each feature and repeat, with pz1, pz2, the values of z1
    and z2 after that feature was shuffled. The bijection is restated round by round."""
    plans = []
    for j, f in enumerate(ZF):
        for r in range(repeats):
            key = AT._hash(seed, j * 1009 + r)
            sums = [AT._hash(i, key) * AT.PRIME + AT._hash(i + AT.ROUNDS, key) for i in range(AT.ROUNDS)]
            keys = [AT._hash(i + 2 * AT.ROUNDS, key) for i in range(AT.ROUNDS)]
            plans.append(f"('{f}', {r}, {sums}, {keys})")
    q = "SELECT *, pn AS x FROM pos CROSS JOIN plan"
    for r in range(1, AT.ROUNDS + 1):
        q = f"SELECT *, (sums[{r}] % n + n - x) % n AS q FROM ({q})"
        q = f"SELECT *, (greatest(x, q) % {AT.PRIME} * 48271 + keys[{r}]) % {AT.PRIME} AS u FROM ({q})"
        q = (f"SELECT * EXCLUDE (x, q, u), CASE WHEN (u * u % {AT.PRIME} * 69621 + u) % {AT.PRIME} // 4096 % 2 = 1 "
             f"THEN q ELSE x END AS x FROM ({q})")
    return f""",
pos AS (SELECT *, row_number() OVER (ORDER BY row_key) - 1 AS pn, count(*) OVER () AS n FROM z WHERE split = 'test'),
plan AS (SELECT * FROM (VALUES {", ".join(plans)}) AS t(feature, repeat, sums, keys)),
moved AS ({q}),
copies AS (SELECT feature, repeat, moved.y, CASE WHEN feature = '{ZF[0]}' THEN d.z1 ELSE moved.z1 END AS pz1,
                  CASE WHEN feature = '{ZF[1]}' THEN d.z2 ELSE moved.z2 END AS pz2
           FROM moved JOIN (SELECT pn, z1, z2 FROM pos) d ON d.pn = moved.x),
scored AS (SELECT feature, repeat, y, b0 + w1 * pz1 + w2 * pz2 AS pred FROM copies CROSS JOIN b),
per AS (SELECT feature, repeat, avg(abs(y - pred)) AS mae, 1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) AS r2
        FROM scored GROUP BY feature, repeat),
base AS (SELECT avg(abs(y - pred)) AS bmae, 1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) AS br2
         FROM p WHERE split = 'test')
"""


_RISE = "SELECT feature, avg(mae - bmae) AS importance FROM per CROSS JOIN base GROUP BY feature"


@query("R8_permutation_importance", _RIDGE_SQL + _shuffled_sql(1) + _RISE, doubles=("importance",))
def r8_permutation_importance(spark, sf_dir):
    rows, _, model = _attr(spark, sf_dir)
    return AT.permutation_importance(rows, model, "row_key", "y", repeats=1).drop("spread")


@query("R8_permutation_r2", _RIDGE_SQL + _shuffled_sql(10) +
       "SELECT feature, avg(br2 - r2) AS importance, stddev_pop(br2 - r2) AS spread FROM per CROSS JOIN base "
       "GROUP BY feature", doubles=("importance", "spread"))
def r8_permutation_r2(spark, sf_dir):
    """Fall of R2, ten repeats."""
    rows, _, model = _attr(spark, sf_dir)
    return AT.permutation_importance(rows, model, "row_key", "y", repeats=10, metric="r2")


@query("R8_pipeline_importance", _RIDGE_SQL + _shuffled_sql(1) + _RISE, doubles=("importance",))
def r8_pipeline_importance(spark, sf_dir):
    """Any fitted pipeline is scored on the raw features; a ridge pipeline, so that SQL can follow."""
    r = M.staged(reg_lines(spark, sf_dir).select("row_key", "split", "y", *ZF), "lines")
    model = M.fit_pipeline(r.filter(F.col("split") == "train"), ZF, "y", "Ridge")
    return AT.permutation_importance(r.filter(F.col("split") == "test"), model, "row_key", "y",
                                     features=ZF).drop("spread")


# --- R4, R6, O7, R11: a pipeline, and the choice between models ------------------------

@query("R4_pipeline_ridge", _RIDGE_SQL + f"SELECT 'Ridge' AS model, split, {_METRICS} FROM p "
       "WHERE split IN ('val', 'test') GROUP BY split", doubles=_MD)
def r4_pipeline_ridge(spark, sf_dir):
    """Impute -> scale -> assemble -> ridge as one MLlib Pipeline, fitted on train."""
    r = reg_lines(spark, sf_dir)
    model = M.fit_pipeline(r.filter(F.col("split") == "train"), ZF, "y", "Ridge")
    scored = M.score(model, r.filter(F.col("split").isin("val", "test")), ["split", "y"])
    return M.regression_metrics(scored.withColumn("model", F.lit("Ridge")), "y", "pred", ["model", "split"])


STIFF = 100_000.0
_MODELS_SQL = with_ctes(REG_LINES, _Z, ridge_ctes("z"), ridge_ctes("z", STIFF, "2"), """
k AS (SELECT avg(y) AS mean_y FROM z WHERE split = 'train'),
all_p AS (SELECT 'Ridge' AS model, row_key, split, y, pred FROM p
          UNION ALL SELECT 'RidgeStiff', row_key, split, y, pred FROM p2
          UNION ALL SELECT 'Mean', row_key, split, y, mean_y FROM z CROSS JOIN k)""", f"""
mt AS (SELECT model, split, {_METRICS} FROM all_p WHERE split IN ('val', 'test') GROUP BY model, split),
best AS (SELECT arg_min(model, (rmse, model)) AS model FROM mt WHERE split = 'val')""")


def competing(spark, sf_dir):
    """Predictions of three models on the standardised rows: two ridge strengths, the train mean."""
    z = standardized(spark, sf_dir)
    train = z.filter(F.col("split") == "train")
    preds = {"Ridge": M.ridge_fit(train, ZF, "y").predict("pred"),
             "RidgeStiff": M.ridge_fit(train, ZF, "y", alpha=STIFF).predict("pred")}
    keep = ["row_key", "split", "y"]
    parts = [z.select(F.lit(n).alias("model"), *keep, c) for n, c in preds.items()]
    mean = train.agg(F.avg("y").alias("pred"))
    parts.append(z.crossJoin(F.broadcast(mean)).select(F.lit("Mean").alias("model"), *keep, "pred"))
    return S.union_all(parts)


def competing_metrics(spark, sf_dir):
    scored = competing(spark, sf_dir)
    return scored, M.regression_metrics(scored.filter(F.col("split").isin("val", "test")), "y", "pred",
                                        ["model", "split"])


@query("R6_best_model", _MODELS_SQL + "SELECT model, split, mae, rmse FROM mt JOIN best USING (model) "
       "WHERE split = 'test'", doubles=("mae", "rmse"))
def r6_best_model(spark, sf_dir):
    """R2 is left out: that of the train mean is zero but for noise in the last digits."""
    return M.best_model(competing_metrics(spark, sf_dir)[1]).drop("r2")


@query("O7_rank_models", _MODELS_SQL + "SELECT model, split, mae, rmse FROM mt WHERE split = 'val'",
       doubles=("mae", "rmse"))
def o7_rank_models(spark, sf_dir):
    return M.rank_models(competing_metrics(spark, sf_dir)[1].filter(F.col("split") == "val")).drop("r2")


@query("R11_batch_scoring", _MODELS_SQL + "SELECT row_key, pred, model FROM all_p JOIN best USING (model) "
       "WHERE split = 'test'", doubles=("pred",))
def r11_batch_scoring(spark, sf_dir):
    """The test rows scored by the model that is best on val."""
    scored, metrics = competing_metrics(spark, sf_dir)
    best = F.broadcast(M.best_model(metrics).select("model"))  # one row
    return scored.filter(F.col("split") == "test").join(best, "model").select("row_key", "pred", "model")


@query("R11_saved_pipeline", _RIDGE_SQL + "SELECT row_key, pred FROM p WHERE split = 'test'", doubles=("pred",))
def r11_saved_pipeline(spark, sf_dir):
    """Train, save, load, score: the loaded pipeline scores test rows read from a written table."""
    from cadence.plans.entrypoints import load_pipeline, save_pipeline, score_batch
    from cadence.sources import io
    r = reg_lines(spark, sf_dir)
    model = M.fit_pipeline(r.filter(F.col("split") == "train"), ZF, "y", "Ridge")
    path = save_pipeline(model, io.scratch_path(spark, "pipeline"))
    rows = io.write_csv(r.filter(F.col("split") == "test").select("row_key", *ZF, "y"),
                        io.scratch_path(spark, "score_csv"))
    given = io.read_scoring_input(spark, rows, "row_key string, l_quantity double, l_discount double, Y double")
    return score_batch(given, load_pipeline(path), keep=["row_key"], drop=["y"])


# --- MLlib ensembles: no SQL equal; a table of checks that must hold ---------------------

def ensemble_check(spark, sf_dir, kind, **settings):
    """Per split, on rows whose label the features explain (``reg_signal``; the model that knows the
    rule leaves under a hundredth of the variance): rows, whether the fitted model leaves less than a
    tenth of the squares around the train mean, whether all predictions lie within the train labels
    (they must, for averages of them)."""
    r = M.staged(reg_signal(spark, sf_dir), "signal")
    train = r.filter(F.col("split") == "train")
    model = M.fit_pipeline(train, FEATS, "y", kind, **settings)
    ends = F.broadcast(train.agg(F.avg("y").alias("mean_y"), F.min("y").alias("lo"), F.max("y").alias("hi")))
    scored = M.score(model, r.filter(F.col("split").isin("val", "test")), ["split", "y"]).crossJoin(ends)
    err = lambda p: F.sum((F.col("y") - F.col(p)) * (F.col("y") - F.col(p)))
    return scored.groupBy("split").agg(
        F.lit(kind).alias("model"), F.count(F.lit(1)).alias("rows"),
        (err("pred") < 0.1 * err("mean_y")).alias("explains"),
        F.min((F.col("pred") >= F.col("lo")) & (F.col("pred") <= F.col("hi"))).alias("within"))


def _check_sql(kind: str, within: bool) -> str:
    return with_ctes(REG_SIGNAL) + (f"SELECT split, '{kind}' AS model, count(*) AS rows, true AS explains"
                                    + (", true AS within" if within else "")
                                    + " FROM rl WHERE split IN ('val', 'test') GROUP BY split")


@query("R2_random_forest", _check_sql("RF", True))
def r2_random_forest(spark, sf_dir):
    """A bound check, not an equality: 400 trees; depth as in FOREST_DEPTH."""
    return ensemble_check(spark, sf_dir, "RF", rf_depth=FOREST_DEPTH)


@query("R3_boosted_trees", _check_sql("GBT", False))
def r3_boosted_trees(spark, sf_dir):
    """A bound check, not an equality: 800 rounds (sums of trees may leave the label range)."""
    return ensemble_check(spark, sf_dir, "GBT").drop("within")


FOUR = ["l_quantity", "l_discount", "l_tax", "tax_ratio"]
_FOUR_SQL = with_ctes(
    REG_SIGNAL, "md AS (SELECT quantile_cont(tax_ratio, 0.5) AS fill FROM rl WHERE split = 'train'),",
    "im AS (SELECT rl.* REPLACE (coalesce(tax_ratio, fill) AS tax_ratio) FROM rl CROSS JOIN md),",
    "st AS (SELECT " + ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(FOUR))
    + " FROM im WHERE split = 'train'),",
    "z AS (SELECT row_key, split, y, " + ", ".join(f"({f} - m{i}) / s{i} AS z{i + 1}" for i, f in enumerate(FOUR))
    + " FROM im CROSS JOIN st)", wide_ridge("z", [f"z{i}" for i in range(1, 5)]))


@query("R6_model_contest", _FOUR_SQL + f"""
, mt AS (SELECT split, count(*) AS rows, {_METRICS} FROM p WHERE split IN ('val', 'test') GROUP BY split)
SELECT split, rows, place, place = 3 AS is_ridge, CASE WHEN place = 3 THEN rmse END AS ridge_rmse, place < 3 AS tree_wins
FROM mt CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS place)""", doubles=("ridge_rmse",))
def r6_model_contest(spark, sf_dir):
    """Ridge, forest and boosting fitted, ranked (O7) by RMSE on val, the best one saved, loaded and
    scoring (R11). On this label trees must beat ridge; ridge's own error is exact."""
    from cadence.plans.entrypoints import baselines, load_pipeline, save_pipeline, score_batch
    from cadence.sources import io
    r = reg_signal(spark, sf_dir).checkpoint(eager=True)
    roles = ColumnRoles(stream=None, cycle=None, time="row_key", label=None, target="y")
    run = baselines(r, roles, rf_depth=FOREST_DEPTH)
    metrics = run.metrics.checkpoint(eager=True)
    order = [m.model for m in M.rank_models(metrics.filter(F.col("split") == "val")).collect()]  # a row a model
    place = F.coalesce(*[F.when(F.col("model") == m, F.lit(i)) for i, m in enumerate(order, 1)])
    best = load_pipeline(save_pipeline(run.models[run.best], io.scratch_path(spark, "best")))
    again = score_batch(r.filter(F.col("split").isin("val", "test")), best, keep=["split", "y"])
    again = M.regression_metrics(again, "y", "pred", ["split"]).select("split", F.col("rmse").alias("_again"))
    ridge = metrics.filter(F.col("model") == "Ridge").select("split", F.col("rmse").alias("_ridge"))
    rows = r.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    wins = ((F.col("rmse") < F.col("_ridge")) & (F.lit(order[0] == run.best))
            & ((F.col("model") != run.best) | (F.abs(F.col("_again") - F.col("rmse")) < 1e-9 * F.col("rmse"))))
    return (metrics.join(ridge, "split").join(again, "split").join(rows, "split")
            .select("split", "rows", place.alias("place"), (F.col("model") == "Ridge").alias("is_ridge"),
                    F.when(F.col("model") == "Ridge", F.col("rmse")).alias("ridge_rmse"), wins.alias("tree_wins")))


@query("R7_tree_attribution", with_ctes(REG_SIGNAL) + "SELECT model, row_key, true AS adds_up FROM rl "
       "CROSS JOIN (SELECT unnest(['RF', 'GBT']) AS model) WHERE split = 'test'")
def r7_tree_attribution(spark, sf_dir):
    """Exact attribution of a forest and of boosting on every test row: base and attributions add up
    to the prediction."""
    from cadence.operators.trees import tree_attribution_rows
    r = M.staged(reg_signal(spark, sf_dir), "signal")
    parts = []
    for kind, settings in (("RF", {"rf_depth": FOREST_DEPTH, "rf_trees": 100}), ("GBT", {"gbt_rounds": 20})):
        model = M.fit_pipeline(r.filter(F.col("split") == "train"), FEATS, "y", kind, **settings)
        rows = tree_attribution_rows(r.filter(F.col("split") == "test"), model, FEATS, ["row_key"])
        total = F.first("base") + F.sum("phi")
        parts.append(rows.groupBy("row_key").agg(
            (F.abs(total - F.first("pred")) < 1e-6 * (F.abs(F.first("pred")) + 1)).alias("adds_up"))
            .select(F.lit(kind).alias("model"), "row_key", "adds_up"))
    return S.union_all(parts)


# --- R10, R12-R15: the sequence path in closed form, windows of five steps ----------------

SEQ_L = 5
_SEQ_KEYS = ["A", "B", "C", "split"]
_STEPS = range(1, SEQ_L + 1)
_ZS = [f"z{t}" for t in _STEPS]
_SEQ_SQL = with_ctes(EVENTS_CT, f"""
v AS (SELECT A, B, C, split, CycleTime_sec AS y, {", ".join(f"lag(value, {SEQ_L - t}) OVER ww AS v{t}" for t in _STEPS)},
             count(*) OVER ww AS n
      FROM feat WINDOW ww AS (PARTITION BY split ORDER BY C, A, B ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cells AS ({" UNION ALL ".join(f"SELECT v{t} AS x FROM v WHERE split = 'train' AND n >= {SEQ_L}" for t in _STEPS)}),
sc AS (SELECT avg(x) AS mu, greatest(stddev_pop(x), 1e-8) AS sd FROM cells),
sy AS (SELECT A, B, C, split, y, {", ".join(f"(coalesce(v{t}, mu) - mu) / sd AS z{t}" for t in _STEPS)},
              CAST(y >= 90 AS INTEGER) AS is_long FROM v CROSS JOIN sc WHERE n >= {SEQ_L}),
rt AS (SELECT avg(is_long) AS rate FROM sy WHERE split = 'train'),
sz AS MATERIALIZED (SELECT sy.*, CASE WHEN is_long = 1 THEN (1 - rate) / greatest(rate, 1e-6) ELSE 1 END AS wt
                    FROM sy CROSS JOIN rt)""", wide_ridge("sz", _ZS), logit_newton("sz", _ZS))
_PROB = "1 / (1 + exp(-(t0 + " + " + ".join(f"t{t} * z{t}" for t in _STEPS) + ")))"


def seq_windows(spark, sf_dir, length=SEQ_L):
    f = events_features(spark, sf_dir)
    return windows(f, ["value"], length, ["C", "A", "B"], target_inside=True,
                   meta=_SEQ_KEYS, partition=["split"])


def seq_scaled(spark, sf_dir):
    """Windows scaled with the train scaler, written once to the shared checkpoint folder; and the
    scaler."""
    ix = window_index(events_features(spark, sf_dir), ["value"], ["C", "A", "B"], _SEQ_KEYS, ["split"])
    scaler = S.fit_row_scaler(with_place(ix, ["split"]), ["value"], SEQ_L)
    win = sliding_windows(ix, ["value"], SEQ_L, target_inside=True, meta=_SEQ_KEYS, target="CycleTime_sec",
                          same=["split"])
    return S.apply_window_scaler(win, *scaler).checkpoint(eager=True), scaler


def seq_model(spark, sf_dir):
    """Scaled windows and the ridge and the classifier fitted on the train ones."""
    win, scaler = seq_scaled(spark, sf_dir)
    train = win.filter(F.col("split") == "train")
    return win, M.fit_window_regressor(train), M.fit_window_classifier(train), scaler


def seq_predictions(spark, sf_dir):
    """R15 table of val and test."""
    win, reg, cls, _ = seq_model(spark, sf_dir)
    return M.prediction_table(win.filter(F.col("split").isin("val", "test")), reg, cls, _SEQ_KEYS)


@query("R12_window_regression", _SEQ_SQL + f"SELECT split, {_METRICS} FROM p WHERE split IN ('val', 'test') "
       "GROUP BY split", doubles=_MD)
def r12_window_regression(spark, sf_dir):
    win, _ = seq_scaled(spark, sf_dir)
    reg = M.fit_window_regressor(win.filter(F.col("split") == "train"))
    scored = M.window_scores(win.filter(F.col("split").isin("val", "test")), reg)
    return M.regression_metrics(scored, "y", "pred", ["split"])


@query("R12_lagged_regression", _SEQ_SQL + f"SELECT split, {_METRICS} FROM p WHERE split IN ('val', 'test') "
       "GROUP BY split", doubles=_MD)
def r12_lagged_regression(spark, sf_dir):
    """The same ridge, fitted on lagged cross products of rows; windows only where it scores."""
    from cadence.operators.lagged import fit_window_ridge
    ix = window_index(events_features(spark, sf_dir), ["value"], ["C", "A", "B"], _SEQ_KEYS, ["split"])
    placed = with_place(ix, ["split"])
    scaler = S.fit_row_scaler(placed, ["value"], SEQ_L)
    reg = fit_window_ridge(placed, ["value"], SEQ_L, scaler)
    win = sliding_windows(ix.filter(F.col("split").isin("val", "test")), ["value"], SEQ_L, target_inside=True,
                          meta=_SEQ_KEYS, target="CycleTime_sec", same=["split"])
    scored = M.window_scores(S.apply_window_scaler(win, *scaler), reg)
    return M.regression_metrics(scored, "y", "pred", ["split"])


_TABLE = (f"SELECT A, B, {ts_text('C')} AS C, split, y AS true_sec, pred AS pred_sec, {_PROB} AS pred_long_prob, "
          f"is_long AS is_long_true, CAST({_PROB} >= 0.5 AS INTEGER) AS is_long_pred "
          "FROM p CROSS JOIN lt WHERE split IN ('val', 'test')")


@query("R15_prediction_table", _SEQ_SQL + _TABLE, doubles=("true_sec", "pred_sec", "pred_long_prob"))
def r15_prediction_table(spark, sf_dir):
    return seq_predictions(spark, sf_dir).withColumn("C", sts("C"))


@query("R13_long_probability", _SEQ_SQL + f"SELECT B, split, {_PROB} AS pred_long_prob, "
       f"CAST({_PROB} >= 0.5 AS INTEGER) AS is_long_pred FROM p CROSS JOIN lt WHERE split IN ('val', 'test')",
       doubles=("pred_long_prob",))
def r13_long_probability(spark, sf_dir):
    """Class-weighted logistic regression on the scaled windows."""
    win, _ = seq_scaled(spark, sf_dir)
    cls = M.fit_window_classifier(win.filter(F.col("split") == "train"))
    prob = cls.predict(F.col("X"))
    return (win.filter(F.col("split").isin("val", "test"))
            .select("B", "split", prob.alias("pred_long_prob"), S.decide(prob).alias("is_long_pred")))


_E = "abs(pred_sec - true_sec)"
_HUBER = f"(CASE WHEN {_E} < 1 THEN 0.5 * {_E} * {_E} ELSE {_E} - 0.5 END)"
_BCE = ("(-(pos_weight * is_long_true * ln(greatest(pred_long_prob, 1e-12)) "
        "+ (1 - is_long_true) * ln(greatest(1 - pred_long_prob, 1e-12))))")
_W = "(CASE WHEN is_long_true = 1 THEN 3.0 ELSE 0.2 END)"
_LOSSES = ("huber", "l1", "l2", "weighted_reg", "bce", "focal", "total")
_LOSS_ROWS = f"""
, t AS ({_TABLE}), pw AS (SELECT (1 - rate) / greatest(rate, 1e-6) AS pos_weight FROM rt)
"""


def _with_weight(spark, sf_dir):
    """The prediction table and the class weight of the train windows."""
    win, reg, cls, _ = seq_model(spark, sf_dir)
    p = M.prediction_table(win.filter(F.col("split").isin("val", "test")), reg, cls, _SEQ_KEYS)
    return p.crossJoin(F.broadcast(S.class_rate(win, "y").select("pos_weight")))  # one row


@query("R14_losses", _SEQ_SQL + _LOSS_ROWS + f"""
SELECT split, avg({_HUBER}) AS huber, avg({_E}) AS l1, avg({_E} * {_E}) AS l2, avg({_W} * {_HUBER}) AS weighted_reg,
       avg({_BCE}) AS bce, avg({_BCE}) AS focal, avg(0.05 * {_BCE} + {_W} * {_HUBER}) AS total
FROM t CROSS JOIN pw GROUP BY split""", doubles=_LOSSES)
def r14_losses(spark, sf_dir):
    p = _with_weight(spark, sf_dir)
    cols = M.loss_columns(F.col("true_sec"), F.col("pred_sec"), F.col("pred_long_prob"),
                          F.col("is_long_true"), pos_weight=F.col("pos_weight"))
    per_row = p.select("split", *cols)
    return per_row.groupBy("split").agg(*[F.avg(c).alias(c) for c in per_row.columns if c != "split"])


_PT = "(CASE WHEN is_long_true = 1 THEN pred_long_prob ELSE 1 - pred_long_prob END)"


@query("R14_class_ramp", _SEQ_SQL + _LOSS_ROWS + f"""
SELECT split, epoch, avg(0.05 * least(1.0, epoch / 5.0) * pow(1 - {_PT}, 2) * {_BCE} + {_W} * {_HUBER}) AS total
FROM t CROSS JOIN pw CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS epoch) GROUP BY split, epoch""",
       doubles=("total",))
def r14_class_ramp(spark, sf_dir):
    """The weighted total, focal with gamma 2, as the class weight is ramped over the first epochs."""
    p = _with_weight(spark, sf_dir)
    parts = []
    for epoch in range(1, M.WARMUP_EPOCHS + 3):
        total = M.loss_columns(F.col("true_sec"), F.col("pred_sec"), F.col("pred_long_prob"), F.col("is_long_true"),
                               pos_weight=F.col("pos_weight"), gamma=2.0, alpha_cls=M.class_weight_at(epoch))[-1]
        parts.append(F.struct(F.lit(epoch).alias("epoch"), total))
    rows = p.select("split", F.inline(F.array(*parts)))
    return rows.groupBy("split", "epoch").agg(F.avg("total").alias("total"))


@query("R10_attribution_over_time", _SEQ_SQL + "SELECT 'value' AS feature, avg(phi) AS mean_abs_shap FROM (" +
       " UNION ALL ".join(f"SELECT abs(w{t} * (z{t} - a{t})) AS phi FROM p WHERE split = 'test'" for t in _STEPS) + ")",
       doubles=("mean_abs_shap",))
def r10_attribution_over_time(spark, sf_dir):
    win, _ = seq_scaled(spark, sf_dir)
    train = win.filter(F.col("split") == "train")
    reg = M.fit_window_regressor(train)
    return AT.window_attribution(win.filter(F.col("split") == "test"), reg.coef, train, ["value"])


_LAST = ", ".join(f"max(CASE WHEN r = {SEQ_L + 1 - t} THEN value END) AS x{t}" for t in _STEPS)


@query("R12_next_step_score", _SEQ_SQL + f"""
, latest AS (SELECT *, row_number() OVER (ORDER BY C DESC, A DESC, B DESC) AS r FROM feat WHERE split = 'test'),
one AS (SELECT max(CASE WHEN r = 1 THEN A END) AS A, max(CASE WHEN r = 1 THEN B END) AS B, {_LAST}
        FROM latest WHERE r <= {SEQ_L}),
oz AS (SELECT A, B, {", ".join(f"(coalesce(x{t}, mu) - mu) / sd AS z{t}" for t in _STEPS)} FROM one CROSS JOIN sc)
SELECT A, B, b0 + {" + ".join(f"w{t} * z{t}" for t in _STEPS)} AS pred_sec, {_PROB} AS pred_long_prob
FROM oz CROSS JOIN b CROSS JOIN lt""", doubles=("pred_sec", "pred_long_prob"))
def r12_next_step_score(spark, sf_dir):
    """Training, saving, loading, scoring: the last L rows of the test split as one window, imputed
    and scaled with the train scaler, then the next-step seconds and the long probability."""
    from cadence.plans.entrypoints import SequenceModel, score_latest, sequence_model
    from cadence.sources import io
    f = events_features(spark, sf_dir)
    model, _, _ = sequence_model(f, EVENTS_ROLES, SEQ_L, feature_list=["value"])
    path = model.save(spark, io.scratch_path(spark, "sequence-model"))
    scored = score_latest(f, EVENTS_ROLES, SequenceModel.load(spark, path))
    return scored.select("A", "B", "pred_sec", "pred_long_prob")


@query("U1_union_predictions", with_ctes(EVENTS_CT, """
w AS (SELECT B, split, CycleTime_sec AS y, count(*) OVER (PARTITION BY split ORDER BY C, A, B
             ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM feat)""") +
       "SELECT B, split, y FROM w WHERE n = 5 AND split IN ('val', 'test')", doubles=("y",))
def u1_union_predictions(spark, sf_dir):
    """The validation and the test table of windows as one, by column name."""
    win = seq_windows(spark, sf_dir, 5)
    return S.union_all([win.filter(F.col("split") == sp).select("B", "split", "y") for sp in ("val", "test")])


@query("J1_attach_keys", with_ctes(EVENTS_CT, """
w AS (SELECT B, CycleTime_sec AS y, count(*) OVER (PARTITION BY split ORDER BY C, A, B
             ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM feat)""") +
       f"SELECT feat.A, feat.B, {ts_text('feat.C')} AS C, feat.split, w.y, feat.CycleTime_sec "
       "FROM w JOIN feat ON w.B = feat.B WHERE w.n = 5", doubles=("y", "CycleTime_sec"))
def j1_attach_keys(spark, sf_dir):
    """Per-window results keyed by the window's target row, joined back to
    that row of the feature table (the payload here is the window's target,
    which must equal the row's own)."""
    win = seq_windows(spark, sf_dir, 5).select("B", "y")
    f = events_features(spark, sf_dir).select("A", "B", "C", "split", "CycleTime_sec")
    return f.join(win, "B").select("A", "B", sts("C").alias("C"), "split", "y", "CycleTime_sec")
