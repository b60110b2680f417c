"""Regressors, metrics, scoring, prediction tables.

* R1 ridge is MLlib's normal-equation solver: one distributed pass over vectors
  sums the F x F Gram matrix, the only value that reaches the driver.
* R13 is logistic regression by iteratively re-weighted least squares: each
  step sums one weighted Gram matrix.
* Linear models of windows are plain numbers (``WindowLinear``): they score with
  a column expression and are saved as a small table.
* R2/R3 are MLlib estimators; R4 is a real ``pyspark.ml.Pipeline``
  (imputation and scaling with train statistics as a ``SQLTransformer``,
  ``VectorAssembler``, model), so it can be saved with ``PipelineModel.save``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, GeneralizedLinearRegression, LinearRegression,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.operators.stats import (LONG_THRESHOLD, RATE_FLOOR, ZERO_STD_EPS, decide,
                                     finite_or_null, long_flag, train_stats)
from cadence.operators.tree_fit import fit_on_cells
from cadence.sources.io import staged

# Reference model settings.
RIDGE_ALPHA = 1.0
RF_TREES = 400
RF_DEPTH = 30  # no limit in the reference; the deepest that MLlib grows
GBT_ROUNDS, GBT_RATE, GBT_DEPTH, GBT_SUBSAMPLE, GBT_COLSAMPLE = 800, 0.05, 6, 0.8, "0.8"
SEED = 42


# --- R1: ridge, closed form ------------------------------------------------------

@dataclass
class RidgeModel:
    features: list[str]
    coef: np.ndarray
    intercept: float

    def predict(self, name: str = "pred") -> Column:
        products = F.zip_with(F.array(*[F.col(f).cast("double") for f in self.features]),
                              F.array(*[F.lit(float(w)) for w in self.coef]), lambda x, w: x * w)
        return F.aggregate(products, F.lit(float(self.intercept)), lambda a, v: a + v).alias(name)

    def table(self, spark) -> DataFrame:
        rows = [(f, float(w)) for f, w in zip(self.features, self.coef)]
        rows.append(("(intercept)", float(self.intercept)))
        return spark.createDataFrame(rows, "feature string, coef double")


def ridge_fit(df: DataFrame, features: list[str], label: str, alpha: float = RIDGE_ALPHA) -> RidgeModel:
    """Minimise ||y - Xw - b||^2 + alpha ||w||^2 (intercept not penalised).

    MLlib's normal-equation solver: one distributed pass sums the centred Gram
    matrix as a vector (no expression per pair of features), the driver solves
    it.  A NULL in a feature or the label of a training row is an error."""
    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)],
                     F.col(f"`{label}`").cast("double").alias("y"))
    missing = F.col("y").isNull()
    for i in range(len(features)):
        missing = missing | F.col(f"x{i}").isNull()
    n, bad, spread = rows.agg(F.count(F.lit(1)), F.count_if(missing), F.stddev_pop("y")).first()
    if not n:
        raise RuntimeError("ridge_fit: no training rows")
    if bad:
        raise ValueError(f"ridge_fit: {bad} training rows hold a NULL; impute them first")
    if not spread:  # a constant label: nothing to explain
        return RidgeModel(list(features), np.zeros(len(features)), float(rows.agg(F.avg("y")).first()[0]))
    vector = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="features")
    fitted = make_regressor("Ridge", "y", n, spread, alpha).fit(vector.transform(rows).select("features", "y"))
    return RidgeModel(list(features), fitted.coefficients.toArray(), float(fitted.intercept))


# --- R5, R6: metrics and model choice -------------------------------------------------

def regression_metrics(df: DataFrame, label: str, pred: str, by: list[str]) -> DataFrame:
    """MAE, RMSE, R2 per group (R2 of a constant label: 1 if exact else 0)."""
    e = F.col(label) - F.col(pred)
    ss_res = F.sum(e * e)
    ss_tot = F.count(F.lit(1)) * F.var_pop(F.col(label))
    r2 = (F.when(ss_tot > 0, F.lit(1.0) - ss_res / ss_tot)
           .when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                               r2.alias("r2"))


def best_model(metrics: DataFrame, select_split: str = "val", report_split: str = "test") -> DataFrame:
    """Model with the lowest RMSE on ``select_split``, with its metrics on
    ``report_split``."""
    best = (metrics.filter(F.col("split") == select_split)
                   .agg(F.min_by("model", F.struct("rmse", "model")).alias("model")))
    return (metrics.filter(F.col("split") == report_split).join(best, "model")
                   .select("model", "split", "mae", "rmse", "r2"))


def rank_models(metrics: DataFrame) -> DataFrame:
    """Models ordered by RMSE."""
    return metrics.orderBy("rmse", "model")


# --- R4: pipeline with train-only imputation and scaling -----------------------------

def scaler_statement(df: DataFrame, features: list[str], impute: str = "median",
                     accuracy: int | None = None) -> tuple[str, list[str]]:
    """Train statistics (median [or mean], then mean and population std of the
    imputed values) turned into one SQL projection for ``SQLTransformer``.
    Two aggregates over the train rows; F numbers reach the driver."""
    fin = {f: finite_or_null(F.col(f).cast("double")) for f in features}
    if impute == "median":
        st = train_stats(df, features, split=None, exact=accuracy is None,
                         accuracy=accuracy or 10_000)
        fills = {r["feature"]: r["median"] for r in st.collect()}
    else:
        fills = df.agg(*[F.avg(x).alias(f) for f, x in fin.items()]).first().asDict()
    fills = {f: (0.0 if v is None else float(v)) for f, v in fills.items()}
    imputed = {f: F.coalesce(x, F.lit(fills[f])) for f, x in fin.items()}
    mom = df.agg(*[F.avg(x).alias(f"m_{f}") for f, x in imputed.items()],
                 *[F.stddev_pop(x).alias(f"s_{f}") for f, x in imputed.items()]).first().asDict()
    parts, out = [], []
    for i, f in enumerate(features):
        mu = float(mom[f"m_{f}"] or 0.0)
        sd = float(mom[f"s_{f}"] or 0.0)
        sd = sd if sd > ZERO_STD_EPS * max(abs(mu), 1.0) else 1.0
        x = (f"CASE WHEN isnan(CAST(`{f}` AS DOUBLE)) OR abs(CAST(`{f}` AS DOUBLE)) = double('inf') "
             f"THEN NULL ELSE CAST(`{f}` AS DOUBLE) END")
        parts.append(f"(coalesce({x}, {fills[f]!r}) - {mu!r}) / {sd!r} AS `_z{i}`")
        out.append(f"_z{i}")
    return "SELECT *, " + ", ".join(parts) + " FROM __THIS__", out


def make_regressor(kind: str, label: str, n_train: int | None = None, y_std: float | None = None,
                   alpha: float = RIDGE_ALPHA, rf_trees: int = RF_TREES, rf_depth: int = RF_DEPTH,
                   gbt_rounds: int = GBT_ROUNDS):
    """R1 (MLlib form), R2, R3 with the reference settings."""
    if kind == "Ridge":
        # sklearn's alpha on the sum of squares == MLlib regParam * n / std_pop(y)
        reg = alpha / max(n_train or 1, 1) * (y_std or 1.0)
        return LinearRegression(featuresCol="features", labelCol=label, predictionCol="pred",
                                regParam=reg, elasticNetParam=0.0, standardization=False,
                                solver="normal", fitIntercept=True)
    if kind == "RF":
        return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="pred",
                                     numTrees=rf_trees, maxDepth=rf_depth,
                                     featureSubsetStrategy="all", seed=SEED)
    if kind == "GBT":
        return GBTRegressor(featuresCol="features", labelCol=label, predictionCol="pred",
                            maxIter=gbt_rounds, stepSize=GBT_RATE, maxDepth=GBT_DEPTH,
                            subsamplingRate=GBT_SUBSAMPLE, featureSubsetStrategy=GBT_COLSAMPLE,
                            seed=SEED)
    raise ValueError(kind)


def fit_pipeline(train: DataFrame, features: list[str], label: str, kind: str,
                 **kw) -> PipelineModel:
    """Impute (train median) -> scale (train mean / population std) ->
    assemble -> model, fitted on train rows only.  The columns that it reads are
    written to a scratch table once, as fitting takes several passes.  Forests
    and boosting are fitted on sums of cells (``tree_fit``), and by MLlib on rows
    where the bins make too many cells."""
    train = staged(train.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*features, label])]), "train")
    stmt, zcols = scaler_statement(train, features)
    y = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("s")).first()
    model = make_regressor(kind, label, n_train=y["n"], y_std=y["s"], **kw)
    scaler, vector = SQLTransformer(statement=stmt), VectorAssembler(inputCols=zcols, outputCol="features")
    fitted = fit_on_cells(scaler.transform(train), zcols, label, model) if kind in ("RF", "GBT") else None
    if fitted is not None:
        return PipelineModel([scaler, vector, fitted])
    return Pipeline(stages=[scaler, vector, model]).fit(train)


def score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Batch scoring with a fitted pipeline."""
    if model.stages and isinstance(model.stages[-1], (RandomForestRegressionModel, GBTRegressionModel)):
        from cadence.operators.trees import tree_scores
        return tree_scores(model, df, keep)
    return model.transform(df).select(*keep, "pred")


# --- R12, R13: window models -----------------------------------------------------------

@dataclass
class WindowLinear:
    """A linear model of the flattened L x F window, as plain numbers: nothing of the session that
    fitted it is held on to."""
    coef: list[float]
    intercept: float
    logit: bool = False

    def predict(self, X: Column) -> Column:
        products = F.zip_with(F.flatten(X), F.lit(self.coef), lambda x, w: x * w)
        eta = F.aggregate(products, F.lit(self.intercept), lambda a, v: a + v)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)) if self.logit else eta


def flatten_windows(win: DataFrame) -> DataFrame:
    """L x F window -> one feature vector of L*F values (``flatten``)."""
    from pyspark.ml.functions import array_to_vector
    return win.withColumn("features", array_to_vector(F.flatten("X")))


def fit_window_regressor(train_win: DataFrame, kind: str = "Ridge", alpha: float = RIDGE_ALPHA,
                         **kw):
    """Next-step seconds from the flattened window.  Ridge is a ``WindowLinear``, the other
    kinds are MLlib models."""
    stats = train_win.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("y").alias("s"),
                          F.avg("y").alias("m"), F.max(F.size(F.flatten("X"))).alias("d")).first()
    if not stats["n"]:
        raise RuntimeError("fit_window_regressor: no training windows")
    if kind == "Ridge" and not stats["s"]:  # a constant label: nothing to explain
        return WindowLinear([0.0] * stats["d"], float(stats["m"]))
    est = make_regressor(kind, "y", n_train=stats["n"], y_std=stats["s"], alpha=alpha, **kw)
    fitted = est.fit(flatten_windows(train_win).select("features", "y"))
    if kind == "Ridge":
        return WindowLinear(fitted.coefficients.toArray().tolist(), float(fitted.intercept))
    return fitted


def window_scores(win: DataFrame, model, name: str = "pred") -> DataFrame:
    """``win`` with the model's prediction."""
    if isinstance(model, WindowLinear):
        return win.withColumn(name, model.predict(F.col("X")))
    return model.transform(flatten_windows(win)).drop("features").withColumnRenamed("pred", name)


def class_weights(df: DataFrame, threshold: float = LONG_THRESHOLD, label: str = "y") -> DataFrame:
    """G9 weights as a column: long rows weigh (1-p)/p, short rows 1."""
    p = df.agg(F.avg(long_flag(label, threshold).cast("double")).alias("_p"))
    w = (F.lit(1.0) - F.col("_p")) / F.greatest(F.col("_p"), F.lit(RATE_FLOOR))
    return (df.crossJoin(F.broadcast(p))
              .withColumn("is_long", long_flag(label, threshold).cast("double"))
              .withColumn("w", F.when(F.col("is_long") == 1, w).otherwise(F.lit(1.0)))
              .drop("_p"))


def fit_window_classifier(train_win: DataFrame, threshold: float = LONG_THRESHOLD,
                          max_iter: int = 25, tol: float = 1e-10) -> WindowLinear:
    """Probability of a long cycle: class-weighted logistic regression by iteratively
    re-weighted least squares.  With one class only the probability is its rate, kept within
    ``RATE_FLOOR`` of 0 and 1."""
    data = class_weights(flatten_windows(train_win), threshold).select("features", "is_long", "w")
    rate, size = train_win.agg(F.avg(long_flag("y", threshold)), F.max(F.size(F.flatten("X")))).first()
    if rate is None:
        raise RuntimeError("fit_window_classifier: no training windows")
    if rate in (0.0, 1.0):
        p = min(max(rate, RATE_FLOOR), 1 - RATE_FLOOR)
        return WindowLinear([0.0] * size, float(np.log(p / (1 - p))), logit=True)
    irls = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features",
                                       labelCol="is_long", weightCol="w", maxIter=max_iter, tol=tol)
    fitted = irls.fit(data)
    return WindowLinear(fitted.coefficients.toArray().tolist(), float(fitted.intercept), logit=True)


def prediction_columns(keys: list[str], pred: Column, prob: Column, threshold: float = LONG_THRESHOLD,
                       label: str = "y") -> list[Column]:
    """Keys, true and predicted seconds, long probability and flags."""
    return [*[F.col(k) for k in keys], F.col(label).alias("true_sec"), pred.alias("pred_sec"),
            prob.alias("pred_long_prob"), long_flag(label, threshold).alias("is_long_true"),
            decide(prob).alias("is_long_pred")]


def prediction_table(win: DataFrame, reg_model, cls_model: WindowLinear | None, keys: list[str],
                     threshold: float = LONG_THRESHOLD, log_target: bool = False) -> DataFrame:
    """R15 for fitted window models."""
    p = window_scores(win, reg_model, "_pred")
    prob = F.lit(None).cast("double") if cls_model is None else cls_model.predict(F.col("X"))
    p = p.withColumn("_prob", prob)
    pred = F.expm1("_pred") if log_target else F.col("_pred")
    return p.select(*prediction_columns(keys, pred, F.col("_prob"), threshold))


# --- R14: per-row losses ----------------------------------------------------------------

# Loss defaults of the sequence trainer.
HUBER_BETA = 1.0
LONG_WEIGHT, SHORT_WEIGHT = 3.0, 0.2
FOCAL_GAMMA = 0.0
ALPHA_CLS, ALPHA_REG, WARMUP_EPOCHS = 0.05, 1.0, 5


def class_weight_at(epoch: int, alpha_cls: float = ALPHA_CLS, warmup: int = WARMUP_EPOCHS) -> float:
    """Class-loss weight ramped from 0 to ``alpha_cls`` over the warm-up epochs."""
    return alpha_cls * min(1.0, epoch / max(1, warmup))


def loss_columns(y: Column, pred: Column, prob: Column | None = None, is_long: Column | None = None,
                 beta: float = HUBER_BETA, long_w: float = LONG_WEIGHT, short_w: float = SHORT_WEIGHT,
                 pos_weight: Column | float = 1.0, gamma: float = FOCAL_GAMMA,
                 alpha_cls: float = ALPHA_CLS, alpha_reg: float = ALPHA_REG) -> list[Column]:
    """Huber (smooth L1 with ``beta``), L1, L2, the long/short weighted
    regression loss and, with a probability, weighted BCE and focal loss."""
    e = F.abs(pred - y)
    huber = F.when(e < beta, F.lit(0.5) * e * e / F.lit(beta)).otherwise(e - F.lit(0.5 * beta))
    cols = [huber.alias("huber"), e.alias("l1"), (e * e).alias("l2")]
    if is_long is not None:
        w = F.when(is_long == 1, F.lit(long_w)).otherwise(F.lit(short_w))
        cols.append((w * huber).alias("weighted_reg"))
    if prob is not None and is_long is not None:
        pw = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
        eps = F.lit(1e-12)
        t = is_long.cast("double")
        bce = -(pw * t * F.log(F.greatest(prob, eps))
                + (F.lit(1.0) - t) * F.log(F.greatest(F.lit(1.0) - prob, eps)))
        pt = t * prob + (F.lit(1.0) - t) * (F.lit(1.0) - prob)
        focal = F.pow(F.lit(1.0) - pt, F.lit(gamma)) * bce
        cols.append(bce.alias("bce"))
        cols.append(focal.alias("focal"))
        w = F.when(is_long == 1, F.lit(long_w)).otherwise(F.lit(short_w))
        cols.append((F.lit(alpha_cls) * focal + F.lit(alpha_reg) * w * huber).alias("total"))
    return cols
