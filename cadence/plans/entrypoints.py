"""The reference's command-level entry points as DataFrame functions.

etl -> baselines -> sequence_model -> score_latest / template; feature
selection and attribution.  Each composes the operators; every heavy step
runs on Spark, and only fixed-size model parameters reach the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators import attribution as AT
from cadence.operators import models as M
from cadence.operators import stats as S
from cadence.operators.projection import drop_case_insensitive, feature_columns
from cadence.operators.rowindex import sliding_windows, with_place
from cadence.operators.sequences import (last_step, previous_target, scoring_window, template_row,
                                         window_index)
from cadence.operators.splits import require_splits, seeded_sample
from cadence.functions.timeparse import require_rows
from cadence.plans.etl import add_target, build_raw_table
from cadence.roles import ColumnRoles
from cadence.sources import io


def etl(spark: SparkSession, csv_path: str, roles: ColumnRoles, schema=None,
        raw_out: str | None = None, features_out: str | None = None,
        rule: str = "strict", max_gap: float | None = 300, **kw) -> DataFrame:
    """``make etl``: CSV -> raw table (parsed, summarised, split) -> feature
    table.  With ``raw_out`` the raw table is written (partitioned by split)
    and the target is computed from the written copy: parsing and the series
    summary run once, and later passes read only the columns they use.  With
    ``features_out`` the feature table is written and read back."""
    raw = io.read_csv(spark, csv_path, schema, infer=schema is None)
    base = build_raw_table(raw, roles, **kw)
    require_rows(base, roles.time)          # P2: fail when no time parsed
    if raw_out:
        io.write_parquet(base, raw_out)
        base = spark.read.parquet(raw_out)
    feats = add_target(base, roles, rule, max_gap)
    if features_out:
        io.write_parquet(feats, features_out)
        return spark.read.parquet(features_out)
    return feats


def etl_from_config(spark: SparkSession, cfg: dict, schema=None) -> DataFrame:
    """``make etl`` driven by a configuration mapping (paths, roles,
    max_gap_sec, split fractions; unlike the reference, the fractions are
    honoured)."""
    roles = ColumnRoles.from_config(cfg)
    split = cfg.get("split") or {}
    train = float(split.get("train", 0.70))
    val = float(split.get("val", 0.15))
    return etl(spark, cfg["csv_path"], roles, schema, raw_out=cfg.get("raw_parquet_path"),
               features_out=cfg.get("features_parquet_path"),
               max_gap=float(cfg.get("max_gap_sec", 90)), fractions=(train, round(train + val, 12)))


PREV = "prev_ct"  # the previous target as a feature


@dataclass
class Baselines:
    metrics: DataFrame          # (model, split, mae, rmse, r2) on val and test
    best: str
    models: dict


def baselines(features: DataFrame, roles: ColumnRoles, kinds=("Ridge", "RF", "GBT"),
              **model_kw) -> Baselines:
    """``make baselines``: drop rows without target, require non-empty
    splits, fit impute -> scale -> model on train, metrics on val/test, best
    model by validation RMSE."""
    df = features.dropna(subset=[roles.target])
    require_splits(df, roles.target, roles.split)
    feats = feature_columns(df, roles)
    train = df.filter(F.col(roles.split) == "train")
    fitted = {k: M.fit_pipeline(train, feats, roles.target, k, **model_kw) for k in kinds}
    evald = df.filter(F.col(roles.split).isin("val", "test"))
    parts = [M.score(m, evald, [roles.split, roles.target]).withColumn("model", F.lit(k))
             for k, m in fitted.items()]
    metrics = M.staged(M.regression_metrics(S.union_all(parts), roles.target, "pred", ["model", roles.split]),
                       "metrics")  # a row a model and split; the rows are scored once
    best = M.best_model(metrics).first()["model"]
    return Baselines(metrics, best, fitted)


def save_pipeline(model: PipelineModel, path: str) -> str:
    """The fitted pipeline (statistics, scaling, model) to a folder."""
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_batch(rows: DataFrame, model: PipelineModel, keep: list[str], drop: list[str] = ()) -> DataFrame:
    """``inference`` of a baseline: feature rows (``io.read_scoring_input``, or ``latest_rows`` of a
    feature table) scored by a loaded pipeline.  Role columns in ``drop`` go first, whatever their
    case."""
    return M.score(model, drop_case_insensitive(rows, drop), keep)


@dataclass
class SequenceModel:
    """A fitted sequence model as plain numbers: scaler (train cell means, and mean and std of the
    imputed cells, one of each for a feature), regressor and classifier."""
    features: list[str]
    length: int
    means: list[float | None]
    center: list[float]
    std: list[float]
    regressor: M.WindowLinear
    classifier: M.WindowLinear
    log_target: bool = False

    def scaler(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """One-row frames for ``stats.apply_window_scaler``."""
        means = spark.createDataFrame([(self.means,)], "_mu array<double>")
        return means, spark.createDataFrame([(self.center, self.std)], "_mu array<double>, _sd array<double>")

    def save(self, spark: SparkSession, path: str) -> str:
        """The model as one JSON text in a new folder."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.text(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SequenceModel:
        told = json.loads(spark.read.text(path).first()[0])
        for part in ("regressor", "classifier"):
            told[part] = M.WindowLinear(**told[part])
        return cls(**told)


def sequence_model(features: DataFrame, roles: ColumnRoles, length: int = 5,
                   feature_list: list[str] | None = None, log_target: bool = False,
                   oversample_long: float | None = None, prev_target: bool = False,
                   threshold: float = S.LONG_THRESHOLD) -> tuple[SequenceModel, DataFrame, DataFrame]:
    """``make lstm`` re-aimed: windows inside each split (target row inside),
    train-only imputation and scaling over all cells, a regressor and a
    class-weighted long-cycle classifier on the flattened window.
    ``log_target`` fits the regressor on log1p(seconds) and inverts with
    expm1 (P11); ``oversample_long`` draws long train windows with that
    weight (M6); ``prev_target`` adds the previous row's target inside each
    split as a feature (W4), which drops the first row of a split.  Returns (model, prediction table for val+test, metrics)."""
    df = features.dropna(subset=[roles.target])
    feats = feature_list or feature_columns(df, roles)
    if prev_target:
        df = previous_target(df, roles.order(), [roles.split], roles.target, PREV, drop_missing=[])
        feats = [*feats, PREV]
    meta = [c for c in (roles.stream, roles.cycle, roles.time) if c] + [roles.split]
    ix = window_index(df, feats, roles.order(), meta, [roles.split], roles.target)
    means, scale = S.fit_row_scaler(with_place(ix, [roles.split]), feats, length, split=roles.split)
    win = sliding_windows(ix, feats, length, target_inside=True, meta=meta, target=roles.target,
                          same=[roles.split])
    scaled = S.apply_window_scaler(win, means, scale).checkpoint(eager=True)  # read by every step below
    trz = scaled.filter(F.col(roles.split) == "train")
    if oversample_long:
        w = F.when(S.long_flag("y", threshold) == 1, F.lit(float(oversample_long))).otherwise(F.lit(1.0))
        key = F.concat_ws(":", *[F.col(c).cast("string") for c in meta])
        trz = S.oversample(trz.withColumn("_key", key), "_key", w).drop("_key", "_draw")
    reg_train = trz.withColumn("y", S.log_target(F.col("y"))) if log_target else trz
    at = scale.first()
    model = SequenceModel(feats, length, list(means.first()["_mu"]), list(at["_mu"]), list(at["_sd"]),
                          M.fit_window_regressor(reg_train), M.fit_window_classifier(trz, threshold), log_target)
    evald = scaled.filter(F.col(roles.split).isin("val", "test"))
    preds = M.prediction_table(evald, model.regressor, model.classifier, meta, threshold, log_target)
    return model, preds, M.regression_metrics(preds, "true_sec", "pred_sec", [roles.split])


def score_latest(features: DataFrame, roles: ColumnRoles, model: SequenceModel) -> DataFrame:
    """``inference``: the last L rows (test split, or all rows when it is
    shorter) as one window, imputed and scaled with the train scaler."""
    keys = tuple(c for c in (roles.stream, roles.cycle) if c)
    if PREV in model.features:
        part = [roles.split] if roles.split in features.columns else []
        features = previous_target(features, roles.order(), part, roles.target, PREV)
    w = scoring_window(features, model.features, model.length, roles.order(), roles.split, keys)
    w = w.withColumn("y", F.lit(None).cast("double"))
    z = S.apply_window_scaler(w, *model.scaler(features.sparkSession))
    return M.prediction_table(z, model.regressor, model.classifier, list(keys),
                              log_target=model.log_target).drop("true_sec", "is_long_true")


def scoring_template(features: DataFrame, roles: ColumnRoles) -> DataFrame:
    """``template``: the latest test row (else the latest row) without target."""
    return template_row(features, roles.order())


def select_features(features: DataFrame, roles: ColumnRoles, topk: int = 50,
                    sample: int | None = None, seed: int = 42) -> DataFrame:
    """Feature selection: train rows (optionally a seeded sample), train-mean
    imputation, standardisation, ridge, exact linear attribution, top k."""
    df = features.dropna(subset=[roles.target])
    feats = feature_columns(df, roles)
    train = df.filter(F.col(roles.split) == "train")
    if sample:
        key = F.concat_ws(":", *[F.col(c).cast("string") for c in (roles.stream, roles.cycle, roles.time) if c])
        train = seeded_sample(train, key, sample, seed)
    st = S.train_stats(train, feats, split=None, median=False)
    z = S.standardize(S.impute(train, feats, st, how="mean"), feats, st)
    model = M.ridge_fit(z, feats, roles.target)
    return AT.top_features(AT.linear_attribution(z, model, z), topk)


def attribute_sequence(features: DataFrame, roles: ColumnRoles, length: int = 10,
                       feature_list: list[str] | None = None) -> DataFrame:
    """Attribution of the sequence path: global next-step windows, their last
    timestep, a ridge surrogate on train, mean |phi| on the other rows."""
    df = features.dropna(subset=[roles.target])
    feats = feature_list or feature_columns(df, roles)
    flat = last_step(df, feats, length, roles.order(), target_inside=False, meta=[roles.split],
                     target=roles.target)
    st = S.train_stats(flat, feats, split=roles.split, median=False)
    z = S.standardize(S.impute(flat, feats, st, how="mean"), feats, st)
    train = z.filter(F.col(roles.split) == "train")
    model = M.ridge_fit(train, feats, "y")
    return AT.linear_attribution(z.filter(F.col(roles.split) != "train"), model, train)
