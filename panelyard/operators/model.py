"""Spark ML models on panel slices: PCA, trees, linear, prediction tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators.reshape import assemble
from panelyard.schema import DATE, LABEL, STOCK

# --- PCA ----------------------------------------------------------------------


@dataclass
class PcaState:
    """Centre, scale and loadings. Small: features x components, fitted on one slice."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    loadings: list[list[float]]  # one list per component
    explained: list[float]
    columns: list[str]


def fit_pca(df: DataFrame, features: Sequence[str], *, components: int | None = None, share: float | None = None,
            standardize: bool = True, whiten: bool = False, prefix: str = "pc") -> PcaState:
    """Principal components of one slice; as many as asked for, or up to a variance share (0.95).

    Centring and scaling run before Spark's PCA, which does neither when it
    transforms. The scale is the population standard deviation; each component's
    largest loading is made positive.
    """
    if components is not None and share is not None:
        raise ValueError("give components or a variance share, not both")
    if not features:
        raise ValueError("no features")
    if components is None and share is None:
        share = 0.95
    if share is not None and not 0.0 < share <= 1.0:
        raise ValueError("share must be in (0, 1]")
    if components is not None and components <= 0:
        raise ValueError("components must be positive")
    features = list(features)
    raw = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="error").transform(df).select("__x")
    moments = raw.agg(Summarizer.metrics("count", "mean", "std").summary(F.col("__x")).alias("m")).first()["m"]  # one pass
    n = int(moments["count"])
    mean = [float(v) for v in moments["mean"]]
    shrink = ((n - 1) / n) ** 0.5 if n > 1 else 0.0
    sd = [float(v) * shrink for v in moments["std"]]
    scale = [s if standardize and s > 0 else 1.0 for s in sd]
    cells = [((F.col(f) - m) / s).alias(f) for f, m, s in zip(features, mean, scale)]
    ready = VectorAssembler(inputCols=features, outputCol="__z").transform(df.select(*cells)).select("__z")
    k = len(features) if components is None else min(components, len(features))
    fitted = PCA(k=k, inputCol="__z", outputCol="__p").fit(ready)
    explained = [float(v) for v in fitted.explainedVariance]
    if share is not None:
        total, k = 0.0, 0
        for k, v in enumerate(explained, 1):
            total += v
            if total >= share - 1e-12:
                break
    matrix = fitted.pc.toArray()
    whole = sum((s / c) ** 2 for s, c in zip(sd, scale)) * (n / (n - 1) if n > 1 else 1.0)
    loadings = []
    for j in range(k):
        col = [float(v) for v in matrix[:, j]]
        lead = max(col, key=abs)
        sign = 1.0 if lead >= 0 else -1.0
        spread = (explained[j] * whole) ** 0.5 if whiten else 1.0
        loadings.append([sign * v / (spread if spread > 0 else 1.0) for v in col])
    return PcaState(features, mean, scale, loadings, explained[:k], [f"{prefix}_{i:03d}" for i in range(k)])


def transform_pca(df: DataFrame, state: PcaState) -> DataFrame:
    """Replace the features by component scores: one array of dot products per row.

    Centre, scale and loadings are one literal each, so that the plan has as many
    expressions as there are columns, not as there are loadings.
    """
    def numbers(values, kind):
        return F.from_json(F.lit(json.dumps(values)), F.lit(kind))

    mean, scale = numbers(state.mean, "array<double>"), numbers(state.scale, "array<double>")
    x = F.zip_with(F.array(*[F.col(f).cast("double") for f in state.features]), mean, lambda v, m: v - m)
    rows = df.withColumn("__z", F.zip_with(x, scale, lambda v, s: v / s))
    dot = lambda w: F.aggregate(F.zip_with("__z", w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    rows = rows.withColumn("__scores", F.transform(numbers(state.loadings, "array<array<double>>"), dot))
    rest = [c for c in df.columns if c not in state.features]
    return rows.select(*rest, *[F.col("__scores")[i].alias(c) for i, c in enumerate(state.columns)])


# --- estimators ---------------------------------------------------------------

MODELS = {"gbt": GBTRegressor, "forest": RandomForestRegressor, "linear": LinearRegression}
TREES = ("gbt", "forest")
HELD_OUT = "__valid"


def build_estimator(name: str, params: dict | None = None, *, label: str = LABEL, weight: str | None = None):
    if name not in MODELS:
        raise KeyError(f"unknown model {name}")
    settings = dict(params or {})
    if name in TREES:
        settings.setdefault("seed", 42)
    if weight:
        settings["weightCol"] = weight
    return MODELS[name](featuresCol="features", labelCol=label, predictionCol="y_pred", **settings)


def fit_model(df: DataFrame, features: Sequence[str], *, name: str = "gbt", params: dict | None = None,
              label: str = LABEL, weight: str | None = None, valid: DataFrame | None = None) -> Transformer:
    """Fit one model on labelled rows. Missing features are an error: fill or z-score first.

    With ``valid`` rows boosting stops at the number of trees from which their
    error no longer falls by ``validationTol`` (Spark's default 0.01, relative);
    they have weight 1 and take no part in the trees. Forests and linear models
    have no rounds to stop and do not read them.
    """
    rows = df.where(F.col(label).isNotNull())
    columns = [] if weight is None else [weight]
    estimator = build_estimator(name, params, label=label, weight=weight)
    if valid is not None and name == "gbt":
        check = valid.where(F.col(label).isNotNull())
        rows = rows.select(DATE, STOCK, label, *features, *columns, F.lit(False).alias(HELD_OUT)).unionByName(
            check.select(DATE, STOCK, label, *features, *[F.lit(1.0).alias(c) for c in columns], F.lit(True).alias(HELD_OUT)))
        estimator = estimator.setValidationIndicatorCol(HELD_OUT)
        return estimator.fit(assemble(rows, features, keys=[DATE, STOCK, HELD_OUT], label=label, weight=weight))
    return estimator.fit(assemble(rows, features, label=label, weight=weight))


def predict(model: Transformer, df: DataFrame, features: Sequence[str], *, label: str | None = LABEL,
            keep: Sequence[str] = ()) -> DataFrame:
    """Keys, ``y_true`` (when the label is there) and ``y_pred``."""
    has = label is not None and label in df.columns
    rows = assemble(df, features, keys=[DATE, STOCK, *keep], label=label if has else None)
    scored = model.transform(rows)
    truth = [F.col(label).cast("double").alias("y_true")] if has else []
    return scored.select(DATE, STOCK, *keep, *truth, "y_pred")


def prediction_table(scored: DataFrame, *, part: str, step_id: int, fold: int, run_id: str,
                     model_name: str) -> DataFrame:
    return scored.select("*", F.lit(part).alias("part"), F.lit(step_id).cast("long").alias("step_id"),
                         F.lit(fold).cast("long").alias("fold"), F.lit(run_id).alias("run_id"),
                         F.lit(model_name).alias("model_name"))


def vector_columns(df: DataFrame, vector: str, prefix: str, size: int) -> DataFrame:
    """Spread a vector or array column over plain columns."""
    arr = F.col(vector) if df.schema[vector].dataType.typeName() == "array" else vector_to_array(vector)
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, *[arr[i].cast("double").alias(f"{prefix}{i}") for i in range(size)])


# --- bundle -------------------------------------------------------------------


@dataclass
class Bundle:
    """Everything scoring needs: model, feature order, clean state, optional PCA, notes."""

    model: Transformer
    features: list[str]
    cleaner: object | None = None
    pca: PcaState | None = None
    meta: dict | None = None

    def score(self, df: DataFrame, *, label: str | None = LABEL) -> DataFrame:
        inputs = self.features if self.pca is None else self.pca.columns
        rows = df if self.pca is None else transform_pca(df, self.pca)
        return predict(self.model, rows, inputs, label=label)


def save_bundle(bundle: Bundle, spark: SparkSession, path: str) -> None:
    from dataclasses import asdict

    PipelineModel([bundle.model]).write().overwrite().save(f"{path}/model")
    note = {"features": bundle.features, "meta": bundle.meta or {},
            "pca": asdict(bundle.pca) if bundle.pca else None,
            "cleaner": bundle.cleaner.state() if bundle.cleaner else None}
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/note")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    from panelyard.operators.clean import CleanSettings, PanelCleanerModel

    note = json.loads(spark.read.text(f"{path}/note").first()[0])
    c = note["cleaner"]
    cleaner = PanelCleanerModel(CleanSettings(**c["settings"]), c["base"], c["dropped"], c["stats"]) if c else None
    pca = PcaState(**note["pca"]) if note["pca"] else None
    model = PipelineModel.load(f"{path}/model").stages[0]
    return Bundle(model, note["features"], cleaner, pca, note["meta"])
