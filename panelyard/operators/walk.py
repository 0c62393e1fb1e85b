"""Walk-forward runs: evaluate per fold; evaluate, refit and predict per window.

The panel is written once, a folder per date, and each step reads only the folders of
its own slice; nothing is copied per fold. Runs that share a panel (a sweep) save it
with ``save_by_date`` and say so with ``by_date``. Steps whose parameters do not depend on the step
before run several at a time as separate Spark jobs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators.evaluate import regression_metrics
from panelyard.operators.folds import expand_dates, window_spans
from panelyard.operators.model import Bundle, fit_model, fit_pca, prediction_table, transform_pca
from panelyard.operators.tuning import NEVER, Schedule, days_due, gate_allows, search, stable_hash
from panelyard.operators.weights import pseudo_class, sample_weights
from panelyard.plans.skew import union_all
from panelyard.plans.stage import stage, stage_path
from panelyard.schema import DATE, LABEL
from panelyard.sources.panel import write_panel

HISTORY_SCHEMA = (
    "step_id long, fold long, model_name string, params string, params_hash string, n_features long, "
    "n_train long, train_score double, valid_score double, test_score double, future_score double, "
    "tune_score double, tuned boolean, updated boolean, status string, reason string, model_path string, "
    "n_valid long, n_test long, n_future long, n_features_future long")

HISTORY_REASON = [c.split()[0] for c in HISTORY_SCHEMA.split(", ")].index("reason")


@dataclass
class WalkSettings:
    model: str = "gbt"
    params: dict = field(default_factory=dict)
    label: str = LABEL
    metric: str = "rankic"
    pca: dict | None = None
    weights: dict | None = None
    pseudo: dict | None = None
    candidates: list[dict] | None = None
    schedule: Schedule = NEVER
    every_days: int | None = None  # calendar-day schedule for windows, instead of ``schedule``
    min_improve: float = 0.0
    tune_share: float = 0.2  # newest share of the training dates used to compare candidates
    run_id: str = "run"
    parallel: int = 4
    save_to: str | None = None
    early_stop: bool = False  # boosting ends where the error on rows after the training dates stops falling
    by_date: bool = False  # the panel is a scan of ``save_by_date`` already


@dataclass
class Run:
    predictions: DataFrame
    history: DataFrame
    bundles: dict[int, Bundle]


# metrics where a smaller value is better are negated, so that larger is always better
SMALLER_IS_BETTER = ("mse", "rmse", "mae")


def score(predictions: DataFrame, metric: str = "rankic") -> float:
    """One number, larger is better; any metric of the regression set."""
    row = regression_metrics(predictions, [metric], keys=[]).first()
    value = float(row[metric]) if row and row[metric] is not None else 0.0
    return -value if metric in SMALLER_IS_BETTER else value


def scores_by_part(predictions: DataFrame, metric: str) -> dict[str, float]:
    rows = regression_metrics(predictions, [metric]).collect()  # one row per part
    sign = -1.0 if metric in SMALLER_IS_BETTER else 1.0
    return {r["part"]: sign * r[metric] for r in rows}


def _prepare(df: DataFrame, features: list[str], s: WalkSettings) -> tuple[DataFrame, str | None]:
    """Training rows after pseudo-labels and weights."""
    rows = df.where(F.col(s.label).isNotNull())
    if s.pseudo is not None:
        rows = pseudo_class(rows, label=s.label, **s.pseudo)
    if s.weights is not None:
        return sample_weights(rows, label=s.label, **s.weights), "weight"
    return rows, None


def fit_step(train: DataFrame, features: Sequence[str], params: dict, s: WalkSettings,
             valid: DataFrame | None = None) -> Bundle:
    """PCA (fitted on these rows only) and model for one training slice.

    ``valid`` rows have pseudo-labels of their own slice, as the training rows do,
    and serve boosting to stop early if the settings ask for it.
    """
    rows, weight = _prepare(train, list(features), s)
    check = None
    if valid is not None and s.early_stop:
        check = _prepare(valid, list(features), replace(s, weights=None))[0]
    pca, inputs = None, list(features)
    if s.pca is not None:
        pca = fit_pca(rows, inputs, **s.pca)
        rows, inputs = transform_pca(rows, pca), pca.columns
        check = None if check is None else transform_pca(check, pca)
    model = fit_model(rows, inputs, name=s.model, params=params, label=s.label, weight=weight, valid=check)
    return Bundle(model, list(features), None, pca, {"params": params})


def save_by_date(panel: DataFrame) -> DataFrame:
    """The panel as the scan of a table with a folder per date: a date range reads its folders alone."""
    path = stage_path(panel.sparkSession, "by-date")
    write_panel(panel, path)
    return panel.sparkSession.read.schema(panel.schema).parquet(path)


def _score_slice(bundle: Bundle, df: DataFrame, s: WalkSettings, part: str, step: int) -> DataFrame:
    return prediction_table(bundle.score(df, label=s.label), part=part, step_id=step, fold=step, run_id=s.run_id,
                            model_name=s.model)


def _newest_from(rows: DataFrame, share: float):
    """First of the newest ``share`` of the dates, one at least."""
    days = rows.select(DATE).distinct().orderBy(F.col(DATE).desc())
    n = days.count()
    return days.limit(max(1, int(n * share))).agg(F.min(DATE)).first()[0]


def _fit_newest(rows: DataFrame, features: Sequence[str], params: dict, s: WalkSettings) -> Bundle:
    """Fit on a slice without later rows to check on: early stopping holds its newest dates back, never test dates."""
    if not s.early_stop:
        return fit_step(rows, features, params, s)
    cut = F.lit(_newest_from(rows, s.tune_share))
    return fit_step(rows.where(F.col(DATE) < cut), features, params, s, rows.where(F.col(DATE) >= cut))


def _tune(train: DataFrame, features: Sequence[str], s: WalkSettings) -> tuple[dict, float, float]:
    """Compare candidates on the newest training dates; test dates play no role.

    Returns the best parameters, their score, and the score of the current ones.
    """
    cut = _newest_from(train, s.tune_share)
    # every trial reads the folders of its dates from the one saved panel
    fit_rows, check = train.where(F.col(DATE) < F.lit(cut)), train.where(F.col(DATE) >= F.lit(cut))

    def trial(params: dict) -> float:
        return score(fit_step(fit_rows, features, params, s).score(check, label=s.label), s.metric)

    found = search(trial, [s.params, *(s.candidates or [])], parallel=s.parallel)
    return found.best, found.score, found.scores[0]


class _Slices:
    """Date-range slices of the panel, never copies of it.

    Folds overlap, and expanding windows repeat the early dates in every step, so
    slices are read by date range from the one saved panel, whose folders are dates.
    Row counts come from one count per date.
    """

    def __init__(self, panel: DataFrame, spans: DataFrame, index: DataFrame):
        self.panel = panel
        counts = panel.groupBy(DATE).agg(F.count(F.lit(1)).alias("n"))
        sizes = expand_dates(spans, index, ["fold", "part"]).join(counts, DATE).groupBy("fold", "part").agg(
            F.sum("n").alias("n"))
        # one row per fold and part
        rows = spans.select("fold", "part", "date_start", "date_end").join(sizes, ["fold", "part"], "left").collect()
        self.sizes = {(int(r["fold"]), r["part"]): r["n"] or 0 for r in rows}
        self.ranges = {(int(r["fold"]), r["part"]): (r["date_start"], r["date_end"]) for r in rows}

    def part(self, fold: int, *parts: str) -> DataFrame:
        inside = [F.col(DATE).between(*[F.lit(d) for d in self.ranges[(fold, p)]])
                  for p in parts if (fold, p) in self.ranges]
        return self.panel.where(reduce(or_, inside))


def _history_row(step, s, params, n_features, slices, scores, tuned=False, updated=False, tune_score=None,
                 reason=None, path=None, n_future_features=None):
    """One row per step, skipped ones included: their row and factor counts tell why."""
    get = scores.get
    rows = {p: slices.sizes.get((step, p), 0) for p in ("train", "valid", "test", "future")}
    return (step, step, s.model, json.dumps(params, sort_keys=True), stable_hash(params), n_features, rows["train"],
            get("train"), get("valid"), get("test"), get("future"), tune_score, tuned, updated,
            "skipped" if reason else "done", reason, path, rows["valid"], rows["test"], rows["future"], n_future_features)


def _run_steps(steps: Sequence[int], work: Callable[[int], tuple], parallel: int, chained: bool) -> list[tuple]:
    if chained or parallel <= 1:
        return [work(i) for i in steps]
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(work, steps))


def walk_forward(panel: DataFrame, folds: DataFrame, index: DataFrame, features: Sequence[str],
                 settings: WalkSettings | None = None) -> Run:
    """Fit on train of each fold, score train, valid and test, record one history row.

    Parameters found by tuning apply from the next fold on, so tuned runs go fold
    by fold; others run in parallel.
    """
    s = settings or WalkSettings()
    spark = panel.sparkSession
    slices = _Slices(panel if s.by_date else save_by_date(panel), folds, index)
    steps = sorted({f for f, _ in slices.sizes})
    current = {"params": dict(s.params)}
    bundles: dict[int, Bundle] = {}

    def work(step: int):
        params = dict(current["params"])
        if not slices.sizes.get((step, "train")) or not slices.sizes.get((step, "test")):
            return None, _history_row(step, s, params, len(features), slices, {}, reason="empty_part")
        train = slices.part(step, "train")
        valid = slices.part(step, "valid") if slices.sizes.get((step, "valid")) else None
        bundle = fit_step(train, features, params, s, valid)
        bundles[step] = bundle
        parts = [p for p in ("train", "valid", "test") if slices.sizes.get((step, p))]
        scored = stage(union_all([_score_slice(bundle, slices.part(step, p), s, p, step) for p in parts]), "scored")
        scores = scores_by_part(scored, s.metric)
        tuned = updated = False
        best_score = None
        if s.candidates and s.schedule.due(step):
            best, best_score, now = _tune(train, features, s)
            tuned, updated = True, gate_allows(now, best_score, s.min_improve)
            if updated:
                current["params"] = best
        path = _save(bundle, spark, s, step)
        return scored, _history_row(step, s, params, len(features), slices, scores, tuned, updated, best_score,
                                    path=path)

    results = _run_steps(steps, work, s.parallel, bool(s.candidates))
    return _collect_run(spark, results, bundles)


def _save(bundle: Bundle, spark: SparkSession, s: WalkSettings, step: int) -> str | None:
    if s.save_to is None:
        return None
    from panelyard.operators.model import save_bundle

    path = f"{s.save_to}/step={step}"
    save_bundle(bundle, spark, path)
    return path


def _collect_run(spark: SparkSession, results: list[tuple], bundles: dict[int, Bundle]) -> Run:
    tables = [t for t, _ in results if t is not None]
    if not tables:
        raise ValueError("every step was skipped: " + str({r[HISTORY_REASON] for _, r in results}))
    history = spark.createDataFrame([r for _, r in results], HISTORY_SCHEMA)
    return Run(union_all(tables), history, bundles)


def refit_walk(panel: DataFrame, windows: DataFrame, index: DataFrame, features: Sequence[str],
               settings: WalkSettings | None = None, *, selection: DataFrame | None = None) -> Run:
    """Per window: fit on train and score train and test; refit on train + test; predict future.

    Test scores come from the evaluation model alone, future rows from the
    refitted one. ``selection(window_id, stage, factor, position)`` may give each
    window its own factors for the stages ``eval`` and ``future``.
    """
    s = settings or WalkSettings()
    spark = panel.sparkSession
    slices = _Slices(panel if s.by_date else save_by_date(panel), window_spans(windows), index)
    rows = windows.select("window_id", "train_end").orderBy("window_id").collect()  # one row per window
    anchors = {int(r[0]): r[1] for r in rows}
    chosen: dict[tuple[int, str], list[str]] = {}
    if selection is not None:
        for r in selection.orderBy("window_id", "stage", "position").collect():  # windows x selected factors
            chosen.setdefault((int(r["window_id"]), r["stage"]), []).append(r["factor"])
    current: dict = {"params": dict(s.params), "last": None}
    bundles: dict[int, Bundle] = {}

    def factors(step: int, which: str) -> list[str]:
        return list(features) if selection is None else chosen.get((step, which), [])

    def work(step: int):
        params = dict(current["params"])
        use, use_future = factors(step, "eval"), factors(step, "future")
        empty = [p for p in ("train", "test", "future") if not slices.sizes.get((step, p))]
        reason = f"empty_{empty[0]}" if empty else None if use and use_future else "empty_selection"
        if reason:
            return None, _history_row(step, s, params, len(use), slices, {}, reason=reason, n_future_features=len(use_future))
        train = slices.part(step, "train")
        tuned = updated = False
        best_score = None
        due = (days_due(anchors[step], current["last"], every_days=s.every_days)
               if s.every_days is not None else s.schedule.due(step))
        fit_params = params
        if s.candidates and due:
            best, best_score, now = _tune(train, use, s)
            tuned, updated = True, gate_allows(now, best_score, s.min_improve)
            current["last"] = anchors[step]
            if updated:
                # windows tune before the evaluation model, so the result applies at once
                current["params"] = fit_params = best
        bundle = _fit_newest(train, use, fit_params, s)
        final = _fit_newest(slices.part(step, "train", "test"), use_future, fit_params, s)
        bundles[step] = final
        scored = stage(union_all([
            _score_slice(bundle, train, s, "train", step),
            _score_slice(bundle, slices.part(step, "test"), s, "test", step),
            _score_slice(final, slices.part(step, "future"), s, "future", step)]), "scored")
        scores = scores_by_part(scored, s.metric)
        path = _save(final, spark, s, step)
        return scored, _history_row(step, s, fit_params, len(use), slices, scores, tuned, updated, best_score,
                                    path=path, n_future_features=len(use_future))

    results = _run_steps(sorted(anchors), work, s.parallel, bool(s.candidates))
    return _collect_run(spark, results, bundles)


def sweep(base: WalkSettings, sets: Sequence[dict], run: Callable[[WalkSettings], Run], *, parallel: int = 1
          ) -> tuple[DataFrame, DataFrame]:
    """One walk-forward run per parameter set merged into the base.

    Returns all history rows and all predictions, each with ``set_id`` and ``params_hash``.
    """
    def one(i: int):
        settings = WalkSettings(**{**base.__dict__, "params": {**base.params, **sets[i]}, "run_id": f"set{i}"})
        out = run(settings)
        tag = [F.lit(i).cast("long").alias("set_id"), F.lit(stable_hash(settings.params)).alias("set_hash")]
        return out.history.select(*tag, "*"), out.predictions.select(*tag, "*")

    results = _run_steps(range(len(sets)), one, parallel, parallel <= 1)
    return union_all([h for h, _ in results]), union_all([p for _, p in results])


def compare_sweep(summary: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Sweep summary joined with evaluation metrics, best test score first."""
    out = summary if metrics is None else summary.join(metrics, "set_id", "left")
    key = "last_test_score" if "last_test_score" in out.columns else "mean_test_score"
    return out.orderBy(F.col(key).desc_nulls_last(), "set_id")


def combine_parts(df: DataFrame, parts: Sequence[str] = ("train", "test")) -> DataFrame:
    """Rows of several parts as one refit slice."""
    return df.where(F.col("part").isin(list(parts)))
