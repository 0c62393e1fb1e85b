"""Scoring of prediction tables: daily IC, per-part metrics, quantile portfolios, chart tables.

A prediction table holds ``date, stockid, y_true, y_pred`` and usually ``part, fold, step_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions import metrics as M
from panelyard.operators.joins import validate_disjoint
from panelyard.plans.skew import add_ranks, attach, attach_one_row, average_ranks, keep_latest, running_totals, union_all
from panelyard.plans.stage import stage
from panelyard.schema import DATE, STOCK

PART_ORDER = ("train", "valid", "test")  # fixed value: report order, other parts follow


def _pairs(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    return df.where(both).select(*keys, F.col(y).cast("double").alias("__y"), F.col(p).cast("double").alias("__p"))


def _corr(df: DataFrame, keys: Sequence[str], method: str, small: bool = False) -> DataFrame:
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method {method}")
    if method == "spearman":
        return _rank_corr(average_ranks(df, keys, {"__y": "__ry", "__p": "__rp"}, small=small), keys)
    x, z = "__y", "__p"
    # a constant side has no correlation; corr() itself would raise on it in ANSI mode
    defined = (F.min(x) < F.max(x)) & (F.min(z) < F.max(z))
    spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(z), F.lit(0.0))
    ic = F.when(defined, F.covar_pop(x, z) / spread)
    return df.groupBy(*keys).agg(ic.alias("ic"), F.count(F.lit(1)).alias("n"))


def _rank_corr(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of average ranks from exact sums: doubled ranks are integers, so the result
    does not depend on the order of rows and equal rank patterns give equal values."""
    df = df.select(*keys, (2 * F.col("__ry")).cast("long").alias("x"), (2 * F.col("__rp")).cast("long").alias("z"))
    n = F.count(F.lit(1))

    def total(c: Column) -> Column:
        return F.sum(c.cast("decimal(20,0)")).cast("decimal(34,0)")

    sums = df.groupBy(*keys).agg(
        n.alias("n"), total(F.col("x")).alias("x"), total(F.col("z")).alias("z"), total(F.col("x") * F.col("z")).alias("xz"),
        total(F.col("x") * F.col("x")).alias("xx"), total(F.col("z") * F.col("z")).alias("zz"))

    def spread(a: str, b: str, ab: str) -> Column:
        return F.expr(f"CAST(n * {ab} AS DECIMAL(38,0)) - CAST({a} * {b} AS DECIMAL(38,0))").cast("double")

    across = F.sqrt(spread("x", "x", "xx")) * F.sqrt(spread("z", "z", "zz"))
    return sums.select(*keys, F.when(across > 0, spread("x", "z", "xz") / F.nullif(across, F.lit(0.0))).alias("ic"), "n")


def daily_ic(df: DataFrame, *, method: str = "spearman", keys: Sequence[str] = (DATE,), y: str = "y_true",
             p: str = "y_pred", small: bool = False) -> DataFrame:
    """Correlation of target and prediction per date (and other keys); undefined dates are left out.

    ``small`` skips the check for crowded groups when the caller has bounded them.
    """
    out = _corr(_pairs(df, keys, y, p), list(keys), method, small)
    return out.where(F.col("ic").isNotNull() & (F.col("n") >= 2))


def overall_ic(df: DataFrame, *, method: str = "spearman", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """One correlation over all rows, for tables without a date. 0 when undefined."""
    out = _corr(_pairs(df, [], y, p), [], method)
    return out.select(F.coalesce("ic", F.lit(0.0)).alias("ic"), "n")


def ic_summary(ic: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean daily IC, its information ratio and the number of scored dates."""
    return ic.groupBy(*keys).agg(
        F.coalesce(F.avg("ic"), F.lit(0.0)).alias("rankic"),
        F.coalesce(M.information_ratio("ic"), F.lit(0.0)).alias("icir"),
        F.count("ic").alias("n_dates"))


def mean_ic(df: DataFrame, **kw) -> DataFrame:
    return ic_summary(daily_ic(df, **kw)).select("rankic", "n_dates")


def ic_ratio(df: DataFrame, **kw) -> DataFrame:
    return ic_summary(daily_ic(df, **kw)).select("icir", "n_dates")


# --- metrics per part ---------------------------------------------------------


def by_part_order(df: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(p) for p in PART_ORDER]), F.col("part"))
    return df.orderBy(F.when(place > 0, place).otherwise(len(PART_ORDER) + 1), "part")


def regression_metrics(df: DataFrame, metrics: Sequence[str] = ("mse", "rmse", "mae", "r2", "rankic", "icir"), *,
                       keys: Sequence[str] = ("part",), method: str = "spearman", date: str = DATE) -> DataFrame:
    """Named regression metrics per key; an unknown name is an error."""
    unknown = [m for m in metrics if m not in M.REGRESSION and m not in M.IC_METRICS]
    if unknown:
        raise KeyError(f"unknown regression metrics {unknown}")
    keys = list(keys)
    plain = [M.REGRESSION[m]().alias(m) for m in metrics if m in M.REGRESSION]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *plain)
    if any(m in M.IC_METRICS for m in metrics):
        ic = ic_summary(daily_ic(df, method=method, keys=[*keys, date]), keys)
        out = out.join(ic, keys, "left") if keys else attach_one_row(out, ic.first().asDict())
        out = out.fillna({"rankic": 0.0, "icir": 0.0, "n_dates": 0})
        return out.select(*keys, *metrics, "n", "n_dates")
    return out.select(*keys, *metrics, "n")


def part_metrics(df: DataFrame, metrics: Sequence[str] | None = None, *, task: str = "regression",
                 threshold: float = 0.5, method: str = "spearman") -> DataFrame:
    """One row per part in report order."""
    if task == "regression":
        out = regression_metrics(df, metrics or ("mse", "rmse", "mae", "r2", "rankic", "icir"), method=method)
    elif task == "classification":
        out = classification_metrics(df, metrics or M.CLASSIFICATION, threshold=threshold)
    else:
        raise ValueError(f"unknown task {task}")
    return by_part_order(out)


def part_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


# --- binary classification ----------------------------------------------------


def resolve_prob(df: DataFrame, keys: Sequence[str] = ("part",)) -> DataFrame:
    """Column ``y_prob`` in [0, 1]: as given, or from ``y_pred``, through a sigmoid for
    every row of a key whose predictions leave [0, 1]."""
    if "y_prob" in df.columns:
        return df.withColumn("y_prob", M.clip01(F.col("y_prob").cast("double")))
    keys = list(keys)
    span = df.groupBy(*keys).agg(M.is_logit_range(F.min("y_pred"), F.max("y_pred")).alias("__logit"))
    flagged = attach(df, span, keys) if keys else df.withColumn("__logit", F.lit(span.first()[0]))
    p = F.col("y_pred").cast("double")
    return flagged.withColumn("y_prob", M.clip01(F.when(F.col("__logit"), M.sigmoid(p)).otherwise(p))).drop("__logit")


def confusion_table(df: DataFrame, *, threshold: float = 0.5, keys: Sequence[str] = ("part",)) -> DataFrame:
    cells = [c.alias(k) for k, c in M.confusion(threshold).items()]
    return df.groupBy(*keys).agg(*cells)


def _score_steps(df: DataFrame, keys: list[str], descending: bool) -> DataFrame:
    """Distinct scores with class counts, and the running counts along the score."""
    y = F.col("y_true").cast("int")
    steps = df.where(F.col("y_prob").isNotNull()).groupBy(*keys, "y_prob").agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    return running_totals(steps, keys, "y_prob", {"pos": "cum_pos", "neg": "cum_neg"}, descending=descending)


def _class_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    y = F.col("y_true").cast("int")
    return df.where(F.col("y_prob").isNotNull()).groupBy(*keys).agg(
        F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"))


def _with_totals(df: DataFrame, keys: list[str], descending: bool) -> DataFrame:
    steps, totals = _score_steps(df, keys, descending), _class_totals(df, keys)
    return attach(steps, totals, keys) if keys else attach_one_row(steps, totals.first().asDict())


def auc_ks(df: DataFrame, keys: Sequence[str] = ("part",)) -> DataFrame:
    """AUC (equal scores share their average rank) and KS; 0 when a class is empty."""
    keys = list(keys)
    steps = _with_totals(df, keys, False)
    below = F.col("cum_neg") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    gap = F.max(F.abs(F.col("cum_pos") / F.nullif(F.col("n_pos"), F.lit(0))
                      - F.col("cum_neg") / F.nullif(F.col("n_neg"), F.lit(0))))
    pairs = F.nullif(F.max(F.col("n_pos").cast("double") * F.col("n_neg")), F.lit(0.0))
    return steps.groupBy(*keys).agg(
        F.coalesce(wins / pairs, F.lit(0.0)).alias("auc"), F.coalesce(gap, F.lit(0.0)).alias("ks"))


def classification_metrics(df: DataFrame, metrics: Sequence[str] = M.CLASSIFICATION, *, threshold: float = 0.5,
                           keys: Sequence[str] = ("part",)) -> DataFrame:
    unknown = [m for m in metrics if m not in M.CLASSIFICATION]
    if unknown:
        raise KeyError(f"unknown classification metrics {unknown}")
    keys = list(keys)
    scored = resolve_prob(df, keys)
    table = confusion_table(scored, threshold=threshold, keys=keys)
    out = table.select(*keys, (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n"),
                       *[c.alias(k) for k, c in M.from_confusion().items()])
    if {"auc", "ks"} & set(metrics):
        curve = auc_ks(scored, keys)
        out = out.join(curve, keys, "left") if keys else attach_one_row(out, curve.first().asDict())
        out = out.fillna({"auc": 0.0, "ks": 0.0})
    return out.select(*keys, *metrics, "n")


def roc_points(df: DataFrame, keys: Sequence[str] = ("part",)) -> DataFrame:
    """False and true positive rate at each distinct score, highest first."""
    keys = list(keys)
    steps = _with_totals(df, keys, True)
    return steps.select(*keys, "y_prob",
                        (F.col("cum_neg") / F.greatest("n_neg", F.lit(1))).alias("fpr"),
                        (F.col("cum_pos") / F.greatest("n_pos", F.lit(1))).alias("tpr"))


def pr_points(df: DataFrame, keys: Sequence[str] = ("part",)) -> DataFrame:
    """Precision and recall at each distinct score, highest first."""
    keys = list(keys)
    steps = _with_totals(df, keys, True)
    seen = F.greatest(F.col("cum_pos") + F.col("cum_neg"), F.lit(1))
    return steps.select(*keys, "y_prob",
                        (F.col("cum_pos") / F.greatest("n_pos", F.lit(1))).alias("recall"),
                        (F.col("cum_pos") / seen).alias("precision"))


# --- curves and histograms ----------------------------------------------------


def time_curve(df: DataFrame, *, how: str = "mean", date: str = DATE, keys: Sequence[str] = ("part",)) -> DataFrame:
    """Daily mean or median of target, prediction and residual."""
    rows = df.withColumn("residual", F.col("y_true") - F.col("y_pred"))
    cols = ["y_true", "y_pred", "residual"]
    if how == "mean":
        return rows.groupBy(*keys, date).agg(*[F.avg(c).alias(c) for c in cols])
    if how != "median":
        raise ValueError("how must be mean or median")
    from panelyard.plans.skew import quantile_table

    q = quantile_table(rows, [*keys, date], cols, [0.5])
    return q.select(*keys, date, *[F.col(c)[0].alias(c) for c in cols])


def histogram(df: DataFrame, value: str, bins: int, *, keys: Sequence[str] = ("part",)) -> DataFrame:
    """Equal-width density histogram per key; every non-empty bin with its edges."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    span = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
                                   F.count(F.lit(1)).alias("__n"))
    flat = F.when(F.col("__lo") == F.col("__hi"), 0.5).otherwise(0.0)
    span = span.select(*keys, "__n", (F.col("__lo") - flat).alias("__lo"), (F.col("__hi") + flat).alias("__hi"))
    bounded = attach(rows, span, keys) if keys else attach_one_row(rows, span.first().asDict())
    placed = bounded.withColumn(
        "bin", F.least(F.width_bucket("__v", "__lo", "__hi", F.lit(bins)), F.lit(bins)) - 1)
    width = (F.col("__hi") - F.col("__lo")) / bins
    return placed.groupBy(*keys, "bin", "__lo", "__hi", "__n").agg(F.count(F.lit(1)).alias("count")).select(
        *keys, F.col("bin").cast("long").alias("bin"), (F.col("__lo") + F.col("bin") * width).alias("left"),
        "count", (F.col("count") / (F.col("__n") * width)).alias("density"))


# --- quantile portfolios ------------------------------------------------------


def assign_quantile(df: DataFrame, *, bins: int = 10, pred: str = "y_pred", out: str = "quantile",
                    date: str | None = DATE, tie_break: Sequence[str] = (STOCK,),
                    keys: Sequence[str] = ()) -> DataFrame:
    """Bucket of the prediction within the date, 0 lowest. Ties follow ``tie_break``."""
    group = [*keys, *([date] if date else [])]
    ranked = add_ranks(df, group, pred, "__r", method="first", tie_break=tie_break, count_out="__n")
    b = M.bucket(F.col("__r"), F.col("__n"), bins)
    if not date:
        b = F.when(F.col("__n") >= 1, b)
    return ranked.withColumn(out, F.when(F.col("__r").isNotNull(), b)).select(*df.columns, out)


def quantile_daily_return(df: DataFrame, *, q: str = "quantile", true: str = "y_true", date: str = DATE,
                          keys: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(q).isNotNull()).groupBy(*keys, date, q).agg(F.avg(true).alias("ret"))


def _all_bins(df: DataFrame, per_bin: DataFrame, q: str, bins: int, value: str) -> DataFrame:
    full = df.sparkSession.range(bins).select(F.col("id").alias(q))
    return full.join(per_bin, q, "left").select(q, F.coalesce(value, F.lit(0.0)).alias(value))


def quantile_mean_return(daily: DataFrame, *, bins: int = 10, q: str = "quantile") -> DataFrame:
    """Mean of the daily means, each date with equal weight; all bins present."""
    return _all_bins(daily, daily.groupBy(q).agg(F.avg("ret").alias("mean_ret")), q, bins, "mean_ret")


def quantile_cumulative_return(daily: DataFrame, *, bins: int = 10, q: str = "quantile") -> DataFrame:
    """Compounded daily means per bin; all bins present."""
    grown = daily.groupBy(q).agg((F.product(F.col("ret") + 1) - 1).alias("cum_return"))
    return _all_bins(daily, grown, q, bins, "cum_return")


# --- sampling, stitching, runs ------------------------------------------------


def stratified_sample(df: DataFrame, max_rows: int, *, seed: int = 42, keys: Sequence[str] = (DATE, STOCK),
                      part: str = "part") -> DataFrame:
    """Sample of about ``max_rows`` rows for drawing: each part by its share, at least one row.

    Rows are chosen by a seeded hash of their key, so the choice repeats: those with
    the smallest hashes, as many as the quota. Only rows below about twice the
    share that is wanted are kept and ranked; were a part short of its quota, the
    bound would be widened.
    """
    sizes = stage(df.groupBy(part).agg(F.count(F.lit(1)).alias("__n")), "sizes")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    if total <= max_rows:
        return df
    quota = F.greatest(F.round(F.lit(float(max_rows)) * F.col("__n") / total), F.lit(1.0))
    quotas = sizes.select(F.col(part).alias("__part"), "__n", quota.alias("__quota"))  # one row per part
    hashed = df.withColumn("__h", F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)))
    place = F.col("__h") / 2.0**64 + 0.5  # of the hash in its range, 0 to 1
    reach = 2.0
    while True:
        near = hashed.join(F.broadcast(quotas), F.col(part).eqNullSafe(F.col("__part")))
        near = stage(near.where(place <= (F.col("__quota") * reach + 16) / F.col("__n")), "near")
        got = near.groupBy("__part").agg(F.count(F.lit(1)).alias("__got"))
        short = quotas.join(F.broadcast(got.withColumnRenamed("__part", "__p")), F.col("__part").eqNullSafe(F.col("__p")), "left").where(
            F.coalesce("__got", F.lit(0)) < F.least("__quota", "__n"))
        if short.isEmpty():
            break
        reach *= 4
    ranked = add_ranks(near.drop("__part", "__n"), [part], "__h", "__r", method="first", tie_break=keys)
    return ranked.where(F.col("__r") <= F.col("__quota")).select(*df.columns)


def stitch(df: DataFrame, *, keys: Sequence[str] = (DATE, STOCK),
           order: Sequence[str] = ("fold", "source_file")) -> DataFrame:
    """Keep one prediction per key: the one of the last fold, then last file."""
    return keep_latest(df, keys, [c for c in order if c in df.columns])


def future_table(df: DataFrame, *, future: str = "future") -> DataFrame:
    """All future blocks as one part ``future_all``; overlapping blocks are an error."""
    rows = df.where(F.col("part") == future)
    return validate_disjoint(rows).withColumn("part", F.lit("future_all"))


def canonical_order(df: DataFrame, *, date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Sorted by (date, stock) for a sink: range partitions, each sorted."""
    return df.repartitionByRange(F.col(date), F.col(stock)).sortWithinPartitions(date, stock)


def evaluation_run(df: DataFrame, *, task: str = "regression", metrics: Sequence[str] | None = None,
                   threshold: float = 0.5) -> dict[str, DataFrame]:
    """Metric tables of a run: all parts, test only, and the stitched future if present."""
    every = part_metrics(df, metrics, task=task, threshold=threshold)
    out = {"all": every, "test": every.where("part = 'test'")}
    if not df.where("part = 'future'").isEmpty():
        out["future"] = part_metrics(future_table(df), metrics, task=task, threshold=threshold)
    return out


def chart_tables(df: DataFrame, *, bins: int = 10, max_rows: int | None = None, part: str = "test") -> dict[str, DataFrame]:
    """The numbers behind the evaluation charts of a regression run.

    ``scatter`` is the whole table unless ``max_rows`` asks for a sample.
    """
    chosen = df.where(F.col("part") == part)
    daily = quantile_daily_return(assign_quantile(chosen, bins=bins))
    residual = df.withColumn("residual", F.col("y_true") - F.col("y_pred"))
    return {
        "time_curve": time_curve(df),
        "quantile_mean": quantile_mean_return(daily, bins=bins),
        "quantile_cumulative": quantile_cumulative_return(daily, bins=bins),
        "ic_histogram": histogram(daily_ic(df, keys=["part", DATE]), "ic", 40),
        "residual_histogram": histogram(residual, "residual", 80),
        "scatter": df if max_rows is None else stratified_sample(df, max_rows),
    }


def class_chart_tables(df: DataFrame, *, threshold: float = 0.5) -> dict[str, DataFrame]:
    """The numbers behind the charts of a classification run."""
    scored = resolve_prob(df)
    return {"roc": roc_points(scored), "pr": pr_points(scored),
            "confusion": confusion_table(scored, threshold=threshold)}


# fixed values: names of the walk-forward strategy and of the prediction sources
REFIT_STRATEGY = "rankic_refit_roll"
FUTURE_SOURCE, PART_SOURCE, FILE_SOURCE = "future_stitched", "stitched_part", "explicit_parquet"


def factor_source(strategy: str, source: str = "auto", *, predictions: DataFrame | None = None,
                  future: DataFrame | None = None, explicit: DataFrame | None = None, part: str = "test",
                  value: str = "y_pred") -> tuple[DataFrame, str]:
    """Which predictions a factor evaluation reads, stitched to one row per key."""
    if source == "auto":
        source = FUTURE_SOURCE if strategy == REFIT_STRATEGY else PART_SOURCE
    table = {FUTURE_SOURCE: future, PART_SOURCE: predictions, FILE_SOURCE: explicit}
    if source not in table:
        raise ValueError(f"unknown source {source}")
    df = table[source]
    if df is None:
        raise FileNotFoundError(f"no table given for source {source}")
    if source == PART_SOURCE:
        df = df.where(F.col("part") == part)
        source = f"{PART_SOURCE}_{part}"
    return stitch(df).select(DATE, STOCK, value), source


def concat_predictions(tables: Sequence[DataFrame]) -> DataFrame:
    return union_all(tables)
