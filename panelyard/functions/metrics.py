"""Metric and bucket expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12  # fixed value: below it a spread counts as zero


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def mse(y="y_true", p="y_pred") -> Column:
    return _or_zero(F.avg(F.pow(F.col(y) - F.col(p), F.lit(2.0))))


def rmse(y="y_true", p="y_pred") -> Column:
    return F.sqrt(mse(y, p))


def mae(y="y_true", p="y_pred") -> Column:
    return _or_zero(F.avg(F.abs(F.col(y) - F.col(p))))


def r2(y="y_true", p="y_pred") -> Column:
    """1 - SSE / SST with the centred sum of squares; 0 when the target is constant."""
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    t = F.when(both, F.col(y))
    sse = F.sum(F.pow(F.col(y) - F.col(p), F.lit(2.0)))
    sst = F.var_pop(t) * F.count(t)
    return F.when(sst > TINY, F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0))).otherwise(0.0)


def information_ratio(x: str) -> Column:
    """Mean over sample standard deviation; 0 for one value or no spread."""
    sd = F.stddev_samp(x)
    return F.when(sd > TINY, F.avg(x) / F.nullif(sd, F.lit(0.0))).otherwise(0.0)


REGRESSION = {"mse": mse, "rmse": rmse, "mae": mae, "r2": r2}
IC_METRICS = ("rankic", "icir")

# --- binary classification ----------------------------------------------------

PROB_SLACK = 1e-6  # fixed value: how far outside [0, 1] still counts as a probability
LOGIT_BOUND = 50.0  # fixed value: logits are clipped to it


def clip01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    bounded = F.greatest(F.least(x, F.lit(LOGIT_BOUND)), F.lit(-LOGIT_BOUND))
    return F.lit(1.0) / (F.exp(-bounded) + 1.0)


def is_logit_range(lo: Column, hi: Column) -> Column:
    return (lo < -PROB_SLACK) | (hi > 1 + PROB_SLACK)


def confusion(threshold: float, y="y_true", prob="y_prob") -> dict[str, Column]:
    pos, hit = F.col(y).cast("int") == 1, F.col(prob) >= threshold
    neg = F.col(y).cast("int") == 0
    return {"tp": F.count_if(pos & hit), "tn": F.count_if(neg & ~hit),
            "fp": F.count_if(neg & hit), "fn": F.count_if(pos & ~hit)}


def ratio(num: Column, den: Column) -> Column:
    return F.coalesce(num / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def from_confusion() -> dict[str, Column]:
    """Metrics from the columns tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"acc": ratio(tp + tn, tp + tn + fp + fn), "precision": p, "recall": r,
            "f1": ratio(p * r * 2.0, p + r)}


CLASSIFICATION = ("acc", "precision", "recall", "f1", "auc", "ks")


def bucket(rank: Column, n: Column, bins: int) -> Column:
    """Equal-width bin of an ordinal rank 1..n, 0-based; too few rows go to the middle bin.

    Integer arithmetic: bin b holds the ranks r with b < (r - 1) * bins / (n - 1) <= b + 1.
    """
    if bins < 2:
        raise ValueError("bins must be at least 2")
    r, n = rank.cast("long"), n.cast("long")
    steps = (r - 1) * bins + n - 2
    exact = F.greatest(F.floor(steps / F.nullif(n - 1, F.lit(0))) - 1, F.lit(0))
    return F.when(n < bins, F.lit(bins // 2)).otherwise(exact).cast("long")
