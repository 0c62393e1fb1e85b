"""Losses as column expressions over a prediction table.

Each function gives the per-row loss; ``reduce_loss`` turns it into a mean or a
sum aggregate. Multi-class losses take an array of logits per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reduce_loss(loss: Column, reduction: str = "mean") -> Column:
    if reduction == "none":
        return loss
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {reduction}")
    return F.avg(loss) if reduction == "mean" else F.sum(loss)


def mse(pred, target) -> Column:
    return F.pow(_c(pred) - _c(target), F.lit(2.0))


def mae(pred, target) -> Column:
    return F.abs(_c(pred) - _c(target))


def huber(pred, target, delta: float = 1.0) -> Column:
    e = F.abs(_c(pred) - _c(target))
    return F.when(e <= delta, e * e * 0.5).otherwise((e - 0.5 * delta) * delta)


def softplus(x: Column) -> Column:
    """ln(1 + e^x) that does not overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logcosh(pred, target) -> Column:
    x = _c(pred) - _c(target)
    return softplus(x * 2.0) - x - math.log(2.0)


def quantile(pred, target, q: float = 0.5) -> Column:
    if not 0.0 < q < 1.0:
        raise ValueError("q must be inside (0, 1)")
    e = _c(target) - _c(pred)
    return F.greatest(e, F.lit(0.0)) * q + F.greatest(-e, F.lit(0.0)) * (1.0 - q)


def poisson_nll(pred, target, *, log_input: bool = True, full: bool = False, eps: float = 1e-8) -> Column:
    p, y = _c(pred), _c(target)
    loss = F.exp(p) - y * p if log_input else p - y * F.ln(p + eps)
    if full:
        stirling = y * F.ln(y) - y + F.ln(y * (2.0 * math.pi)) * 0.5
        loss = loss + F.when(y > 1, stirling).otherwise(0.0)
    return loss


LOG_FLOOR = -100.0  # fixed value: lowest log-probability counted from a probability input


def bce(pred, target, *, from_logits: bool = True, pos_weight: float | None = None) -> Column:
    x, y = _c(pred), _c(target)
    if from_logits:
        w = 1.0 if pos_weight is None else float(pos_weight)
        return y * softplus(-x) * w + (F.lit(1.0) - y) * softplus(x)

    def safe_log(p):
        return F.greatest(F.coalesce(F.ln(p), F.lit(LOG_FLOOR)), F.lit(LOG_FLOOR))

    return -(y * safe_log(x) + (F.lit(1.0) - y) * safe_log(F.lit(1.0) - x))


def hinge(score, target_pm1, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(margin) - _c(target_pm1) * _c(score), F.lit(0.0))


# --- multi-class: ARRAY<DOUBLE> logits ----------------------------------------


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def log_softmax(logits) -> Column:
    z = _c(logits)
    top = F.array_max(z)
    norm = top + F.ln(_sum(F.transform(z, lambda x: F.exp(x - top))))
    return F.transform(z, lambda x: x - norm)


def _at(logp: Column, index) -> Column:
    return F.element_at(logp, _c(index).cast("int") + 1)


def _weights(class_weight: Sequence[float] | None, index) -> Column:
    if class_weight is None:
        return F.lit(1.0)
    return F.element_at(F.array(*[F.lit(float(w)) for w in class_weight]), _c(index).cast("int") + 1)


def cce(logits, target_prob) -> Column:
    """Cross-entropy against a probability array."""
    return -_sum(F.zip_with(_c(target_prob), log_softmax(logits), lambda t, lp: t * lp))


def nll(logp, index, *, class_weight: Sequence[float] | None = None, reduction: str = "mean") -> Column:
    """Negative log-likelihood of class ``index``; the mean is weighted by class weight."""
    w = _weights(class_weight, index)
    loss = -_at(_c(logp), index) * w
    return F.sum(loss) / F.sum(w) if reduction == "mean" else reduce_loss(loss, reduction)


def sparse_cce(logits, index, *, class_weight: Sequence[float] | None = None, label_smoothing: float = 0.0,
               reduction: str = "mean") -> Column:
    """Cross-entropy against a class index, with class weights and smoothing."""
    logp = log_softmax(logits)
    w = _weights(class_weight, index)
    hard = -_at(logp, index) * w
    if label_smoothing:
        if class_weight is None:
            even = -_sum(logp)
        else:
            ws = F.array(*[F.lit(float(x)) for x in class_weight])
            even = -_sum(F.zip_with(ws, logp, lambda a, b: a * b))
        hard = hard * (1.0 - label_smoothing) + even * F.lit(label_smoothing) / F.size(_c(logits))
    return F.sum(hard) / F.sum(w) if reduction == "mean" else reduce_loss(hard, reduction)


def weighted_ce(logits, index, class_weight: Sequence[float], reduction: str = "mean") -> Column:
    return sparse_cce(logits, index, class_weight=class_weight, reduction=reduction)


def label_smoothing_ce(logits, index, smoothing: float = 0.1) -> Column:
    """Target 1 - s on the class, s / (k - 1) on each other class."""
    if not 0.0 <= smoothing < 1.0:
        raise ValueError("smoothing must be in [0, 1)")
    logp = log_softmax(logits)
    hit, k = _at(logp, index), F.size(_c(logits))
    rest = (_sum(logp) - hit) * F.lit(smoothing) / (k - 1)
    return -(hit * (1.0 - smoothing) + rest)


def polyloss(logits, index, eps: float = 1.0) -> Column:
    ce = -_at(log_softmax(logits), index)
    return ce + (F.lit(1.0) - F.exp(-ce)) * eps
