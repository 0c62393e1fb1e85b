"""Sample weights and pseudo-class labels for training slices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.plans.skew import attach, attach_one_row, quantile_table
from panelyard.schema import DATE, LABEL, RAW_SUFFIX

SIDES = ("both", "upper", "lower")


def recency_weight(df: DataFrame, *, mode: str = "exp", half_life: float = 63.0, min_weight: float = 0.1,
                   max_weight: float = 1.0, out: str = "w_recency", date: str = DATE) -> DataFrame:
    """Weight that falls with the age in days to the newest date; no date gives the minimum."""
    if not 0 < min_weight <= max_weight:
        raise ValueError("weights need 0 < min <= max")
    newest, oldest = df.agg(F.max(date), F.min(date)).first()
    age = F.datediff(F.lit(newest), F.col(date)).cast("double")
    if mode == "exp":
        if half_life <= 0:
            raise ValueError("half_life must be positive")
        core = F.exp(age * (-math.log(2.0) / half_life))
    elif mode == "linear":
        span = (newest - oldest).days if newest else 0
        core = F.lit(1.0) - age / float(span) if span > 0 else age * 0.0 + 1.0
    else:
        raise ValueError(f"unknown mode {mode}")
    weight = F.lit(min_weight) + core * (max_weight - min_weight)
    return df.withColumn(out, F.coalesce(weight, F.lit(min_weight)))


def _quantile_bounds(df: DataFrame, column: str, lower: float, upper: float, scope: str, date: str) -> DataFrame:
    """The rows with ``__lo, __hi``: quantiles of their date or of the whole slice."""
    if scope == "date":
        q = quantile_table(df, [date], [column], [lower, upper])
        q = q.select(date, F.col(column)[0].alias("__lo"), F.col(column)[1].alias("__hi"))
        return attach(df, q, [date])
    if scope != "global":
        raise ValueError(f"unknown scope {scope}")
    lo, hi = quantile_table(df, [], [column], [lower, upper]).first()[0] or (None, None)
    return attach_one_row(df, {"__lo": lo, "__hi": hi})


def tail_weight(df: DataFrame, *, label: str = LABEL, lower: float = 0.1, upper: float = 0.9,
                tail: float = 2.0, mid: float = 1.0, side: str = "both", scope: str = "global",
                out: str = "w_tail", date: str = DATE) -> DataFrame:
    """A larger weight for labels at or beyond the quantiles."""
    if not 0.0 <= lower < upper <= 1.0:
        raise ValueError("quantiles need 0 <= lower < upper <= 1")
    if min(tail, mid) <= 0 or side not in SIDES:
        raise ValueError("weights must be positive and side one of " + "|".join(SIDES))
    rows = _quantile_bounds(df, label, lower, upper, scope, date)
    low, high = F.col(label) <= F.col("__lo"), F.col(label) >= F.col("__hi")
    hit = {"both": low | high, "lower": low, "upper": high}[side]
    return rows.withColumn(out, F.when(hit, F.lit(float(tail))).otherwise(float(mid))).drop("__lo", "__hi")


def combine_weights(df: DataFrame, *, recency: str = "w_recency", tail: str = "w_tail", how: str = "multiply",
                    normalize: str = "mean1", clip_min: float | None = None, clip_max: float | None = None,
                    label: str = LABEL, out: str = "weight") -> DataFrame:
    """Merge both weights, neutral for missing labels, mean 1 if asked, then clip."""
    a, b = F.col(recency), F.col(tail)
    kinds = {"multiply": a * b, "add": a + b, "max": F.greatest(a, b)}
    if how not in kinds or normalize not in ("mean1", "none"):
        raise ValueError(f"unknown how={how} or normalize={normalize}")
    df = df.withColumn(out, F.when(F.col(label).isNull(), F.lit(1.0)).otherwise(kinds[how]))
    w = F.col(out)
    if normalize == "mean1":
        mean = df.agg(F.avg(out)).first()[0]
        w = w / F.lit(mean) if mean and mean > 0 else w
    if clip_max is not None:
        w = F.least(w, F.lit(float(clip_max)))
    if clip_min is not None:
        w = F.greatest(w, F.lit(float(clip_min)))
    return df.withColumn(out, w)


def sample_weights(df: DataFrame, *, recency: dict | None = None, tail: dict | None = None, how: str = "multiply",
                   label: str = LABEL, out: str = "weight", **combine) -> DataFrame:
    """Recency and tail weights (either may be off) combined into one column."""
    rows = recency_weight(df, **recency) if recency is not None else df.withColumn("w_recency", F.lit(1.0))
    rows = (tail_weight(rows, label=label, **tail) if tail is not None
            else rows.withColumn("w_tail", F.lit(1.0)))
    return combine_weights(rows, how=how, label=label, out=out, **combine).drop("w_recency", "w_tail")


def pseudo_class(df: DataFrame, *, label: str = LABEL, source: str | None = None, lower: float = 0.3,
                 upper: float = 0.7, low_label: float = -1.0, high_label: float = 1.0, scope: str = "date",
                 min_rows: int = 10, check: bool = True, date: str = DATE) -> DataFrame:
    """Keep the rows in both tails of the raw label and set them to two class labels."""
    if not 0.0 < lower < upper < 1.0:
        raise ValueError("quantiles need 0 < lower < upper < 1")
    raw = label + RAW_SUFFIX
    source = source or (raw if raw in df.columns else label)
    rows = _quantile_bounds(df, source, lower, upper, scope, date)
    high, low = F.col(source) >= F.col("__hi"), F.col(source) <= F.col("__lo")
    kept = rows.where(high | low)
    if check:
        n, n_high, n_low = kept.agg(F.count(F.lit(1)), F.count_if(high), F.count_if(low)).first()
        if n < min_rows or not n_high or not n_low:
            raise ValueError(f"too few tail rows: {n} kept, {n_low} low, {n_high} high")
    value = F.when(high, F.lit(float(high_label))).otherwise(float(low_label))
    if source == label:
        kept = kept.withColumn("__src", F.col(label))
        high = F.col("__src") >= F.col("__hi")
        value = F.when(high, F.lit(float(high_label))).otherwise(float(low_label))
    return kept.withColumn(label, value).select(*df.columns)
