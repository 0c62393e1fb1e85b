"""Forward-return label and its per-date post-processing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.joins import attach_group_stats
from panelyard.plans.skew import add_ranks, attach, quantile_table
from panelyard.plans.stage import stage
from panelyard.schema import DATE, LABEL, RAW_SUFFIX, STOCK


def by_stock(date: str = DATE, stock: str = STOCK):
    """History window of one stock. The panel key is unique, so a partition holds
    at most one row per calendar date, however many rows the panel has."""
    return Window.partitionBy(stock).orderBy(date)


def forward_return(df: DataFrame, price: str, *, label: str = LABEL, log: bool = False,
                   date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Return from the stock's next row to the row after it; the last two rows have none."""
    w = by_stock(date, stock)
    p1, p2 = F.lead(price, 1).over(w), F.lead(price, 2).over(w)
    if log:
        value = F.when((p1 > 0) & (p2 > 0), F.ln(p2) - F.ln(p1))
    else:
        value = p2 / F.nullif(p1, F.lit(0.0)) - 1
    return df.withColumn(label, value)


def rank_label(df: DataFrame, *, label: str = LABEL, method: str = "average", na_option: str = "keep",
               pct: bool = True, centered: bool = False, tie_break: Sequence[str] = (STOCK,),
               date: str = DATE) -> DataFrame:
    """Replace the label by its rank within the date."""
    ranked = add_ranks(df, [date], label, "__r", method=method, na_option=na_option, pct=pct,
                       tie_break=tie_break, count_out="__n")
    r = F.col("__r")
    if centered:
        r = r - (F.lit(0.5) if pct else (F.col("__n") + 1) / 2)
    return ranked.withColumn(label, r).select(*df.columns)


def zscore_label(df: DataFrame, *, label: str = LABEL, ddof: int = 0, eps: float = 1e-12,
                 date: str = DATE) -> DataFrame:
    """(y - mean) / (std + eps) within the date; an undefined std counts as 0."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = [F.avg(label).alias("__mu"), std(label).alias("__sd")]
    scored = attach_group_stats(df, [date], stats)
    z = (F.col(label) - F.col("__mu")) / (F.coalesce(F.col("__sd"), F.lit(0.0)) + F.lit(eps))
    return scored.withColumn(label, z).select(*df.columns)


def clip_column(c, lo, hi):
    """Bound a value and keep NULL; a NULL bound does not bind."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, hi), lo))


def clip_label(df: DataFrame, bound: float | Sequence[float], *, label: str = LABEL) -> DataFrame:
    """Hard clip: a scalar c means [-c, c]."""
    lo, hi = (-float(bound), float(bound)) if isinstance(bound, (int, float)) else map(float, bound)
    if lo >= hi:
        raise ValueError("clip needs lower < upper")
    return df.withColumn(label, clip_column(F.col(label), F.lit(lo), F.lit(hi)))


def winsorize_label(df: DataFrame, *, label: str = LABEL, lower: float = 0.05, upper: float = 0.95,
                    date: str = DATE) -> DataFrame:
    """Clip to the label quantiles of the date."""
    if not 0.0 <= lower < upper <= 1.0:
        raise ValueError("winsorize needs 0 <= lower < upper <= 1")
    q = quantile_table(df, [date], [label], [lower, upper]).withColumnRenamed(label, "__q")
    bounded = attach(df, q, [date])
    clipped = clip_column(F.col(label), F.col("__q")[0], F.col("__q")[1])
    return bounded.withColumn(label, clipped).select(*df.columns)


def postprocess_label(df: DataFrame, *, label: str = LABEL, keep_raw: bool = False, rank: dict | None = None,
                      zscore: dict | None = None, clip: float | Sequence[float] | None = None,
                      winsorize: dict | None = None, date: str = DATE) -> DataFrame:
    """Fixed chain rank -> z-score -> clip -> winsorize; a step given as None is off.

    Call it on (date, stock, label) and join the result: the steps then never
    move the feature columns. The ranked label is staged once when later steps
    take statistics of it.
    """
    out = df.withColumn(label + RAW_SUFFIX, F.col(label)) if keep_raw else df
    if rank is not None:
        out = rank_label(out, label=label, date=date, **rank)
        if zscore is not None or winsorize is not None:
            out = stage(out, "ranked")
    if zscore is not None:
        out = zscore_label(out, label=label, date=date, **zscore)
    if clip is not None:
        out = clip_label(out, clip, label=label)
    if winsorize is not None:
        out = winsorize_label(out, label=label, date=date, **winsorize)
    return out


def volatility_scaled_label(df: DataFrame, *, label: str = LABEL, window: int = 20, min_periods: int = 2,
                            out: str = "y_vol", date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Label over the std of the stock's own labels that were already realised.

    A label at row t uses prices up to t+2, so only rows up to t-2 are known at t.
    """
    known = by_stock(date, stock).rowsBetween(-(window + 1), -2)
    sd = F.when(F.count(label).over(known) >= min_periods, F.stddev_samp(label).over(known))
    return df.withColumn(out, F.col(label) / F.nullif(sd, F.lit(0.0)))
