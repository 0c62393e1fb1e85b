"""Per-stock history operators. A stock partition holds at most one row per date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.label import by_stock
from panelyard.schema import DATE, LABEL, STOCK, infer_features


def rolling_stats(df: DataFrame, features: Sequence[str], windows: Sequence[int] = (5, 10, 20), *,
                  stats: Sequence[str] = ("mean", "std"), min_periods: int | None = None, ddof: int = 0,
                  date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Trailing mean and std over the last w rows, current row included.

    All expressions share one partition and order, hence one exchange and sort.
    """
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    cells = []
    for w in windows:
        frame = by_stock(date, stock).rowsBetween(-(w - 1), 0)
        need = F.lit(w if min_periods is None else min_periods)
        for f in features:
            enough = F.count(f).over(frame) >= need
            if "mean" in stats:
                cells.append(F.when(enough, F.avg(f).over(frame)).alias(f"{f}__roll_mean_{w}"))
            if "std" in stats:
                cells.append(F.when(enough, std(f).over(frame)).alias(f"{f}__roll_std_{w}"))
    return df.select("*", *cells)


def feature_stage(df: DataFrame, *, features: Sequence[str] | None = None, windows: Sequence[int] = (5, 10, 20),
                  min_periods: int | None = None, ddof: int = 0, date: str = DATE, stock: str = STOCK,
                  label: str = LABEL, exclude: Sequence[str] = ()) -> DataFrame:
    """Rolling features for the given or inferred columns."""
    chosen = list(features) if features else infer_features(df, date=date, stock=stock, label=label, exclude=exclude)
    return rolling_stats(df, chosen, windows, min_periods=min_periods, ddof=ddof, date=date, stock=stock)


def forward_fill(df: DataFrame, features: Sequence[str], *, limit: int | None = None, zero_rest: bool = False,
                 date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Last known value of the stock, at most ``limit`` rows back."""
    frame = by_stock(date, stock).rowsBetween(Window.unboundedPreceding if limit is None else -limit, -1)
    chosen = set(features)

    def cell(c):
        filled = [F.col(c), F.last(c, ignorenulls=True).over(frame)]
        return F.coalesce(*filled, *([F.lit(0.0)] if zero_rest else [])).alias(c)

    return df.select(*[cell(c) if c in chosen else F.col(c) for c in df.columns])


def sequences(df: DataFrame, features: Sequence[str], seq_len: int, *, incomplete: str = "drop",
              pad_side: str = "left", min_len: int = 1, with_mask: bool = False, label: str = LABEL,
              weight: str | None = None, date: str = DATE, stock: str = STOCK) -> DataFrame:
    """The last ``seq_len`` feature rows of a stock as one array per sample.

    A stock with a shorter history gives no sample (``drop``) or one padded
    sample at its last row (``pad_zero``, ``pad_first``). The collected frame
    never exceeds ``seq_len`` rows.
    """
    if seq_len <= 0:
        raise ValueError("seq_len must be positive")
    if incomplete not in ("drop", "pad_zero", "pad_first"):
        raise ValueError(f"unknown policy {incomplete}")
    if pad_side not in ("left", "right"):
        raise ValueError(f"unknown pad side {pad_side}")
    w = by_stock(date, stock)
    whole = Window.partitionBy(stock)
    step = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(
        date, stock, label, *([weight] if weight else []),
        F.collect_list(step).over(w.rowsBetween(-(seq_len - 1), 0)).alias("seq"),
        F.row_number().over(w).alias("__i"), F.count(F.lit(1)).over(whole).alias("__m"))
    full = F.col("__i") >= seq_len
    short = (F.col("__m") < seq_len) & (F.col("__i") == F.col("__m"))
    wanted = full if incomplete == "drop" else full | short
    rows = rows.where(wanted & (F.col("__m") >= min_len)).withColumn("__pads", F.lit(seq_len) - F.size("seq"))
    pads = F.col("__pads")
    if incomplete != "drop":
        filler = F.array(*[F.lit(0.0)] * len(features)) if incomplete == "pad_zero" else F.element_at("seq", 1)
        block = F.array_repeat(filler, pads)
        padded = F.concat(block, F.col("seq")) if pad_side == "left" else F.concat(F.col("seq"), block)
    else:
        padded = F.col("seq")
    mask = []
    if with_mask:
        real = (lambda i: i > pads) if pad_side == "left" else (lambda i: i <= F.lit(seq_len) - pads)
        mask = [F.transform(F.sequence(F.lit(1), F.lit(seq_len)), real).alias("mask")]
    return rows.select(date, stock, label, *([weight] if weight else []), padded.alias("seq"), *mask)


def check_complete(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    """Strict check before building sequences: no missing feature, no missing label."""
    from panelyard.operators.joins import missing_report

    row = missing_report(df, [*features, label]).first().asDict()
    bad = {k: v for k, v in row.items() if k != "n_rows" and v}
    if bad:
        raise ValueError(f"missing values: {bad}")
    return df
