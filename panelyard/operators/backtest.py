"""Quantile-group backtest of a prediction used as a factor.

Groups are numbered 1 (lowest factor) to ``group_num``. A leg is the equal-weight
mean return of its groups per date. Turnover of a leg is half the sum of absolute
weight changes against the leg's previous rebalance date; the fee is turnover
times rate.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.operators.evaluate import assign_quantile
from panelyard.operators.folds import date_index
from panelyard.plans.skew import attach
from panelyard.schema import DATE, STOCK

PORTFOLIOS = ("long_only", "short_only", "long_short")


@dataclass(frozen=True)
class BacktestSettings:
    group_num: int = 10
    long_groups: tuple[int, ...] = (9, 10)
    short_groups: tuple[int, ...] = (1, 2)
    factor_direction: str = "positive"
    portfolio_type: str = "long_only"
    excess_return: bool = False
    enable_turnover_fee: bool = True
    turnover_fee_rate: float = 0.00045

    def check(self) -> None:
        if self.factor_direction not in ("positive", "negative"):
            raise ValueError("factor_direction must be positive or negative")
        if self.portfolio_type not in PORTFOLIOS:
            raise ValueError(f"portfolio_type must be one of {PORTFOLIOS}")


def factor_groups(factor: DataFrame, returns: DataFrame, s: BacktestSettings, *, value: str = "y_pred",
                  ret: str = "ret", date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Stocks with a factor and a realised return, with their group of the date."""
    rows = factor.select(date, stock, F.col(value).alias("__v")).join(
        returns.select(date, stock, F.col(ret).alias("ret")), [date, stock])
    rows = rows.where(F.col("__v").isNotNull() & F.col("ret").isNotNull())
    signed = rows if s.factor_direction == "positive" else rows.withColumn("__v", -F.col("__v"))
    placed = assign_quantile(signed, bins=s.group_num, pred="__v", date=date, tie_break=[stock])
    return placed.select(date, stock, "ret", (F.col("quantile") + 1).alias("group"))


def group_returns(groups: DataFrame, *, excess: bool = False, date: str = DATE) -> DataFrame:
    """Mean return per date and group, optionally minus the mean of the whole date."""
    out = groups.groupBy(date, "group").agg(F.avg("ret").alias("ret"))
    if excess:
        market = groups.groupBy(date).agg(F.avg("ret").alias("__m"))
        out = attach(out, market, [date]).withColumn("ret", F.col("ret") - F.col("__m")).drop("__m")
    return out


def leg_turnover(members: DataFrame, *, date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Turnover per date of an equal-weight leg ``(date, stock)``; the first date is a full purchase.

    A member's weight is compared with its weight on the leg's previous date. With
    the date position as key both sides meet in one equality join, so no stock
    list is ever collected.
    """
    index = date_index(members, date=date)
    sizes = members.groupBy(date).agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    days = index.join(sizes, date)
    held = attach(members.select(date, stock), days, [date])
    now = held.select(date, stock, "idx", "w", F.lit(0.0).alias("old"))
    carried = held.select(stock, (F.col("idx") + 1).alias("idx"), F.lit(0.0).alias("w"), F.col("w").alias("old"))
    # weights now and before are summed per (position, stock): a one-pass full outer match
    change = now.select("idx", stock, "w", "old").unionByName(carried.select("idx", stock, "w", "old"))
    change = change.groupBy("idx", stock).agg(F.sum("w").alias("w"), F.sum("old").alias("old"))
    moved = change.groupBy("idx").agg(F.sum(F.abs(F.col("w") - F.col("old"))).alias("moved"))
    first = F.when(F.col("idx") == 0, 1.0).otherwise(0.5)
    return moved.join(index, "idx").select(date, (F.col("moved") * first).alias("turnover"))


def _leg(groups: DataFrame, wanted: Sequence[int], excess: bool, date: str, stock: str) -> DataFrame:
    members = groups.where(F.col("group").isin(list(wanted)))
    ret = members.groupBy(date).agg(F.avg("ret").alias("ret"))
    if excess:
        market = groups.groupBy(date).agg(F.avg("ret").alias("__m"))
        ret = ret.join(market, date).select(date, (F.col("ret") - F.col("__m")).alias("ret"))
    return ret.join(leg_turnover(members, date=date, stock=stock), date)


def group_backtest(groups: DataFrame, s: BacktestSettings, *, date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Daily portfolio: gross return, turnover, fee, net return and cumulative net return."""
    s.check()
    long = _leg(groups, s.long_groups, s.excess_return, date, stock)
    short = _leg(groups, s.short_groups, s.excess_return, date, stock)
    if s.portfolio_type == "long_only":
        daily = long.select(date, F.col("ret").alias("gross"), "turnover")
    elif s.portfolio_type == "short_only":
        daily = short.select(date, (-F.col("ret")).alias("gross"), "turnover")
    else:
        b = short.select(date, F.col("ret").alias("__r"), F.col("turnover").alias("__t"))
        daily = long.join(b, date).select(
            date, (F.col("ret") - F.col("__r")).alias("gross"), (F.col("turnover") + F.col("__t")).alias("turnover"))
    rate = s.turnover_fee_rate if s.enable_turnover_fee else 0.0
    daily = daily.withColumn("fee", F.col("turnover") * F.lit(rate))
    daily = daily.withColumn("net", F.col("gross") - F.col("fee"))
    # one row per date: the running product is bounded by the calendar
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("cum_net", F.product(F.col("net") + 1).over(w) - 1)


def backtest_both(groups: DataFrame, s: BacktestSettings) -> dict[bool, DataFrame]:
    """The same portfolio with and without the market mean taken out."""
    return {e: group_backtest(groups, BacktestSettings(**{**asdict(s), "excess_return": e})) for e in (False, True)}


def backtest_summary(daily: DataFrame, *, date: str = DATE) -> DataFrame:
    return daily.agg(
        F.count(F.lit(1)).alias("n_dates"), F.avg("net").alias("mean_net"), F.avg("turnover").alias("mean_turnover"),
        (F.product(F.col("net") + 1) - 1).alias("cum_net"), F.min(date).alias("first_date"),
        F.max(date).alias("last_date"))


def evaluation_meta(spark: SparkSession, factor: DataFrame, source: str, s: BacktestSettings, *, date: str = DATE,
                    stock: str = STOCK) -> DataFrame:
    """One row describing a factor evaluation: source, shape, parameters as JSON."""
    return factor.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(date).alias("n_dates"),
        F.countDistinct(stock).alias("n_stocks"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    ).select(F.lit(source).alias("source"), "*", F.lit(json.dumps(asdict(s), sort_keys=True)).alias("params"))
