"""Factor selection from a history of daily rank IC, and the history itself.

A history is ``(date, factor, rankic)``: one row per date and factor. Its size
is dates x factors, far below the panel, and per-factor windows over it hold one
row per date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.operators.evaluate import daily_ic
from panelyard.operators.folds import date_index
from panelyard.operators.reshape import filter_members
from panelyard.plans.skew import largest_group, rows_per_task, union_all
from panelyard.schema import DATE, LABEL, STOCK

VISIBILITY_ROWS = 2  # fixed value: a label at t is realised two rows later


def factor_daily_rankic(panel: DataFrame, factors: Sequence[str], *, label: str = LABEL, date: str = DATE,
                        stock: str = STOCK) -> DataFrame:
    """Daily rank IC of every factor against the label, with the date it becomes known.

    The long form groups by (date, factor), so hundreds of factors spread over
    dates x factors groups instead of one window per column.
    """
    # the factor travels as its number: narrow fixed-width rows through the shuffle
    cells = F.array(*[F.col(f).cast("double") for f in factors])
    long = panel.select(date, label, F.posexplode(cells).alias("__f", "value"))
    # a (date, factor) group is no larger than its date, which is cheaper to count
    small = largest_group(panel, [date]) <= rows_per_task(panel.sparkSession)
    ic = daily_ic(long, keys=[date, "__f"], y=label, p="value", small=small)
    names = F.array(*[F.lit(f) for f in factors])
    ic = ic.withColumn("factor", F.element_at(names, F.col("__f") + 1))
    index = date_index(panel, date=date)
    later = index.select((F.col("idx") - VISIBILITY_ROWS).alias("idx"), F.col(date).alias("available_from"))
    known = index.join(later, "idx", "left").select(date, "available_from")
    return ic.join(known, date).select(date, "factor", F.col("ic").alias("rankic"), "available_from")


def filter_history(history: DataFrame, asof, *, inclusive: bool = True, date: str = DATE) -> DataFrame:
    """History visible at a date; by ``available_from`` if the table has it and ``date`` names it."""
    day = F.to_date(F.lit(asof)) if isinstance(asof, str) else F.lit(asof)
    return history.where(F.col(date) <= day if inclusive else F.col(date) < day)


def _score(aggregate: str, mean, mean_abs):
    if aggregate not in ("abs_mean", "mean_abs"):
        raise ValueError(f"unknown aggregate {aggregate}")
    return F.abs(mean) if aggregate == "abs_mean" else mean_abs


def factor_scores(history: DataFrame, aggregate: str = "abs_mean") -> DataFrame:
    """Score and day count per factor."""
    ic = F.col("rankic")
    rows = history.where(ic.isNotNull())
    return rows.groupBy("factor").agg(
        _score(aggregate, F.avg(ic), F.avg(F.abs(ic))).alias("score"), F.count(ic).alias("n_days"))


def select_by_history(history: DataFrame, asof, *, threshold: float = 0.03, aggregate: str = "abs_mean",
                      inclusive: bool = True, min_days: int = 1, pool: Sequence[str] | None = None,
                      date: str = DATE) -> DataFrame:
    """Factors whose score up to one date reaches the threshold, best first."""
    seen = filter_history(history, asof, inclusive=inclusive, date=date)
    if pool is not None:
        seen = seen.where(F.col("factor").isin(list(pool)))
    return _placed(factor_scores(seen, aggregate).where(
        (F.round("score", 12) >= threshold) & (F.col("n_days") >= min_days)), [])


def _placed(picked: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Position by score to twelve digits, then name. A group holds one row per factor."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(F.round(score, 12).desc(), "factor")
    return picked.withColumn("position", F.row_number().over(w).cast("long"))


def select_by_history_many(history: DataFrame, asofs: DataFrame, *, threshold: float = 0.03,
                           aggregate: str = "abs_mean", inclusive: bool = True, min_days: int = 1,
                           pool: Sequence[str] | None = None, date: str = DATE) -> DataFrame:
    """The same choice for every row of ``asofs(asof)`` in one pass.

    Running means per factor are computed once; each running row is valid until
    the factor's next row, and the as-of dates pick rows by an equality join on
    the date position, so history is not repeated per as-of date.
    """
    if pool is not None:
        history = history.where(F.col("factor").isin(list(pool)))
    wanted = asofs.select("asof").distinct()
    rows = history.where(F.col("rankic").isNotNull()).select(F.col(date).alias("date"), "factor", "rankic")
    index = date_index(rows.select("date").unionByName(wanted.select(F.col("asof").alias("date"))))
    w = Window.partitionBy("factor").orderBy("date")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    running = rows.join(index, "date").select(
        "factor", "idx",
        _score(aggregate, F.avg("rankic").over(sofar), F.avg(F.abs("rankic")).over(sofar)).alias("score"),
        F.count("rankic").over(sofar).alias("n_days"), F.lead("idx").over(w).alias("next"))
    last = index.count() - 1
    shift = 0 if inclusive else 1
    # a row answers the as-of positions [idx, next) when inclusive, (idx, next] when strict
    lo = F.col("idx") + shift
    hi = F.coalesce(F.col("next") - 1 + shift, F.lit(last))
    valid = running.where(lo <= hi).select("factor", "score", "n_days", F.explode(F.sequence(lo, hi)).alias("idx"))
    at = wanted.join(index.withColumnRenamed("date", "asof"), "asof")
    picked = valid.join(at, "idx").where((F.round("score", 12) >= threshold) & (F.col("n_days") >= min_days))
    return _placed(picked.select("asof", "factor", "score", "n_days"), ["asof"])


def select_by_day(history: DataFrame, days: DataFrame, *, threshold: float = 0.03, min_selected: int = 0,
                  pool: Sequence[str] | None = None, date: str = DATE) -> DataFrame:
    """Factors whose absolute IC on the as-of day reaches the threshold; with too few
    of them, the ``min_selected`` best of the day."""
    rows = history.where(F.col("rankic").isNotNull())
    if pool is not None:
        rows = rows.where(F.col("factor").isin(list(pool)))
    day = rows.join(days.select(F.col("asof").alias(date)).distinct(), date)
    scored = day.select(F.col(date).alias("asof"), "factor", F.abs("rankic").alias("score"))
    scored = _placed(scored, ["asof"])
    passed = F.count_if(F.round("score", 12) >= threshold).over(Window.partitionBy("asof"))
    keep = F.greatest(F.col("__passed"), F.lit(min_selected))
    return scored.withColumn("__passed", passed).where(F.col("position") <= keep).drop("__passed")


def select_by_flags(flags: DataFrame, days: DataFrame, *, pool: Sequence[str] | None = None, check: bool = True,
                    date: str = DATE) -> DataFrame:
    """Factors flagged on the as-of day. A day without flags is an error when ``check``."""
    wanted = days.select("asof").distinct()
    rows = flags.where(F.col("flag") > 0)
    if pool is not None:
        rows = rows.where(F.col("factor").isin(list(pool)))
    picked = wanted.join(rows.withColumnRenamed(date, "asof"), "asof")
    if check:
        empty = wanted.join(picked.select("asof").distinct(), "asof", "left_anti").limit(5).collect()
        if empty:
            raise ValueError(f"no flagged factor on {[str(r[0]) for r in empty]}")
    w = Window.partitionBy("asof").orderBy("factor")
    return picked.select("asof", "factor", F.row_number().over(w).cast("long").alias("position"))


def union_factors(selection: DataFrame) -> DataFrame:
    """Factors over all as-of dates in first-seen order."""
    first = selection.groupBy("factor").agg(F.min(F.struct("asof", "position")).alias("__f"))
    # one row per factor
    w = Window.orderBy("__f.asof", "__f.position", "factor")
    return first.select("factor", F.col("__f.asof").alias("first_asof"),
                        F.row_number().over(w).cast("long").alias("position"))


def plan_columns(selection: DataFrame, pool: Sequence[str]) -> list[str]:
    """Columns worth scanning: the union of all selected factors, else the base pool."""
    rows = union_factors(selection).orderBy("position").select("factor").collect()  # one row per factor
    return [r[0] for r in rows] or list(pool)


def scope_selection(selection: DataFrame, windows: DataFrame, *, pool: Sequence[str], scope: str = "shared",
                    anchors: tuple[str, str] = ("train_end", "future_start"),
                    empty_policy: str = "fallback_base_pool") -> DataFrame:
    """Table ``(window_id, stage, factor, position)`` for the stages ``eval`` and ``future``.

    ``shared`` uses the set of the first anchor for both stages, ``separate`` one
    set per anchor. A stage with an empty set takes the base pool or is left out.
    """
    if scope not in ("shared", "separate"):
        raise ValueError(f"unknown scope {scope}")
    if empty_policy not in ("fallback_base_pool", "skip"):
        raise ValueError(f"unknown empty policy {empty_policy}")
    future_anchor = anchors[0] if scope == "shared" else anchors[1]
    stages = union_all([
        windows.select("window_id", F.lit("eval").alias("stage"), F.col(anchors[0]).alias("asof")),
        windows.select("window_id", F.lit("future").alias("stage"), F.col(future_anchor).alias("asof"))])
    chosen = stages.join(selection.select("asof", "factor", "position"), "asof").drop("asof")
    if empty_policy == "skip":
        return chosen.select("window_id", "stage", "factor", "position")
    bare = stages.join(chosen.select("window_id", "stage").distinct(), ["window_id", "stage"], "left_anti")
    base = F.array(*[F.lit(f) for f in pool])
    fallback = bare.select("window_id", "stage", F.posexplode(base).alias("__p", "factor")).withColumn(
        "position", (F.col("__p") + 1).cast("long"))
    return chosen.unionByName(fallback.drop("__p")).select("window_id", "stage", "factor", "position")


def scope_anchors(windows: DataFrame, anchors: Sequence[str]) -> DataFrame:
    return union_all([windows.select(F.col(a).alias("asof")) for a in anchors]).distinct()


def selection_counts(history: DataFrame, asof, *, threshold: float = 0.03, min_days: int = 1,
                     aggregate: str = "abs_mean", date: str = DATE) -> DataFrame:
    """One row of counts: history rows, factors seen, factors selected."""
    seen = filter_history(history, asof, date=date)
    scores = seen.groupBy("factor").agg(
        F.count(F.lit(1)).alias("rows"), F.count("rankic").alias("n_days"),
        _score(aggregate, F.avg("rankic"), F.avg(F.abs("rankic"))).alias("score"))
    ok = (F.round("score", 12) >= threshold) & (F.col("n_days") >= min_days)
    return scores.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_hist_rows"),
        F.count_if(F.col("n_days") > 0).alias("n_factors_seen"), F.count_if(ok).alias("n_selected"))


def restrict_history(history: DataFrame, members: DataFrame) -> DataFrame:
    return filter_members(history, members, ["factor"])


def write_selection(selection: DataFrame, path: str) -> None:
    selection.write.mode("overwrite").json(path)
