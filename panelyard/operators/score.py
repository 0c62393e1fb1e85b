"""Scoring job: one date, or the last saved date, through a saved bundle.

A daily job with rolling features keeps a state: the last rows of every stock, as
arrays. A run reads the state and the folders of the new dates, never the history.
"""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.operators.model import Bundle
from panelyard.operators.rolling import rolling_stats
from panelyard.plans.stage import stage
from panelyard.schema import DATE, STOCK


def with_lookback(panel: DataFrame, asof, rows_back: int, *, date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Rows up to ``asof`` that hold the last ``rows_back`` earlier rows of every stock of that date.

    Rolling features count rows of a stock, not dates, so a stock that was absent
    reaches further back. The first date needed is found on the two key columns
    alone; the panel is then read as one range of dates.
    """
    day = F.to_date(F.lit(asof)) if isinstance(asof, str) else F.lit(asof)
    keys = panel.where(F.col(date) <= day).select(date, stock)
    keys = keys.join(keys.where(F.col(date) == day).select(stock).distinct(), stock, "left_semi")
    newest = Window.partitionBy(stock).orderBy(F.col(date).desc())
    first = keys.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= rows_back + 1).agg(F.min(date)).first()[0]
    return panel.where((F.col(date) <= day) & (F.col(date) >= F.lit(first)))


def score_date(panel: DataFrame, asof, bundle: Bundle, *, rolling: dict | None = None, lookback: int = 0,
               run_id: str = "score", mode: str = "daily", date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Predictions for the cross-section of one date.

    With ``rolling`` (arguments of the rolling feature stage) or a history fill
    the job reads a look-back of earlier dates, so those features match training.
    """
    rows = with_lookback(panel, asof, lookback, date=date, stock=stock) if lookback else panel.where(
        F.col(date) == (F.to_date(F.lit(asof)) if isinstance(asof, str) else F.lit(asof)))
    if rolling is not None:
        rows = rolling_stats(rows, **rolling)
    if bundle.cleaner is not None:
        rows = bundle.cleaner.transform(rows)
    day = F.to_date(F.lit(asof)) if isinstance(asof, str) else F.lit(asof)
    scored = bundle.score(rows.where(F.col(date) == day), label=None)
    return scored.select(date, stock, "y_pred", day.alias("asof_date"), F.lit(run_id).alias("run_id"),
                         F.lit(mode).alias("pred_mode"))


def score_latest(panel: DataFrame, bundle: Bundle, *, date: str = DATE, **kw) -> DataFrame:
    """Predictions for the newest date of a saved panel."""
    newest = panel.agg(F.max(date)).first()[0]
    return score_date(panel, newest, bundle, date=date, mode="last_day", **kw)


# --- state of last rows -------------------------------------------------------------


def _day(value) -> Date:
    return Date.fromisoformat(value) if isinstance(value, str) else value


def last_rows(panel: DataFrame, rows_back: int, *, date: str = DATE, stock: str = STOCK) -> DataFrame:
    """stock, rows: the newest ``rows_back`` rows of every stock, newest first, however far back they lie.

    Rows are numbered per stock and cut before they are gathered, so a stock's
    array never holds more than ``rows_back`` of them. A row without a date or a stock has no place.
    """
    cells = [c for c in panel.columns if c not in (date, stock)]
    newest = Window.partitionBy(stock).orderBy(F.col(date).desc())
    kept = panel.where(F.col(date).isNotNull() & F.col(stock).isNotNull()).withColumn(
        "__k", F.row_number().over(newest)).where(F.col("__k") <= rows_back)
    return kept.groupBy(stock).agg(F.reverse(F.array_sort(F.collect_list(F.struct(date, *cells)))).alias("rows"))


def advance_state(state: DataFrame, fresh: DataFrame, rows_back: int, *, date: str = DATE, stock: str = STOCK) -> DataFrame:
    """The state after some newer dates: stocks of both sides, each with its newest ``rows_back`` rows.

    Both sides are narrow and meet in one full join by stock; stocks without new rows keep theirs.
    """
    new = last_rows(fresh, rows_back, date=date, stock=stock).withColumnRenamed("rows", "__new")
    empty = F.array().cast(state.schema["rows"].dataType)
    rows = F.concat(F.coalesce("__new", empty), F.coalesce("rows", empty))
    return state.join(new, stock, "full").select(stock, F.slice(rows, 1, rows_back).alias("rows"))


def state_rows(state: DataFrame, stocks: DataFrame, *, date: str = DATE, stock: str = STOCK) -> DataFrame:
    """The state's rows of the given stocks, as a panel."""
    held = state.join(stocks.select(stock).distinct(), stock, "left_semi").select(stock, F.explode("rows").alias("__r"))
    cells = [f for f in state.schema["rows"].dataType.elementType.names if f != date]
    return held.select(F.col(f"__r.{date}").alias(date), stock, *[F.col(f"__r.{c}").alias(c) for c in cells])


def saved_states(spark: SparkSession, path: str) -> list[Date]:
    """Dates up to which a state is saved, oldest first: folders that hold the writer's mark of a finished table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    done = [f.getPath() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName().startswith("upto=")]
    return sorted(Date.fromisoformat(p.getName()[5:]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def score_daily(panel: DataFrame, asof, bundle: Bundle, *, rows_back: int, state_path: str, sink: str,
                rolling: dict | None = None, target_date=None, run_id: str = "score", mode: str = "daily",
                date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Score one date with the saved state, write the record and the advanced state; returns the record.

    ``panel`` is best a table with a folder per date: of it a run reads the dates
    after the newest earlier state, up to ``asof``; without an earlier state,
    all dates up to ``asof`` once. The record has the predictions with asof_date,
    target_date (the day they are meant for, may be missing), run_id, pred_mode
    and state_path, in the sink's folder of the date. State and record are
    written to folders of their own date, so a repeated run leaves the same rows.
    """
    spark, day = panel.sparkSession, _day(asof)
    earlier = [d for d in saved_states(spark, state_path) if d < day]
    if earlier:
        state = spark.read.parquet(f"{state_path}/upto={earlier[-1].isoformat()}")
        fresh = panel.where((F.col(date) > F.lit(earlier[-1])) & (F.col(date) <= F.lit(day)))
    else:
        state, fresh = None, panel.where(F.col(date) <= F.lit(day))
    today = panel.where(F.col(date) == F.lit(day))
    before = fresh.where(F.col(date) < F.lit(day))
    if state is None:
        base = last_rows(before, rows_back, date=date, stock=stock)
    else:
        base = advance_state(state, before, rows_back, date=date, stock=stock)
    base = stage(base, "state")
    rows = today
    if rolling is not None:
        rows = rolling_stats(state_rows(base, today, date=date, stock=stock).select(*today.columns).unionByName(today), **rolling)
        rows = rows.where(F.col(date) == F.lit(day))
    if bundle.cleaner is not None:
        rows = bundle.cleaner.transform(rows)
    scored = bundle.score(rows, label=None).select(
        date, stock, "y_pred", F.lit(day).alias("asof_date"), F.lit(None if target_date is None else _day(target_date)).cast("date").alias("target_date"),
        F.lit(run_id).alias("run_id"), F.lit(mode).alias("pred_mode"), F.lit(f"{state_path}/upto={day.isoformat()}").alias("state_path"))
    place = f"{sink}/asof={day.isoformat()}"
    scored.write.mode("overwrite").parquet(place)
    advance_state(base, today, rows_back, date=date, stock=stock).write.mode("overwrite").parquet(f"{state_path}/upto={day.isoformat()}")
    return spark.read.schema(scored.schema).parquet(place)
