"""Date folds and walk-forward windows as small tables, and their join to the panel.

The date index has one row per distinct calendar date, so its ordering window
and its joins are bounded by the calendar, not by the panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.plans.skew import attach, union_all
from panelyard.schema import DATE

RATIO_SLACK = 1e-6  # fixed value: how far the ratios may sum from 1
FOLD_PARTS = ("train", "valid", "test")
WINDOW_PARTS = ("train", "test", "future")
ANCHORS = ("train_end", "test_start", "test_end", "future_start")


def distinct_dates(df: DataFrame, *, date: str = DATE) -> DataFrame:
    return df.select(date).where(F.col(date).isNotNull()).distinct()


def date_index(df: DataFrame, *, date: str = DATE) -> DataFrame:
    """Distinct dates with a 0-based position ``idx``."""
    # one row per calendar date: a single ordered partition is enough
    w = Window.orderBy(date)
    return distinct_dates(df, date=date).select(date, (F.row_number().over(w) - 1).cast("long").alias("idx"))


def _check_ratios(train: float, valid: float, test: float) -> None:
    if abs(train + valid + test - 1.0) > RATIO_SLACK:
        raise ValueError("train, valid and test ratios must sum to 1")


def step_length(n: int, *, days: int | None = None, ratio: float | None = None) -> int:
    """Step in dates: given, or a share of all dates, at least 1."""
    if days is None and ratio is None:
        raise ValueError("give step days or a step ratio")
    step = int(days) if days is not None else max(int(n * ratio), 1)
    if step <= 0:
        raise ValueError("step must be positive")
    return step


def _with_dates(spans: DataFrame, index: DataFrame, columns: dict[str, str], date: str) -> DataFrame:
    """Replace positions by dates: one equality join per boundary on the small index."""
    out = spans
    for position, name in columns.items():
        out = out.join(index.select(F.col("idx").alias(position), F.col(date).alias(name)), position)
    return out


def _fold_spans(starts: DataFrame, length: int, train: float, valid: float, embargo: int) -> DataFrame:
    n_train, n_valid = int(length * train), int(length * valid)
    cuts = {"train": (0, n_train), "valid": (n_train, n_train + n_valid), "test": (n_train + n_valid, length)}
    parts = []
    for i, part in enumerate(FOLD_PARTS):
        lo, hi = cuts[part]
        # the embargo drops the last dates before the next part begins
        hi = hi - embargo if part != "test" and hi > lo else hi
        if hi > lo:
            parts.append(starts.select(
                "fold", F.lit(part).alias("part"), (F.col("start") + lo).alias("idx_start"),
                (F.col("start") + hi - 1).alias("idx_end")))
    return union_all(parts)


def rolling_folds(index: DataFrame, *, window_ratio: float = 0.5, min_dates: int = 60, step_days: int | None = None,
                  step_ratio: float | None = None, train: float = 0.7, valid: float = 0.0, test: float = 0.3,
                  embargo: int = 0, date: str = DATE) -> DataFrame:
    """Whole windows of fixed length moved by a fixed step, cut into parts by ratio.

    Returns ``fold, part, date_start, date_end, idx_start, idx_end``; empty parts are left out.
    """
    _check_ratios(train, valid, test)
    n = index.count()
    length = min(max(int(n * window_ratio), min_dates), n)
    if length <= 1:
        raise ValueError("fold window too short")
    step = step_length(n, days=step_days, ratio=step_ratio)
    starts = index.sparkSession.range(0, n - length + 1, step, 1)
    starts = starts.select((F.col("id") / step).cast("long").alias("fold"), F.col("id").alias("start"))
    spans = _fold_spans(starts, length, train, valid, embargo)
    return _with_dates(spans, index, {"idx_start": "date_start", "idx_end": "date_end"}, date).select(
        "fold", "part", "date_start", "date_end", "idx_start", "idx_end")


def holdout_folds(index: DataFrame, *, train: float = 0.7, valid: float = 0.1, test: float = 0.2, embargo: int = 0,
                  date: str = DATE) -> DataFrame:
    """One fold over all dates."""
    _check_ratios(train, valid, test)
    n = index.count()
    if n == 0:
        raise ValueError("no dates")
    start = index.where("idx = 0").select(F.lit(0).cast("long").alias("fold"), F.col("idx").alias("start"))
    spans = _fold_spans(start, n, train, valid, embargo)
    return _with_dates(spans, index, {"idx_start": "date_start", "idx_end": "date_end"}, date).select(
        "fold", "part", "date_start", "date_end", "idx_start", "idx_end")


def make_folds(index: DataFrame, strategy: str = "step_then_ratio", **settings) -> DataFrame:
    if strategy == "step_then_ratio":
        return rolling_folds(index, **settings)
    if strategy == "holdout_ratio":
        return holdout_folds(index, **settings)
    raise ValueError(f"unknown split strategy {strategy}")


def expand_dates(spans: DataFrame, index: DataFrame, keys: list[str], *, date: str = DATE) -> DataFrame:
    """One row per (key, date) of each span: positions are generated, then matched by equality."""
    cells = spans.select(*keys, F.explode(F.sequence("idx_start", "idx_end")).alias("idx"))
    return cells.join(index, "idx").select(*keys, date)


def assign_folds(df: DataFrame, folds: DataFrame, index: DataFrame, *, date: str = DATE) -> DataFrame:
    """Panel rows with ``fold, part``, one copy per fold that covers their date.

    An equality join on the date against the measured membership table: each row
    meets only its own folds, unlike a range comparison with all of them.
    """
    members = expand_dates(folds, index, ["fold", "part"], date=date)
    return attach(df, members, [date], "inner")


def _days(n: int, ratio: float, least: int) -> int:
    if ratio <= 0:
        raise ValueError("ratio must be positive")
    return max(int(n * ratio), int(least))


def refit_windows(index: DataFrame, *, mode: str = "days", train_days: int = 0, test_days: int = 0,
                  future_days: int = 0, step_days: int | None = None, train_ratio: float = 0.0,
                  test_ratio: float = 0.0, future_ratio: float = 0.0, step_ratio: float | None = None,
                  min_train: int = 1, min_test: int = 1, min_future: int = 1, expanding: bool = True,
                  max_train_days: int | None = None, embargo: int = 0, date: str = DATE) -> DataFrame:
    """Train / test / future windows that walk over the dates.

    The test block follows training, the future block follows the test; the walk
    stops where a whole future block no longer fits. One row per window with six
    boundary dates, their positions, and the selection date (end of training).
    """
    n = index.count()
    if mode == "ratio":
        train_days = _days(n, train_ratio, min_train)
        test_days = _days(n, test_ratio, min_test)
        future_days = _days(n, future_ratio, min_future)
        step_days = None if step_ratio is None else _days(n, step_ratio, min_future)
    elif mode != "days":
        raise ValueError(f"unknown window mode {mode}")
    step = future_days if step_days is None else step_days
    if min(train_days, test_days, future_days, step) <= 0:
        raise ValueError("window lengths must be positive")
    if train_days + test_days >= n:
        raise ValueError("train and test leave no date for the future")
    if not expanding and not (max_train_days and max_train_days > 0):
        raise ValueError("a fixed training length needs max_train_days > 0")
    last_start = n - future_days - test_days  # latest position at which the test block may begin
    ids = index.sparkSession.range(train_days, last_start + 1, step, 1)
    test_at = F.col("id")
    train_end = test_at - 1
    train_start = F.lit(0) if expanding else F.greatest(F.lit(0), train_end - max_train_days + 1)
    spans = ids.select(
        ((test_at - train_days) / step).cast("long").alias("window_id"),
        train_start.cast("long").alias("train_start_idx"), (train_end - embargo).alias("train_end_idx"),
        test_at.alias("test_start_idx"), (test_at + test_days - 1).alias("test_end_idx"),
        (test_at + test_days).alias("future_start_idx"),
        (test_at + test_days + future_days - 1).alias("future_end_idx"))
    ends = [f"{p}_{e}" for p in WINDOW_PARTS for e in ("start", "end")]
    out = _with_dates(spans, index, {f"{e}_idx": e for e in ends}, date)
    return out.select("window_id", *ends, F.col("train_end").alias("factor_selection_asof_date"),
                      *[f"{e}_idx" for e in ends])


def window_spans(windows: DataFrame) -> DataFrame:
    """Windows in fold form: ``fold, part, idx_start, idx_end``."""
    return union_all([
        windows.select(F.col("window_id").alias("fold"), F.lit(p).alias("part"),
                       F.col(f"{p}_start").alias("date_start"), F.col(f"{p}_end").alias("date_end"),
                       F.col(f"{p}_start_idx").alias("idx_start"), F.col(f"{p}_end_idx").alias("idx_end"))
        for p in WINDOW_PARTS])


def anchor_dates(windows: DataFrame, anchor: str = "train_end") -> DataFrame:
    """The date of each window at which factors are chosen."""
    if anchor not in ANCHORS:
        raise ValueError(f"unknown anchor {anchor}")
    return windows.select("window_id", F.col(anchor).alias("asof"))
