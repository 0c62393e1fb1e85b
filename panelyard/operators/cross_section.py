"""Per-date and global feature statistics: fill values, winsorize, z-scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators.label import clip_column
from panelyard.plans.skew import attach, largest_group, quantile_table, rows_per_task
from panelyard.schema import DATE

ROBUST_SCALE = 0.6745  # fixed value: MAD to standard deviation
# above this many columns one aggregate or projection per column outgrows the JIT;
# statistics then go by (date, column number) and come back as one array per date
WIDE_COLUMNS = 32


def _cells(cols):
    return F.array(*[F.col(c).cast("double") for c in cols])


def _exploded_stats(rows: DataFrame, date: str, cells, stat) -> DataFrame:
    """``stat`` of each array element per date, packed in column order as ``__st``."""
    long = rows.select(date, F.posexplode(cells).alias("__f", "__v"))
    stats = long.groupBy(date, "__f").agg(stat.alias("__s"))
    # every date has every column number, so the sorted list lines up with the cells
    packed = F.transform(F.sort_array(F.collect_list(F.struct("__f", "__s"))), lambda x: x["__s"])
    return stats.groupBy(date).agg(packed.alias("__st"))


def _spread(rows: DataFrame, source: DataFrame, cols, array) -> DataFrame:
    """Put the array's elements back under the column names, in the column order of ``source``."""
    place = {c: i for i, c in enumerate(cols)}
    done = rows.select(*[c for c in source.columns if c not in place], array.alias("__z"))
    return done.select(*[F.col("__z")[place[c]].alias(c) if c in place else F.col(c) for c in source.columns])


def _go_wide(df: DataFrame, cols: Sequence[str], date: str) -> bool:
    """Many columns, and no date too large for the exact percentile aggregate."""
    return len(cols) > WIDE_COLUMNS and largest_group(df, [date]) <= rows_per_task(df.sparkSession)


def _percentile_struct(probs: Sequence[float]):
    q = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs]))
    return F.struct(*[q[i].alias(f"q{i}") for i in range(len(probs))])


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def column_std(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> dict[str, float | None]:
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[std(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact global quantiles, one short list per column."""
    row = quantile_table(df, [], cols, probs).first()
    return {c: (row[c] or [None] * len(probs)) for c in cols}


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in column_quantiles(df, cols, [0.5]).items()}


def column_mad(df: DataFrame, cols: Sequence[str], medians: Mapping[str, float | None]) -> dict[str, float | None]:
    """Median absolute deviation: a second pass around the known medians."""
    off = df.select(*[F.abs(F.col(c).cast("double") - F.lit(medians[c])).alias(c) for c in cols])
    return column_medians(off, cols)


def fill_values(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    known = {c: v for c, v in values.items() if v is not None}
    return df.select(*[
        F.coalesce(F.col(c), F.lit(known[c])).alias(c) if c in known else F.col(c) for c in df.columns])


def winsorize_by_date(df: DataFrame, cols: Sequence[str], *, lower: float = 0.01, upper: float = 0.99,
                      date: str = DATE) -> DataFrame:
    """Clip each feature to its quantiles of the date."""
    if _go_wide(df, cols, date):
        rows = attach(df, _exploded_stats(df, date, _cells(cols), _percentile_struct([lower, upper])), [date])
        return _spread(rows, df, cols, F.zip_with(
            _cells(cols), "__st", lambda x, q: clip_column(x, q["q0"], q["q1"])))
    q = quantile_table(df, [date], cols, [lower, upper])
    q = q.select(date, *[F.col(c).alias(f"__q_{c}") for c in cols])
    chosen = set(cols)
    return attach(df, q, [date]).select(*[
        clip_column(F.col(c), F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]).alias(c) if c in chosen else F.col(c)
        for c in df.columns])


def winsorize_global(df: DataFrame, bounds: Mapping[str, Sequence[float | None]]) -> DataFrame:
    """Clip to known bounds ``{column: (lo, hi)}``."""
    return df.select(*[
        clip_column(F.col(c), F.lit(bounds[c][0]), F.lit(bounds[c][1])).alias(c) if c in bounds else F.col(c)
        for c in df.columns])


def _clipped(z, clip):
    return z if clip is None else F.greatest(F.least(z, F.lit(float(clip))), F.lit(-float(clip)))


def zscore_by_date(df: DataFrame, cols: Sequence[str], *, ddof: int = 0, clip: float | None = None,
                   date: str = DATE) -> DataFrame:
    """Standard score within the date; constant or missing cells become 0."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    if len(cols) > WIDE_COLUMNS:
        stat = F.struct(F.avg("__v").alias("m"), std("__v").alias("s"))
        rows = attach(df, _exploded_stats(df, date, _cells(cols), stat), [date])
        return _spread(rows, df, cols, F.zip_with(_cells(cols), "__st", lambda x, q: _clipped(
            F.coalesce((x - q["m"]) / F.nullif(q["s"], F.lit(0.0)), F.lit(0.0)), clip)))
    stats = df.groupBy(date).agg(*[s for c in cols for s in (
        F.avg(c).alias(f"__mu_{c}"), std(c).alias(f"__sd_{c}"))])
    chosen = set(cols)

    def cell(c):
        z = (F.col(c) - F.col(f"__mu_{c}")) / F.nullif(F.col(f"__sd_{c}"), F.lit(0.0))
        return _clipped(F.coalesce(z, F.lit(0.0)), clip).alias(c)

    return attach(df, stats, [date]).select(*[cell(c) if c in chosen else F.col(c) for c in df.columns])


def robust_zscore_by_date(df: DataFrame, cols: Sequence[str], *, eps: float = 1e-12, scaled: bool = False,
                          clip: float | None = None, date: str = DATE) -> DataFrame:
    """(x - median) / (MAD + eps) within the date, in two quantile passes."""
    scale = ROBUST_SCALE if scaled else 1.0
    if _go_wide(df, cols, date):
        half = _percentile_struct([0.5])
        rows = attach(df, _exploded_stats(df, date, _cells(cols), half), [date]).withColumnRenamed("__st", "__md")
        off = F.zip_with(_cells(cols), "__md", lambda x, q: F.abs(x - q["q0"]))
        rows = attach(rows, _exploded_stats(rows, date, off, half), [date])
        centred = F.zip_with(_cells(cols), "__md", lambda x, q: x - q["q0"])
        return _spread(rows, df, cols, F.zip_with(centred, "__st", lambda x, q: _clipped(
            F.coalesce(x / (q["q0"] + F.lit(eps)) * F.lit(scale), F.lit(0.0)), clip)))
    med = quantile_table(df, [date], cols, [0.5]).select(date, *[F.col(c)[0].alias(f"__m_{c}") for c in cols])
    centred = attach(df, med, [date])
    off = centred.select(date, *[F.abs(F.col(c).cast("double") - F.col(f"__m_{c}")).alias(c) for c in cols])
    mad = quantile_table(off, [date], cols, [0.5]).select(date, *[F.col(c)[0].alias(f"__d_{c}") for c in cols])
    chosen = set(cols)

    def cell(c):
        z = (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__d_{c}") + F.lit(eps)) * F.lit(scale)
        return _clipped(F.coalesce(z, F.lit(0.0)), clip).alias(c)

    return attach(centred, mad, [date]).select(*[cell(c) if c in chosen else F.col(c) for c in df.columns])


def zscore_global(df: DataFrame, centre: Mapping[str, float | None], spread: Mapping[str, float | None], *,
                  clip: float | None = None, eps: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Score with known statistics; a zero or unknown spread gives 0."""
    def cell(c):
        d = spread[c]
        if d is None or centre[c] is None or d + eps == 0.0:
            return F.lit(0.0).alias(c)
        z = (F.col(c) - F.lit(centre[c])) / F.lit(d + eps) * F.lit(scale)
        return _clipped(F.coalesce(z, F.lit(0.0)), clip).alias(c)

    return df.select(*[cell(c) if c in centre else F.col(c) for c in df.columns])
