"""Projections, row and column filters, wide/long reshapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.plans.skew import attach
from panelyard.schema import DATE, LABEL, MASK_SUFFIX, STOCK, as_date, finite, infer_features, require_columns


def basic_fix(df: DataFrame, *, date: str = DATE) -> DataFrame:
    """Coerce the date, drop rows without one, turn NaN and infinities into NULL."""
    df = as_date(df, date)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    fixed = [finite(c).alias(c) if c in floats else F.col(c) for c in df.columns]
    return df.select(*fixed).where(F.col(date).isNotNull())


def cast_float32(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Narrow storage cast, for use right before a write."""
    chosen = set(columns)
    return df.select(*[F.col(c).cast("float").alias(c) if c in chosen else F.col(c) for c in df.columns])


def drop_missing_label(df: DataFrame, label: str = LABEL) -> tuple[DataFrame, Observation]:
    """Drop unlabelled rows; the observation holds ``rows`` and ``dropped`` after the first action."""
    seen = Observation()
    watched = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label).isNull()).alias("dropped"))
    return watched.where(F.col(label).isNotNull()), seen


def missing_ratios(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of missing cells per column, in one aggregate."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]).first()
    return {c: row[c] or 0.0 for c in columns}


def drop_sparse_columns(
    df: DataFrame, columns: Sequence[str], threshold: float, *, fit_until: object | None = None, date: str = DATE,
) -> tuple[DataFrame, list[str]]:
    """Drop columns missing in more than ``threshold`` of the rows (of dates up to
    ``fit_until``, when given, so that later dates cannot decide)."""
    if threshold >= 1.0 or not columns:
        return df, []
    seen = df if fit_until is None else df.where(F.col(date) <= F.lit(fit_until))
    dropped = [c for c, ratio in missing_ratios(seen, columns).items() if ratio > threshold]
    return df.drop(*dropped), dropped


def missing_share(columns: Sequence[str]) -> Column:
    """Share of missing features in a row; an array keeps wide panels in one expression."""
    flags = F.array(*[F.col(c).isNull().cast("int") for c in columns])
    return F.aggregate(flags, F.lit(0), lambda a, x: a + x) / F.lit(float(len(columns)))


def drop_sparse_rows(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    if threshold >= 1.0 or not columns:
        return df
    return df.where(missing_share(columns) <= threshold)


def add_missing_masks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0/1 indicator per column, taken before any filling."""
    return df.select("*", *[F.col(c).isNull().cast("float").alias(c + MASK_SUFFIX) for c in columns])


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (DATE, STOCK)) -> DataFrame:
    """Exactly ``keep`` + ``features`` in order; absent features become missing."""
    have = set(df.columns)
    cells = [F.col(c).cast("double").alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in features]
    return df.select(*[c for c in keep if c in have], *cells)


def assemble(
    df: DataFrame, features: Sequence[str], *, keys: Sequence[str] = (DATE, STOCK), label: str | None = LABEL,
    weight: str | None = None, out: str = "features",
) -> DataFrame:
    """Keys, label, optional weight and one feature vector. Missing cells are an error."""
    extra = [c for c in (label, weight) if c and c in df.columns]
    built = VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)
    return built.select(*keys, *extra, out)


def samples_2d(df: DataFrame, *, label: str = LABEL, weight: str | None = None,
               features: Sequence[str] | None = None) -> DataFrame:
    """Plain-column form of the model sample: keys, label, features, weight."""
    require_columns(df, [DATE, STOCK, label])
    chosen = list(features) if features else infer_features(df, label=label, exclude=[weight] if weight else [])
    return df.select(DATE, STOCK, label, *[F.col(c).cast("double").alias(c) for c in chosen],
                     *([weight] if weight else []))


def wide_to_long(
    fields: Mapping[str, DataFrame], *, date: str = DATE, stock: str = STOCK, label: str | None = None,
    stock_type: str = "string",
) -> DataFrame:
    """One matrix per field (date + a column per stock) to one long panel.

    Cells stay even when missing; fields align by an outer merge and the label
    field, if named, is attached by left join.
    """
    def long(name: str, df: DataFrame) -> DataFrame:
        df = as_date(df, date).where(F.col(date).isNotNull())
        ids = [c for c in df.columns if c != date]
        cells = df.select(date, *[F.col(c).cast("double").alias(c) for c in ids])
        return cells.unpivot(date, ids, stock, name).withColumn(stock, F.col(stock).cast(stock_type))

    names = [n for n in fields if n != label]
    if not names:
        raise ValueError("wide_to_long needs at least one field")
    from panelyard.operators.joins import merge_parts

    out = merge_parts([long(name, fields[name]) for name in names], how="outer", keys=[date, stock])
    if label is not None:
        out = out.join(long(label, fields[label]), [date, stock], "left")
    return out


def to_matrix(
    df: DataFrame, value: str, *, stocks: Sequence | DataFrame, date: str = DATE, stock: str = STOCK,
) -> DataFrame:
    """Long to date x stock, one column per stock in ``stocks``: a list, or a table with a column ``stock``.

    Duplicate keys raise.
    """
    if isinstance(stocks, DataFrame):  # as many rows as the result has columns
        stocks = sorted(r[0] for r in stocks.select(stock).distinct().collect() if r[0] is not None)
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate (date, stock) in matrix"))).otherwise(
        F.max(value))
    # collapse per key before the pivot: map-side, and it is where duplicates show
    cells = df.groupBy(date, stock).agg(once.alias("__v"))
    return cells.groupBy(date).pivot(stock, list(stocks)).agg(F.max("__v"))


def jsonify(df: DataFrame) -> DataFrame:
    """Encode struct, map and array columns as JSON text so that any sink can hold them."""
    nested = (T.StructType, T.MapType, T.ArrayType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields])


def filter_dates(df: DataFrame, dates: DataFrame, *, date: str = DATE) -> DataFrame:
    """Rows whose date is in a one-column date table."""
    return attach(df, dates.select(date).distinct(), [date], "left_semi")


def filter_members(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in a member table (dates, factors, parts, folds)."""
    return attach(df, members.select(*on).distinct(), on, "left_semi")
