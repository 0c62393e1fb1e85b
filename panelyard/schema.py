"""Column roles of a panel: keys, label, features. Decided on the driver from the schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: names shared with the panel files
DATE = "date"
STOCK = "stockid"
LABEL = "y"
RAW_SUFFIX = "_raw"
MASK_SUFFIX = "__miss"


def infer_features(
    df: DataFrame, *, date: str = DATE, stock: str = STOCK, label: str | None = LABEL, exclude: Iterable[str] = (),
) -> list[str]:
    """Numeric and boolean columns that are neither key, label, raw label nor excluded."""
    skip = {date, stock, *exclude}
    if label:
        skip |= {label, label + RAW_SUFFIX}
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def base_columns(columns: Sequence[str], state_columns: Sequence[str] | None = None) -> list[str]:
    """Columns before masks were added: from the saved state, else by name."""
    return list(state_columns) if state_columns else [c for c in columns if not c.endswith(MASK_SUFFIX)]


def filter_by_mask(requested: Sequence[str], selected: Iterable[str]) -> list[str]:
    """Requested fields that the mask keeps, in request order."""
    keep = set(selected)
    return [c for c in requested if c in keep]


def rename_label(df: DataFrame, label: str = LABEL, candidates: Sequence[str] = ()) -> DataFrame:
    """Give the first present candidate column the label name; no-op if it exists."""
    if label in df.columns:
        return df
    source = next((c for c in candidates if c in df.columns), None)
    return df if source is None else df.withColumnRenamed(source, label)


def as_date(df: DataFrame, column: str) -> DataFrame:
    """Coerce a key column to DATE; text that is no date becomes NULL."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return df
    parsed = F.try_to_date(F.col(column)) if isinstance(kind, T.StringType) else F.col(column).cast("date")
    return df.withColumn(column, parsed)


def finite(c: str):
    """A numeric column as DOUBLE with NaN and infinities turned into NULL."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"missing columns: {absent}")
