"""Panel scans and sinks: long, column-chunked, wide, date slices, cross-sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.operators.folds import distinct_dates
from panelyard.operators.joins import merge_parts, validate_long
from panelyard.operators.label import forward_return, postprocess_label
from panelyard.operators.reshape import basic_fix, wide_to_long
from panelyard.plans.skew import attach
from panelyard.plans.stage import stage
from panelyard.schema import DATE, LABEL, RAW_SUFFIX, STOCK, filter_by_mask, infer_features, rename_label


def _day(value):
    return F.to_date(F.lit(value)) if isinstance(value, str) else F.lit(value)


def _between(column, kind, start, end):
    """Inclusive date range on the stored column, in the form the scan can push down."""
    lo, hi = (None if v is None else _day(v) for v in (start, end))
    if not isinstance(kind, T.DateType):
        hi = None if hi is None else F.date_add(hi, 1)
    conds = []
    if lo is not None:
        conds.append(column >= lo)
    if hi is not None:
        conds.append(column <= hi if isinstance(kind, T.DateType) else column < hi)
    return conds


def scan_long(spark: SparkSession, path: str, columns: Sequence[str] | None = None, *, start=None, end=None,
              date: str = DATE) -> DataFrame:
    """Chosen columns of a long parquet panel in an inclusive date range.

    The range reaches the scan as a pushed filter (a partition filter on a
    date-partitioned panel) and is applied once more after coercing the date.
    """
    df = spark.read.parquet(path)
    if columns is not None:
        df = df.select(*columns)
    kind = df.schema[date].dataType
    if not isinstance(kind, T.StringType):
        for cond in _between(F.col(date), kind, start, end):
            df = df.where(cond)
        return basic_fix(df, date=date)
    df = basic_fix(df, date=date)
    for cond in _between(F.col(date), T.DateType(), start, end):
        df = df.where(cond)
    return df


def _finish(df: DataFrame, fields: Sequence[str], label: str | None, price: str | None, log_return: bool,
            post: dict | None, date: str, stock: str, validate: bool) -> DataFrame:
    """Label, post-process, project to (date, stock, label, raw label, fields) and validate.

    Building and ranking the label needs windows over stocks and dates. They run
    on a narrow (date, stock, price or label) table that joins the features once
    by key, so the feature columns are shuffled once however many steps there are.
    """
    if validate:
        validate_long(df, keys=[date, stock])
    build = bool(label and label not in df.columns and price)
    if label and (build or (post is not None and label in df.columns)):
        narrow = df.select(date, stock, price if build else label)
        if build:
            narrow = forward_return(narrow, price, label=label, log=log_return, date=date, stock=stock).select(
                date, stock, label)
        if post is not None:
            narrow = postprocess_label(stage(narrow, "label"), label=label, date=date, **post)
        wide = df.select(date, stock, *[c for c in fields if c not in (label, label + RAW_SUFFIX)])
        df = merge_parts([narrow, wide], how="inner", keys=[date, stock])
    lead = [c for c in (label, (label or "") + RAW_SUFFIX) if c and c in df.columns]
    return df.select(date, stock, *lead, *[c for c in fields if c not in lead])


def load_panel(spark: SparkSession, path: str, fields: Sequence[str] | None = None, *, mask: Sequence[str] | None = None,
               start=None, end=None, label: str | None = LABEL, label_candidates: Sequence[str] = (),
               price: str | None = None, log_return: bool = False, post: dict | None = None, date: str = DATE,
               stock: str = STOCK, validate: bool = True) -> DataFrame:
    """One-file load: mask fields, scan, rename or build the label, post-process, project, validate.

    Inferred fields never include the price or the label candidates.
    """
    names = spark.read.parquet(path)
    if fields is None:
        skip = [c for c in (price, *label_candidates) if c]
        fields = infer_features(names, date=date, stock=stock, label=label, exclude=skip)
    if mask is not None:
        fields = filter_by_mask(fields, mask)
    extra = [c for c in (label, price, *label_candidates) if c and c in names.columns]
    columns = list(dict.fromkeys([date, stock, *extra, *fields]))
    df = scan_long(spark, path, columns, start=start, end=end, date=date)
    if label:
        df = rename_label(df, label, label_candidates)
    return _finish(df, fields, label, price, log_return, post, date, stock, validate)


def load_chunks(spark: SparkSession, paths: Sequence[str], fields: Sequence[str] | None = None, *,
                mask: Sequence[str] | None = None, how: str = "inner", start=None, end=None,
                label: str | None = LABEL, label_candidates: Sequence[str] = (), price: str | None = None,
                log_return: bool = False, post: dict | None = None, date: str = DATE, stock: str = STOCK,
                validate: bool = True) -> DataFrame:
    """Column-chunked panel: read from each file only what is wanted, join on the key.

    A later file that would add only keys is not read. The label is built on the
    merged panel, so its row offsets see every date.
    """
    schemas = [spark.read.parquet(p) for p in paths]
    if fields is None:
        skip = [c for c in (price, *label_candidates) if c]
        found = [c for s in schemas for c in infer_features(s, date=date, stock=stock, label=label, exclude=skip)]
        fields = list(dict.fromkeys(found))
    if mask is not None:
        fields = filter_by_mask(fields, mask)
    wanted = list(dict.fromkeys([c for c in (label, price, *label_candidates) if c] + list(fields)))
    parts, have = [], set()
    for i, (path, s) in enumerate(zip(paths, schemas)):
        mine = [c for c in wanted if c in s.columns and c not in have]
        if i and not mine:
            continue
        have |= set(mine)
        parts.append(scan_long(spark, path, [date, stock, *mine], start=start, end=end, date=date))
    absent = [c for c in fields if c not in have]
    if absent:
        raise KeyError(f"fields in no file: {absent}")
    df = merge_parts(parts, how=how, keys=[date, stock])
    if label:
        df = rename_label(df, label, label_candidates)
    return _finish(df, fields, label, price, log_return, post, date, stock, validate)


def _wide_fields(spark, folder, fields, date):
    return {f: spark.read.parquet(f"{folder}/{f}.parquet") for f in fields}


def load_wide(spark: SparkSession, folder: str, fields: Sequence[str], *, start=None, end=None,
              label: str | None = None, price: str | None = None, log_return: bool = False, post: dict | None = None,
              date: str = DATE, stock: str = STOCK, stock_type: str = "string") -> DataFrame:
    """Folder of one matrix per field (date rows, a column per stock), as a long panel."""
    names = list(dict.fromkeys([*fields, *[c for c in (label, price) if c and c not in fields]]))
    built = label is not None and price is not None
    if built:
        names = [n for n in names if n != label]
    tables = {}
    for name, df in _wide_fields(spark, folder, names, date).items():
        df = basic_fix(df, date=date)
        for cond in _between(F.col(date), T.DateType(), start, end):
            df = df.where(cond)
        tables[name] = df
    long = wide_to_long(tables, date=date, stock=stock, label=None if built else label, stock_type=stock_type)
    return _finish(long, fields, label, price, log_return, post, date, stock, False)


def load_cross_section(spark: SparkSession, asof, fields: Sequence[str], *, path: str | None = None,
                       paths: Sequence[str] | None = None, folder: str | None = None, how: str = "inner",
                       date: str = DATE, stock: str = STOCK, stock_type: str = "string") -> DataFrame:
    """Fields of one date from a long file, column chunks, or a wide folder.

    In a wide folder a field without the date still lists its stocks, with
    missing values.
    """
    if path is not None:
        return scan_long(spark, path, [date, stock, *fields], start=asof, end=asof, date=date)
    if paths is not None:
        return load_chunks(spark, paths, fields, how=how, start=asof, end=asof, label=None, date=date, stock=stock)
    if folder is None:
        raise ValueError("give path, paths or folder")
    parts = []
    for name, df in _wide_fields(spark, folder, fields, date).items():
        ids = [c for c in df.columns if c != date]
        day = basic_fix(df, date=date).where(F.col(date) == _day(asof))
        # the stock universe comes from the column names, one map of cells per field
        cells = day.agg(*[F.max(F.col(c).cast("double")).alias(c) for c in ids])
        long = cells.unpivot([], ids, stock, name).withColumn(date, _day(asof))
        parts.append(long.select(date, F.col(stock).cast(stock_type).alias(stock), name))
    return merge_parts(parts, how="outer", keys=[date, stock])


def read_slice(spark: SparkSession, path: str, *, columns: Sequence[str] | None = None, start=None, end=None,
               date: str = DATE) -> DataFrame:
    """Slice of a saved clean panel; on a date-partitioned table only its folders are read."""
    return scan_long(spark, path, columns, start=start, end=end, date=date)


def latest_section(df: DataFrame, *, date: str = DATE) -> DataFrame:
    """Rows of the newest date."""
    newest = df.agg(F.max(date)).first()[0]
    return df.where(F.col(date) == F.lit(newest))


def panel_dates(df: DataFrame, *, date: str = DATE) -> DataFrame:
    return distinct_dates(df, date=date).orderBy(date)


def write_panel(df: DataFrame, path: str, *, by_date: bool = True, date: str = DATE, stock: str = STOCK) -> None:
    """Save a panel for later slicing.

    ``by_date`` lays out one folder per date; range partitioning by (date, stock)
    gives a crowded date several files and sorts each.
    """
    laid = df.repartitionByRange(F.col(date), F.col(stock)).sortWithinPartitions(date, stock)
    writer = laid.write.mode("overwrite")
    (writer.partitionBy(date) if by_date else writer).parquet(path)


def write_samples(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Cache of a projected sample; X, y, keys and weights are read back by column pruning."""
    df.select(*columns).write.mode("overwrite").parquet(path)


def write_folds(assigned: DataFrame, path: str) -> None:
    """One folder per fold and part; later runs read a part by partition pruning."""
    laid = assigned.repartitionByRange("fold", "part", *[c for c in (DATE, STOCK) if c in assigned.columns])
    laid.write.mode("overwrite").partitionBy("fold", "part").parquet(path)


def attach_universe(df: DataFrame, universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attach(universe, df, keys)
