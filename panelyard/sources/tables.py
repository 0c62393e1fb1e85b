"""Side tables: masks, use flags, IC history, predictions, metric files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.plans.skew import keep_latest
from panelyard.schema import DATE, STOCK, as_date, require_columns


def _csv_with_position(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows as text with their place in the file (block offset, then row in block)."""
    df = spark.read.option("header", True).csv(path)
    return df.select("*", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")).alias("__at"))


def _flag(c: str) -> Column:
    """A mask cell as a number, in any spelling (1, 1.0); text that is no number is an error, an empty cell is NULL."""
    text, number = F.trim(F.col(c).cast("string")), F.trim(F.col(c).cast("string")).try_cast("double")
    bad = number.isNull() & (F.coalesce(text, F.lit("")) != "")
    return F.when(bad, F.raise_error(F.concat(F.lit(f"bad value in mask column {c}: "), text)).cast("double")).otherwise(number)


def read_feature_mask(spark: SparkSession, path: str, *, feature: str = "feature", use: str = "use") -> DataFrame:
    """Selected features in file order: rows ``feature,use`` with use = 1, or one row of 0/1 per feature."""
    df = _csv_with_position(spark, path)
    if feature in df.columns and use in df.columns:
        rows = df.select(F.col(feature).alias("feature"), _flag(use).alias("use"), "__at")
        kept = rows.where("use = 1").groupBy("feature").agg(F.min("__at").alias("__at"))
    else:
        names = [c for c in df.columns if c != "__at"]
        if not names:
            raise ValueError("empty mask file")
        cells = df.select(*[_flag(c).alias(c) for c in names], "__at")
        first = cells.agg(F.min_by(F.struct(*names), "__at").alias("r")).select("r.*")
        place = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
        kept = first.unpivot([], names, "feature", "use").where("use = 1").withColumn("__at", place[F.col("feature")])
    # one row per feature name
    w = Window.orderBy("__at")
    return kept.select("feature", F.row_number().over(w).cast("long").alias("position"))


def read_use_flags(spark: SparkSession, path: str, *, date: str = DATE) -> DataFrame:
    """Use-flag CSV as ``(date, factor, flag)``: a bad date is an error, the last row of a
    date wins, text that is no number counts as 0."""
    df = _csv_with_position(spark, path)
    require_columns(df, [date])
    parsed = F.try_to_date(F.col(date))
    strict = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("bad date in flags: "), F.coalesce(F.col(date), F.lit("NULL"))))
                    ).otherwise(parsed)
    factors = [c for c in df.columns if c not in (date, "__at")]
    cells = df.select(strict.cast("date").alias(date), "__at",
                      *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in factors])
    latest = keep_latest(cells, [date], ["__at"])
    return latest.unpivot([date], factors, "factor", "flag")


def read_ic_history(spark: SparkSession, path: str, *, date: str = DATE) -> DataFrame:
    """IC history parquet as ``(date, factor, rankic)`` with coerced types."""
    df = spark.read.parquet(path)
    require_columns(df, [date, "factor", "rankic"])
    ic = F.col("rankic").try_cast("double")
    extra = [c for c in ("available_from",) if c in df.columns]
    return as_date(df, date).select(date, F.col("factor").cast("string").alias("factor"),
                                    F.when(~F.isnan(ic), ic).alias("rankic"), *extra)


def read_predictions(spark: SparkSession, path: str, *, required: Sequence[str] = ("y_true", "y_pred"),
                     parts: Sequence[str] | None = None, folds: Sequence[int] | None = None,
                     steps: tuple[int | None, int | None] = (None, None), date: str = DATE) -> DataFrame:
    """Prediction folder as one table with ``source_file``; filters prune the part and fold folders.

    Files whose schema lacks a required column are left out, rows with a NULL in
    it stay; a missing part is ``test``; a filter on a column that no file has is
    ignored; an empty result is an error.
    """
    df = spark.read.option("mergeSchema", True).parquet(path)
    require_columns(df, required)
    df = df.select("*", F.col("_metadata.file_path").alias("source_file"))
    files = [f for f in df.inputFiles() if f.endswith(".parquet")]
    lacking = [f for f in files if not set(required) <= set(spark.read.option("basePath", path).parquet(f).columns)]
    if lacking:
        bare = "^file:/+"  # local paths are spelt with one or three slashes
        df = df.where(~F.regexp_replace("source_file", bare, "/").isin([re.sub(bare, "/", f) for f in lacking]))
    df = df.withColumn("part", F.coalesce(F.col("part"), F.lit("test")) if "part" in df.columns else F.lit("test"))
    if parts is not None:
        df = df.where(F.col("part").isin(list(parts)))
    if folds is not None and "fold" in df.columns:
        df = df.where(F.col("fold").isin(list(folds)))
    lo, hi = steps if "step_id" in df.columns else (None, None)
    if lo is not None:
        df = df.where(F.col("step_id") >= lo)
    if hi is not None:
        df = df.where(F.col("step_id") <= hi)
    if date in df.columns:
        df = as_date(df, date)
    if df.isEmpty():
        raise FileNotFoundError(f"no predictions under {path} match the filters")
    return df


def read_factor_predictions(spark: SparkSession, path: str, *, value: str = "y_pred",
                            parts: Sequence[str] | None = None, date: str = DATE, stock: str = STOCK) -> DataFrame:
    """Predictions as factor values: date, stock and value, with fold and file for stitching."""
    df = read_predictions(spark, path, required=[value], parts=parts, date=date)
    require_columns(df, [date, stock])
    return df.select(date, stock, value, *[c for c in ("part", "fold") if c in df.columns], "source_file")


def write_predictions(df: DataFrame, path: str, *, parts: Sequence[str] | None = None) -> None:
    """Save predictions by part and fold; a rerun replaces only the folders it writes."""
    rows = df if parts is None else df.where(F.col("part").isin(list(parts)))
    # range partitions: few folders per task, several tasks for a crowded folder
    rows = rows.repartitionByRange("part", "fold", *[c for c in (DATE, STOCK) if c in df.columns])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "fold").parquet(path)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """Metric rows (one per part) as a single CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
