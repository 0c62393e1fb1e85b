"""Incremental scoring of arriving cross-sections.

A batch only tells which dates have arrived: the whole of each such date is read
from the source folder, so statistics see complete cross-sections however the
files of a date fall into batches. Output folders are per date and overwritten,
so a replayed batch leaves the same rows. With a manifest of expected row counts a
date is scored once, by the batch that completes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.operators.model import Bundle
from panelyard.schema import DATE, STOCK


def score_batch(batch: DataFrame, bundle: Bundle, *, date: str = DATE, stock: str = STOCK) -> DataFrame:
    rows = bundle.cleaner.transform(batch) if bundle.cleaner is not None else batch
    return bundle.score(rows, label=None).select(date, stock, "y_pred")


def complete_dates(rows: DataFrame, manifest: DataFrame, *, date: str = DATE) -> DataFrame:
    """Dates of ``rows`` that hold as many rows as the manifest (date, n_rows) expects; others wait, also unlisted ones."""
    counts = rows.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))
    return counts.join(manifest.select(date, "n_rows"), date).where(F.col("__n") >= F.col("n_rows")).select(date)


def score_stream(spark: SparkSession, source: str, schema: T.StructType, bundle: Bundle, sink: str, checkpoint: str, *,
                 manifest: DataFrame | None = None, files_per_batch: int = 100, date: str = DATE, stock: str = STOCK):
    """Start the query; with ``availableNow`` it ends when all present files are scored.

    Of a source with a folder per date, a batch reads the folders of its dates alone.
    """
    arriving = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))

    def write(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        dates = [r[0] for r in batch.select(date).distinct().collect()]  # dates of one batch of files
        whole = session.read.schema(schema).parquet(source)
        if dates and manifest is not None:
            dates = [r[0] for r in complete_dates(whole.where(F.col(date).isin(dates)), manifest, date=date).collect()]
        if not dates:
            return
        scored = score_batch(whole.where(F.col(date).isin(dates)), bundle, date=date, stock=stock)
        (scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(date).parquet(sink))

    return (arriving.where(F.col(date).isNotNull()).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
