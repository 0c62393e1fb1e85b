"""Written intermediate tables in the shared checkpoint folder.

A staged table cuts the lineage, survives the loss of executors, and fixes
values such as partition numbers that must not change between two reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """Shared folder from ``spark.checkpoint.dir``, else a folder of the warehouse, which executors share as well."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/staged").rstrip("/")


def release(spark: SparkSession) -> None:
    """Delete the tables this session has staged; frames that read them can no longer be used."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


_STAGED: dict[str, list[str]] = {}


def stage_path(spark: SparkSession, name: str = "table") -> str:
    path = f"{stage_root(spark)}/panelyard/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet and return the scan of it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
