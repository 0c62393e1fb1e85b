"""Masks, prediction folders, rank correlation and streamed dates on inputs the tables do not hold."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators.evaluate import daily_ic
from panelyard.operators.select import select_by_day
from panelyard.sources.tables import read_feature_mask, read_predictions


def test_mask_reads_numbers_in_any_spelling(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("feature,use\na,1.0\nb,0.0\nc,1\nd,\n")
    assert [r["feature"] for r in read_feature_mask(spark, str(tmp_path / "rows.csv")).orderBy("position").collect()] == ["a", "c"]
    (tmp_path / "wide.csv").write_text("a,b,c\n1.0,0.0,1\n")
    assert [r["feature"] for r in read_feature_mask(spark, str(tmp_path / "wide.csv")).orderBy("position").collect()] == ["a", "c"]
    (tmp_path / "bad.csv").write_text("feature,use\na,yes\n")
    with pytest.raises(Exception, match="bad value in mask"):
        read_feature_mask(spark, str(tmp_path / "bad.csv")).collect()


def test_predictions_skip_files_by_schema(spark, tmp_path):
    folder = str(tmp_path / "p")
    spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "y_true double, y_pred double").coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(9.0,)], "y_pred double").coalesce(1).write.mode("append").parquet(folder)
    rows = read_predictions(spark, folder, folds=[1], steps=(0, 5))
    assert sorted(r["y_pred"] for r in rows.collect()) == [2.0, 3.0]


def test_equal_rank_patterns_tie_exactly(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(30):
        y, x = rng.permutation(23), rng.permutation(23)
        rows += [(dt.date(2024, 1, 1) + dt.timedelta(d), f, float(a), float(b)) for f, s in (("b", 1), ("a", -1)) for a, b in zip(y, s * x)]
    ic = daily_ic(spark.createDataFrame(rows, "date date, factor string, y_true double, y_pred double"), keys=("date", "factor"))
    assert ic.groupBy("date").agg(F.sum("ic").alias("s")).where("s <> 0").count() == 0
    picked = select_by_day(ic.withColumnRenamed("ic", "rankic"), ic.select(F.col("date").alias("asof")).distinct(), threshold=9.0, min_selected=1)
    assert {r["factor"] for r in picked.collect()} == {"a"}
