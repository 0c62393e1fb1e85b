"""Plans that must hold at scale: one shuffle for outer merges, pruned slices, state instead of history, dates scored once."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import evaluate as V
from panelyard.operators import model as M
from panelyard.operators import score as Sc
from panelyard.operators import tuning as T
from panelyard.operators import walk as W
from panelyard.operators.folds import date_index, rolling_folds
from panelyard.operators.joins import merge_parts
from panelyard.operators.rolling import rolling_stats
from panelyard.streaming.daily import score_stream

D0 = dt.date(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def panel(spark, dates=30, stocks=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(D0 + dt.timedelta(d), s, float(rng.normal()), float(rng.integers(0, 2))) for d in range(dates) for s in range(stocks)]
    return spark.createDataFrame(rows, "date date, stockid long, y double, f double")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_outer_merge_has_one_exchange_and_the_rows_of_joins(spark):
    a = spark.createDataFrame([(1, 1, 5.0, None), (1, 2, None, None), (1, 2, 7.0, 1.0), (None, 3, 8.0, 2.0)], "date int, stockid int, x double, z double")
    b = spark.createDataFrame([(1, 2, 9.0, 3.0), (1, 2, 9.5, 3.5), (2, 2, 1.0, None), (None, 3, 4.0, 5.0)], "date int, stockid int, x double, w double")
    c = spark.createDataFrame([(2, 2), (3, 1), (None, None)], "date int, stockid int")
    e = spark.createDataFrame([(3, 1, 6.0)], "date int, stockid int, v double")
    keys = ["date", "stockid"]
    want = a.join(b.drop("x"), keys, "full").join(c, keys, "full").join(e, keys, "full")
    got = merge_parts([a, b, c, e], how="outer", keys=keys)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    parts = [panel(spark).select("date", "stockid", F.col("y").alias(f"y{i}")) for i in range(5)]
    assert plan_of(merge_parts(parts, how="outer")).count("Exchange hashpartitioning") == 1


def test_walks_read_the_folders_of_their_slices(spark):
    rows = W.save_by_date(panel(spark))
    index = date_index(rows)
    folds = rolling_folds(index, window_ratio=0.5, min_dates=10, step_days=8, train=0.6, valid=0.2, test=0.2)
    slices = W._Slices(rows, folds, index)
    train = slices.part(0, "train")
    for frame in (train, train.where(F.col("date") < F.lit(D0 + dt.timedelta(5)))):
        scan = plan_of(frame)
        filters = scan[scan.index("PartitionFilters"):].split("PushedFilters")[0]
        assert "date" in filters and ">=" in filters
    assert len(train.inputFiles()) >= 1
    assert {r[0] for r in train.select("date").distinct().collect()} == {D0 + dt.timedelta(i) for i in range(9)}


def test_boosting_stops_by_the_validation_error(spark):
    """A pattern of the training rows that the later rows lack: without them all trees are used, with them few."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    rows = [(D0 + dt.timedelta(i // 20), i % 20, float(v[0] > 0) + float(rng.normal()), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "date date, stockid long, y double, a double, b double, c double")
    cut = D0 + dt.timedelta(20)
    train, valid = df.where(F.col("date") < F.lit(cut)), df.where(F.col("date") >= F.lit(cut))
    params = {"maxIter": 15, "maxDepth": 4}
    assert M.fit_model(train, ["a", "b", "c"], params=params).getNumTrees == 15
    stopped = M.fit_model(train.withColumn("w", F.lit(2.0)), ["a", "b", "c"], params=params, weight="w", valid=valid)
    assert 1 <= stopped.getNumTrees < 15
    bundle = W.fit_step(train, ["a", "b", "c"], params, W.WalkSettings(early_stop=True, pca={"components": 2}), valid)
    assert bundle.model.getNumTrees <= 15 and len(bundle.pca.columns) == 2


def test_daily_state_equals_the_rolling_stage(spark, tmp_path):
    """A stock away for most dates, one that appears late, a date without a run: the state gives what the history gives."""
    whole = panel(spark, dates=20).where("NOT (stockid = 3 AND date BETWEEN '2024-01-03' AND '2024-01-18')").where(
        "NOT (stockid = 5 AND date < '2024-01-18')")
    saved = W.save_by_date(whole)
    roll = {"features": ["y"], "windows": [4], "stats": ["mean"]}
    train = rolling_stats(whole, **roll).where("y__roll_mean_4 IS NOT NULL")
    bundle = M.Bundle(M.fit_model(train.withColumn("y", F.col("f")), ["y__roll_mean_4"], name="linear"), ["y__roll_mean_4"])
    fill = type("Fill", (), {"transform": staticmethod(lambda df: df.fillna(0.0, ["y__roll_mean_4"]))})()
    bundle.cleaner = fill
    state, sink = str(tmp_path / "state"), str(tmp_path / "sink")
    run = lambda day: Sc.score_daily(saved, day, bundle, rows_back=3, state_path=state, sink=sink, rolling=roll)
    for day in ("2024-01-10", "2024-01-12", "2024-01-19"):
        got = run(day)
        want = bundle.score(fill.transform(rolling_stats(whole, **roll).where(F.col("date") == F.lit(day).cast("date"))), label=None)
        record = rows_of(got)
        assert rows_of(got.select("date", "stockid", "y_pred")) == rows_of(want.select("date", "stockid", "y_pred"))
        assert rows_of(run(day)) == record  # a repeated run
    assert len(Sc.saved_states(spark, state)) == 3
    held = spark.read.parquet(f"{state}/upto=2024-01-19")
    assert held.agg(F.max(F.size("rows"))).first()[0] == 3 and held.where("stockid = 5").select(F.size("rows")).first()[0] == 2
    assert spark.read.parquet(sink).select("target_date").distinct().collect() == [(None,)]


def test_stream_scores_a_date_once_it_is_complete(spark, tmp_path):
    """Three dates, each in three files of different batches: with a manifest a date is written once, whole."""
    rows = panel(spark, dates=3, stocks=9)
    bundle = M.Bundle(M.fit_model(rows, ["f"], name="linear"), ["f"])
    source, sink, log = str(tmp_path / "in"), str(tmp_path / "out"), []
    manifest = spark.createDataFrame([(D0 + dt.timedelta(d), 9) for d in range(2)], "date date, n_rows long")
    for k in range(3):
        rows.where(F.col("stockid") % 3 == k).coalesce(1).write.mode("append").partitionBy("date").parquet(source)
        score_stream(spark, source, rows.schema, bundle, sink, str(tmp_path / "cp"), manifest=manifest).awaitTermination()
        out = tmp_path / "out"
        log.append(sorted(p.name for p in out.iterdir() if p.is_dir()) if out.exists() else [])
    assert log == [[], [], ["date=2024-01-01", "date=2024-01-02"]]  # the date that nobody announced waits
    assert spark.read.parquet(sink).count() == 18
    whole = spark.read.schema(rows.schema).parquet(source).where(F.col("date").isin([D0]))
    assert "PartitionFilters: [date" in plan_of(whole) or "PartitionFilters: [isnotnull(date" in plan_of(whole)




def test_component_scores_of_a_wide_panel_have_a_small_plan(spark):
    """200 features and 150 components: 30 000 loadings in one literal, and the scores of a matrix product."""
    rng = np.random.default_rng(4)
    names = [f"x{i}" for i in range(200)]
    x, w = rng.normal(size=(3, 200)), rng.normal(size=(150, 200))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *names])
    state = M.PcaState(names, [0.5] * 200, [2.0] * 200, w.tolist(), [0.0] * 150, [f"pc{i}" for i in range(150)])
    out = M.transform_pca(df, state)
    assert plan_of(out).count("zip_with") < 20
    got = np.array([r[1:] for r in sorted(out.collect())])
    np.testing.assert_allclose(got, (x - 0.5) / 2 @ w.T, rtol=1e-9, atol=1e-9)


def test_range_draws():
    space = {"a": {"type": "float", "low": 1e-4, "high": 10.0, "log": True}, "b": {"type": "int", "low": 2, "high": 9},
             "c": {"type": "float", "low": 0.1, "high": 0.5, "step": 0.1}, "d": [1, 2], "e": {"type": "categorical", "choices": ["u", "v"]},
             "f": {"type": "int", "low": 1, "high": 64, "log": True}, "g": {"type": "int", "low": 0, "high": 10, "step": 5}}
    rows = T.random_candidates(space, 400, seed=3)
    assert rows == T.random_candidates(space, 400, seed=3) != T.random_candidates(space, 400, seed=4)
    assert all(1e-4 <= r["a"] <= 10 and 2 <= r["b"] <= 9 and r["g"] in (0, 5, 10) and 1 <= r["f"] <= 64 for r in rows)
    assert {r["b"] for r in rows} == set(range(2, 10)) and {round(r["c"], 9) for r in rows} == {0.1, 0.2, 0.3, 0.4, 0.5}
    assert 0.35 < np.mean([r["a"] < 10 ** -1.5 for r in rows]) < 0.65 and {r["e"] for r in rows} == {"u", "v"}
    for bad in ({"type": "float", "low": 2, "high": 1}, {"type": "float", "low": 0, "high": 1, "log": True}, {"type": "x", "low": 0, "high": 1}):
        with pytest.raises(ValueError):
            T.random_candidates({"a": bad}, 1)


def test_sample_ranks_only_rows_below_the_bound(spark, monkeypatch):
    """Of 20 000 rows about 2 x 100 + 16 a part are kept for the rank, and the sample is the one of all hashes."""
    df = spark.range(20_000).selectExpr("date_add(date'2024-01-01', cast(id % 50 as int)) AS date", "id AS stockid",
                                        "CASE WHEN id % 2 = 0 THEN 'train' WHEN id % 4 = 1 THEN 'test' END AS part")
    kept = []
    whole = V.add_ranks
    monkeypatch.setattr(V, "add_ranks", lambda rows, *a, **k: (kept.append(rows.count()), whole(rows, *a, **k))[1])
    got = {r["stockid"] for r in V.stratified_sample(df, 200).collect()}
    h = df.withColumn("h", F.xxhash64("date", "stockid", F.lit(42))).toPandas()
    want = set()
    for _, rows in h.groupby(h["part"].fillna("none")):
        want |= set(rows.sort_values("h")["stockid"].head(round(200 * len(rows) / 20_000)))
    assert got == want and len(got) == 200 and kept[0] < 800
