"""Folds, scoring, selection, weights, losses, models, walk-forward, backtest, streaming."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.functions import losses as E
from panelyard.functions import metrics as M
from panelyard.operators import backtest as B
from panelyard.operators import evaluate as V
from panelyard.operators import folds as D
from panelyard.operators import model as Mo
from panelyard.operators import score as Sc
from panelyard.operators import select as G
from panelyard.operators import tuning as T
from panelyard.operators import walk as Wk
from panelyard.operators import weights as S
from panelyard.operators.clean import CleanSettings, PanelCleaner
from panelyard.plans.skew import measured_bytes
from panelyard.plans.stage import stage
from panelyard.streaming.daily import score_stream

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(i)


def dates_index(spark, n):
    return stage(D.date_index(spark.createDataFrame([(day(2 * i),) for i in range(n)], "date date")))


def panel(spark, dates=40, stocks=15, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(dates):
        for s in range(stocks):
            f1, f2 = rng.normal(), rng.normal()
            rows.append((day(d), s, float(0.5 * f1 + 0.1 * rng.normal()), float(f1), float(f2)))
    return stage(spark.createDataFrame(rows, "date date, stockid long, y double, f1 double, f2 double"))


# --- folds ---------------------------------------------------------------------


@pytest.mark.parametrize("n,ratio,least,step,embargo", [(50, 0.5, 10, 7, 0), (31, 0.3, 20, 4, 2), (12, 0.9, 60, 1, 0)])
def test_rolling_folds_equal_enumeration(spark, n, ratio, least, step, embargo):
    index = dates_index(spark, n)
    got = {(r["fold"], r["part"], r["date_start"], r["date_end"])
           for r in D.rolling_folds(index, window_ratio=ratio, min_dates=least, step_days=step, train=0.6, valid=0.2,
                                    test=0.2, embargo=embargo).collect()}
    width = min(max(int(n * ratio), least), n)
    want = set()
    for fold, start in enumerate(range(0, n - width + 1, step)):
        a, b = int(width * 0.6), int(width * 0.2)
        for part, lo, hi in (("train", 0, a - embargo), ("valid", a, a + b - embargo), ("test", a + b, width)):
            if hi > lo:
                want.add((fold, part, day(2 * (start + lo)), day(2 * (start + hi - 1))))
    assert got == want


@pytest.mark.parametrize("expanding,most", [(True, None), (False, 8)])
def test_refit_windows_equal_enumeration(spark, expanding, most):
    n, tr, te, fu, step = 40, 12, 5, 4, 3
    rows = D.refit_windows(dates_index(spark, n), train_days=tr, test_days=te, future_days=fu, step_days=step,
                           expanding=expanding, max_train_days=most).orderBy("window_id").collect()
    starts = [t for t in range(tr, n, step) if t + te + fu <= n]
    assert len(rows) == len(starts)
    for i, (r, t) in enumerate(zip(rows, starts)):
        first = 0 if expanding else max(0, t - most)
        want = [first, t - 1, t, t + te - 1, t + te, t + te + fu - 1]
        assert r["window_id"] == i and r["factor_selection_asof_date"] == r["train_end"]
        assert [r[f"{p}_{e}"] for p in D.WINDOW_PARTS for e in ("start", "end")] == [day(2 * x) for x in want]


def test_bad_window_arguments(spark):
    index = dates_index(spark, 20)
    with pytest.raises(ValueError):
        D.refit_windows(index, train_days=10, test_days=10, future_days=1)
    with pytest.raises(ValueError):
        D.refit_windows(index, train_days=5, test_days=2, future_days=1, expanding=False)
    with pytest.raises(ValueError):
        D.holdout_folds(index, train=0.5, valid=0.1, test=0.1)
    with pytest.raises(ValueError):
        D.step_length(10)
    assert D.step_length(10, ratio=0.01) == 1


# --- scoring -------------------------------------------------------------------


def test_bucket_matches_qcut(spark):
    rows = [(n, r) for n in range(1, 121) for r in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n long, r long").repartition(8).persist()
    for q in (4, 5, 10):
        got = df.select("n", "r", M.bucket(F.col("r"), F.col("n"), q).alias("b")).toPandas()
        for n, g in got.groupby("n"):
            g = g.sort_values("r")
            if n < q:
                assert set(g["b"]) == {q // 2}
                continue
            sizes = g["b"].value_counts()
            assert len(sizes) == q and sizes.max() - sizes.min() <= 1 and g["b"].is_monotonic_increasing
            want = pd.qcut(pd.Series(range(1, n + 1)), q, labels=False)
            assert (g["b"].to_numpy() != want.to_numpy()).sum() <= 1  # float edges of qcut


def test_daily_ic_matches_pandas(both_paths):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"date": np.repeat([day(i) for i in range(3)], 200), "stockid": np.tile(np.arange(200), 3),
                        "y_true": np.round(rng.normal(size=600), 1), "y_pred": np.round(rng.normal(size=600), 1)})
    pdf.loc[::17, "y_true"] = np.nan
    pdf.loc[pdf["date"] == day(2), "y_pred"] = 1.0  # constant: undefined
    df = both_paths.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                    "date date, stockid long, y_true double, y_pred double")
    got = {r["date"]: r["ic"] for r in V.daily_ic(df).collect()}
    assert set(got) == {day(0), day(1)}
    for d, g in pdf[pdf["date"] < day(2)].groupby("date"):
        ok = g.dropna()
        want = ok["y_true"].rank().corr(ok["y_pred"].rank())
        assert abs(got[d] - want) < 1e-12


def test_empty_and_degenerate_metrics(spark):
    schema = "date date, stockid long, y_true double, y_pred double, part string"
    none = spark.createDataFrame([], schema)
    row = V.regression_metrics(none, keys=[]).first()
    assert [row[m] for m in ("mse", "rmse", "mae", "r2", "rankic", "icir")] == [0.0] * 6 and row["n"] == 0
    one = spark.createDataFrame([(day(0), 1, 1.0, 1.0, "test")], schema)
    row = V.regression_metrics(one).first()
    assert row["r2"] == 0.0 and row["rankic"] == 0.0 and row["n_dates"] == 0
    assert V.overall_ic(none).first()["ic"] == 0.0
    with pytest.raises(KeyError):
        V.regression_metrics(one, ["nope"])
    with pytest.raises(KeyError):
        V.classification_metrics(one, ["nope"])
    flat = V.classification_metrics(one.withColumn("y_true", F.lit(1.0)), ["auc", "ks", "f1"]).first()
    assert flat["auc"] == 0.0 and flat["ks"] == 0.0 and flat["f1"] == 1.0


def test_report_order_and_future_overlap(spark):
    schema = "date date, stockid long, y_true double, y_pred double, part string"
    df = spark.createDataFrame([(day(i), s, float(s), float(s * i), p) for i, p in
                                enumerate(["zeta", "test", "future", "train", "valid"]) for s in range(3)], schema)
    assert [r["part"] for r in V.part_metrics(df, ["mae"]).collect()] == ["train", "valid", "test", "future", "zeta"]
    assert set(V.evaluation_run(df, metrics=["mae"])) == {"all", "test", "future"}
    with pytest.raises(ValueError):
        V.evaluation_run(df.unionByName(df), metrics=["mae"])
    with pytest.raises(ValueError):
        V.factor_source("rolling", "elsewhere")


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000).select(F.lit(day(0)).alias("date"), F.col("id").alias("stockid"),
                                  F.when(F.col("id") < 990, "train").otherwise("test").alias("part"))
    a, b = (V.stratified_sample(df, 50).orderBy("stockid").collect() for _ in range(2))
    assert a == b and sum(r["part"] == "test" for r in a) == 1 and len(a) == 51
    assert V.stratified_sample(df, 5000).count() == 1000


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(y, p, "t") for y, p in [(1, .5), (0, .5), (1, .9), (0, .1), (1, .5), (0, .9)]],
                               "y_true int, y_pred double, part string")
    got = V.auc_ks(V.resolve_prob(df)).first()
    pairs = [(p > n) + 0.5 * (p == n) for p in (.5, .9, .5) for n in (.5, .1, .9)]
    assert abs(got["auc"] - sum(pairs) / 9) < 1e-12


# --- selection -----------------------------------------------------------------


def test_selection_ignores_later_history(spark):
    h = G.factor_daily_rankic(panel(spark), ["f1", "f2"])
    asof = spark.createDataFrame([(day(20),)], "asof date")
    bent = h.withColumn("rankic", F.when(F.col("date") > F.lit(day(20)), -F.col("rankic") * 3).otherwise(F.col("rankic")))
    for pick in (lambda t: G.select_by_history_many(t, asof, threshold=0.0),
                 lambda t: G.select_by_history(t, day(20), threshold=0.0),
                 lambda t: G.select_by_day(t, asof, threshold=0.0)):
        assert pick(h).collect() == pick(bent).collect()
    first = G.select_by_history(h, day(20)).first()
    assert first["factor"] == "f1" and first["position"] == 1
    known = h.where("date = '2024-01-01'").first()["available_from"]
    assert known == day(2)


def test_flags_need_a_factor(spark):
    flags = spark.createDataFrame([(day(0), "a", 1.0), (day(0), "b", 0.0)], "date date, factor string, flag double")
    days = spark.createDataFrame([(day(0),)], "asof date")
    assert [r["factor"] for r in G.select_by_flags(flags, days).collect()] == ["a"]
    with pytest.raises(ValueError):
        G.select_by_flags(flags, spark.createDataFrame([(day(1),)], "asof date"))


# --- weights and losses --------------------------------------------------------


def test_weights(spark):
    p = panel(spark, dates=10)
    w = S.sample_weights(p, recency={"half_life": 3.0}, tail={"scope": "date"}, clip_min=0.01)
    assert abs(w.agg(F.avg("weight")).first()[0] - 1.0) < 1e-9
    gone = S.sample_weights(p.withColumn("y", F.lit(None).cast("double")), recency={}, normalize="none")
    assert {r["weight"] for r in gone.collect()} == {1.0}
    with pytest.raises(ValueError):
        S.pseudo_class(p.limit(3), lower=0.3, upper=0.7)
    with pytest.raises(ValueError):
        S.recency_weight(p, mode="cubic")
    kept = S.pseudo_class(p)
    assert {r["y"] for r in kept.select("y").distinct().collect()} == {-1.0, 1.0}


def test_losses_match_numpy(spark):
    z = np.array([[1000.0, 0.0, -5.0], [0.2, 0.1, -0.3]])
    k = np.array([1, 2])
    lp = z - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) - z.max(1, keepdims=True)
    ce = -lp[[0, 1], k]
    df = spark.createDataFrame([(z[i].tolist(), int(k[i])) for i in range(2)], "z array<double>, k int").coalesce(1)
    w = [0.5, 2.0, 1.0]
    row = df.agg(E.sparse_cce("z", "k").alias("a"), E.weighted_ce("z", "k", w).alias("b"),
                 E.reduce_loss(E.polyloss("z", "k"), "sum").alias("c"),
                 E.sparse_cce("z", "k", class_weight=w, label_smoothing=0.2).alias("d")).first()
    cw = np.array(w)[k]
    even = -(lp * np.array(w)).sum(1)
    assert np.allclose([row["a"], row["b"], row["c"], row["d"]],
                       [ce.mean(), (ce * cw).sum() / cw.sum(), (ce + 1 - np.exp(-ce)).sum(),
                        (0.8 * ce * cw + 0.2 * even / 3).sum() / cw.sum()])
    x = spark.createDataFrame([(800.0, 0.0), (-800.0, 1.0)], "p double, t double")
    assert np.allclose([r[0] for r in x.select(E.logcosh("p", "t")).collect()], [800 - math.log(2), 801 - math.log(2)])
    assert np.allclose([r[0] for r in x.select(E.bce("p", "t")).collect()], [800.0, 800.0])
    edge = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "p double, t double")
    assert np.allclose([r[0] for r in edge.select(E.bce("p", "t", from_logits=False)).collect()], [100.0, 0.0])


# --- models --------------------------------------------------------------------


@pytest.mark.parametrize("whiten", [False, True])
def test_pca_matches_numpy(spark, whiten):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) @ np.array([[3, 1, 0, 0], [0, 2, 1, 0], [0, 0, 1, .2], [0, 0, 0, .1]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    state = Mo.fit_pca(df, list("abcd"), share=0.9, whiten=whiten)
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    ratio = s**2 / (s**2).sum()
    k = int(np.searchsorted(ratio.cumsum(), 0.9) + 1)
    assert len(state.columns) == k and np.allclose(state.explained, ratio[:k])
    got = Mo.transform_pca(df, state).toPandas()[state.columns].to_numpy()
    want = z @ vt[:k].T / (np.sqrt(s[:k]**2 / (len(x) - 1)) if whiten else 1.0)
    signs = np.sign((got * want).sum(0))
    np.testing.assert_allclose(got, want * signs, atol=1e-8)
    for w in state.loadings:
        assert max(w, key=abs) > 0


def test_missing_features_are_an_error(spark):
    p = panel(spark, dates=5).withColumn("f1", F.when(F.col("stockid") > 2, F.col("f1")))
    with pytest.raises(Exception):
        Mo.fit_model(p, ["f1"], name="gbt", params={"maxIter": 1})


def test_walk_forward_and_choice(spark, tmp_path):
    p = panel(spark)
    index = stage(D.date_index(p))
    folds = D.rolling_folds(index, window_ratio=0.5, min_dates=10, step_days=10, train=0.6, valid=0.2, test=0.2)
    s = Wk.WalkSettings(model="linear", save_to=str(tmp_path))
    run = Wk.walk_forward(p, folds, index, ["f1", "f2"], s)
    h = run.history.orderBy("step_id").collect()
    assert len(h) == 3 and all(r["status"] == "done" and r["test_score"] > 0.5 for r in h)
    scored = {(r["step_id"], r["part"]): r["count"] for r in run.predictions.groupBy("step_id", "part").count().collect()}
    assert all(scored[(r["step_id"], part)] == r[f"n_{part}"] for r in h for part in ("train", "valid", "test"))
    assert run.predictions.select("part").distinct().count() == 3
    chosen = T.choose_step(run.history, "last").first()
    back = Mo.load_bundle(spark, chosen["model_path"])
    assert abs(back.model.coefficients[0] - run.bundles[2].model.coefficients[0]) < 1e-12
    with pytest.raises(KeyError):
        T.choose_step(run.history, "newest")


def test_refit_uses_more_rows_than_evaluation(spark):
    p = panel(spark)
    index = stage(D.date_index(p))
    windows = stage(D.refit_windows(index, train_days=20, test_days=5, future_days=5))
    s = Wk.WalkSettings(model="linear", metric="rmse")
    run = Wk.refit_walk(p, windows, index, ["f1"], s)
    w0 = windows.where("window_id = 0").first()
    both = Mo.fit_model(p.where(F.col("date") <= F.lit(w0["test_end"])), ["f1"], name="linear")
    only = Mo.fit_model(p.where(F.col("date") <= F.lit(w0["train_end"])), ["f1"], name="linear")
    assert abs(run.bundles[0].model.coefficients[0] - both.coefficients[0]) < 1e-12
    test = run.predictions.where("part = 'test' and step_id = 0").join(p, ["date", "stockid"])
    gap = test.agg(F.max(F.abs(F.col("y_pred") - F.col("f1") * float(only.coefficients[0]) - float(only.intercept)))).first()[0]
    assert gap < 1e-9 and both.coefficients[0] != only.coefficients[0]
    future = V.future_table(run.predictions)  # blocks are disjoint
    assert future.select("date").distinct().count() == 5 * windows.count()


def test_tuning_never_sees_test(spark):
    p = panel(spark)
    index = stage(D.date_index(p))
    folds = D.rolling_folds(index, window_ratio=0.5, min_dates=10, step_days=10, train=0.7, valid=0.0, test=0.3)
    s = Wk.WalkSettings(model="linear", metric="rmse", params={"regParam": 50.0}, candidates=[{"regParam": 0.0}],
                        schedule=T.every_k_steps(1))
    rows = Wk.walk_forward(p, folds, index, ["f1"], s).history.orderBy("step_id").collect()
    assert rows[0]["tuned"] and rows[0]["updated"] and "50" in rows[0]["params"]
    assert '"regParam": 0.0' in rows[1]["params"]  # found parameters apply from the next step
    bent = stage(p.withColumn("y", F.when(F.col("date") > F.lit(day(14)), -F.col("y")).otherwise(F.col("y"))))
    again = Wk.walk_forward(bent, folds, index, ["f1"], s).history.orderBy("step_id").first()
    assert abs(again["tune_score"] - rows[0]["tune_score"]) < 1e-9 and again["test_score"] != rows[0]["test_score"]


def test_schedules_and_search():
    assert [i for i in range(10) if T.every_k_steps(4, 1).due(i)] == [1, 5, 9]
    assert [i for i in range(12) if T.warmup_then_every_k(5, 3).due(i)] == [5, 8, 11]
    assert not any(T.NEVER.due(i) for i in range(5)) and not T.every_k_steps(0).due(0)
    assert T.days_due(day(9), None) and T.days_due(day(9), day(4)) and not T.days_due(day(8), day(4))
    assert T.gate_allows(0.5, 0.75, 0.25) and not T.gate_allows(0.5, 0.74, 0.25)
    found = T.search(lambda c: -abs(c["a"] - 2), [{"a": 1}, {"a": 3}, {"a": 5}])
    assert found.best == {"a": 1} and found.scores == [-1, -1, -3]
    assert T.random_candidates({"a": [1, 2, 3]}, 5, 7) == T.random_candidates({"a": [1, 2, 3]}, 5, 7)
    assert T.stable_hash({"a": 1, "b": 2}) == T.stable_hash({"b": 2, "a": 1}) and len(T.stable_hash({})) == 10


# --- backtest ------------------------------------------------------------------


def test_backtest_by_hand(spark):
    rows = [(day(0), s, float(s), 0.01 * s) for s in range(4)] + [(day(1), s, float(-s), 0.02 * s) for s in range(4)]
    df = spark.createDataFrame(rows, "date date, stockid long, y_pred double, ret double")
    s = B.BacktestSettings(group_num=4, long_groups=(4,), short_groups=(1,), turnover_fee_rate=0.1)
    groups = stage(B.factor_groups(df, df, s))
    out = B.group_backtest(groups, s).orderBy("date").collect()
    # day 0 holds stock 3, day 1 stock 0: a full purchase, then a full exchange
    assert np.allclose([r["gross"] for r in out], [0.03, 0.0]) and np.allclose([r["turnover"] for r in out], [1.0, 1.0])
    assert np.allclose([r["net"] for r in out], [-0.07, -0.1])
    assert np.allclose(out[1]["cum_net"], 0.93 * 0.9 - 1)
    both = B.backtest_both(groups, s)
    assert np.allclose([r["gross"] for r in both[True].orderBy("date").collect()], [0.015, -0.03])
    ls = B.BacktestSettings(**{**s.__dict__, "portfolio_type": "long_short", "enable_turnover_fee": False,
                               "factor_direction": "negative"})
    out = B.group_backtest(stage(B.factor_groups(df, df, ls)), ls).orderBy("date").collect()
    assert np.allclose([r["net"] for r in out], [-0.03, 0.06])
    with pytest.raises(ValueError):
        B.group_backtest(groups, B.BacktestSettings(portfolio_type="none"))


# --- scoring jobs --------------------------------------------------------------


def test_stream_replay_and_lookback(spark, tmp_path):
    p = panel(spark, dates=12)
    cleaner, clean = PanelCleaner(CleanSettings(zscore="date")).fit_transform(p.where(F.col("date") < F.lit(day(8))), ["f1"])
    bundle = Mo.Bundle(Mo.fit_model(clean, ["f1"], name="linear"), ["f1"], cleaner)
    fresh = p.where(F.col("date") >= F.lit(day(8))).drop("y")
    fresh.repartitionByRange(4, "date").write.parquet(str(tmp_path / "in"))
    for i in range(2):
        score_stream(spark, str(tmp_path / "in"), fresh.schema, bundle, str(tmp_path / "out"),
                     str(tmp_path / f"cp{i}"), files_per_batch=1).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == fresh.count()
    daily = Sc.score_date(p, day(9), bundle)
    gap = out.withColumnRenamed("y_pred", "s").join(daily, ["date", "stockid"]).agg(F.max(F.abs(F.col("s") - F.col("y_pred"))))
    assert gap.first()[0] < 1e-12
    assert Sc.with_lookback(p, day(9), 3).select("date").distinct().count() == 4


def test_stream_sees_whole_dates(spark, tmp_path):
    """A date in three files, one file a batch: every row is scored, as in one batch."""
    p = panel(spark, dates=12)
    cleaner, clean = PanelCleaner(CleanSettings(zscore="date")).fit_transform(p.where(F.col("date") < F.lit(day(8))), ["f1"])
    bundle = Mo.Bundle(Mo.fit_model(clean, ["f1"], name="linear"), ["f1"], cleaner)
    fresh = p.where(F.col("date") >= F.lit(day(8))).drop("y")
    fresh.repartition(3).write.parquet(str(tmp_path / "in"))
    for i in range(2):
        score_stream(spark, str(tmp_path / "in"), fresh.schema, bundle, str(tmp_path / "out"), str(tmp_path / f"cp{i}"),
                     files_per_batch=1).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == fresh.count()
    whole = Sc.score_date(p, day(9), bundle).withColumnRenamed("y_pred", "s")
    assert out.join(whole, ["date", "stockid"]).where(F.abs(F.col("s") - F.col("y_pred")) > 1e-12).isEmpty()


def test_lookback_counts_rows_of_a_stock(spark):
    """A stock absent on recent dates still gets its own last rows."""
    p = panel(spark, dates=20).where(~((F.col("stockid") == 3) & F.col("date").between(F.lit(day(8)), F.lit(day(18)))))
    rows = Sc.with_lookback(p, day(19), 3)
    assert rows.where("stockid = 3").count() >= 4 and rows.agg(F.min("date")).first()[0] == day(5)


def test_measured_bytes_counts_text(spark):
    short = spark.createDataFrame([("a",)] * 10, "t string")
    long = spark.createDataFrame([("a" * 1000,)] * 10, "t string")
    assert measured_bytes(long) - measured_bytes(short) == 9990
