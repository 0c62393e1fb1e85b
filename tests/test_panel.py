"""Hand-made panels: labels, cleaning, reshapes, loading."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.operators import joins as J
from panelyard.operators import label as L
from panelyard.operators import reshape as R
from panelyard.operators import rolling as W
from panelyard.operators import cross_section as X
from panelyard.operators.clean import CleanSettings, PanelCleaner, PanelCleanerModel
from panelyard.schema import as_date, base_columns, filter_by_mask, infer_features
from panelyard.sources import panel as P
from panelyard.sources import tables as T

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(i)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_panel(spark, dates=25, stocks=12, seed=1, gaps=0.15):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(stocks):
        for d in range(dates):
            if rng.random() < 0.1:
                continue  # suspended
            f1 = None if rng.random() < gaps else float(rng.normal())
            rows.append((day(d), s, float(50 + rng.random()), f1, float(rng.normal())))
    return frame(spark, rows, "date date, stockid long, px double, f1 double, f2 double")


def test_label_counts_the_stocks_own_rows(spark):
    rows = [(day(i), "a", float(p)) for i, p in [(0, 1), (1, 2), (5, 4), (9, 2)]] + [(day(0), "b", 3.0)]
    out = L.forward_return(frame(spark, rows, "date date, stockid string, px double"), "px").orderBy("stockid", "date")
    assert [r["y"] for r in out.collect()] == [1.0, -0.5, None, None, None]


def test_zero_price_gives_no_label(spark):
    rows = [(day(0), 1, 1.0), (day(1), 1, 0.0), (day(2), 1, 2.0)]
    df = frame(spark, rows, "date date, stockid long, px double")
    assert L.forward_return(df, "px").where("y is not null").count() == 0
    assert L.forward_return(df, "px", log=True).where("y is not null").count() == 0


def test_no_look_ahead(spark):
    """Changing rows after t leaves every past-only column at or before t unchanged."""
    p = L.forward_return(random_panel(spark), "px").persist()
    cut = day(14)
    bent = p.withColumns({c: F.when(F.col("date") > F.lit(cut), F.col(c) * 7 + 1).otherwise(F.col(c))
                          for c in ("f1", "f2", "px")})

    def past(df):
        out = W.forward_fill(W.rolling_stats(df, ["f2"], [3, 5], min_periods=2), ["f1"], limit=3)
        return sorted(map(tuple, out.where(F.col("date") <= F.lit(cut)).drop("y").collect()), key=str)

    assert past(p) == past(bent)
    vol = [sorted(map(tuple, L.volatility_scaled_label(d, window=5).where(F.col("date") <= F.lit(day(10)))
                      .select("date", "stockid", "y_vol").collect()), key=str)
           for d in (p, p.withColumn("y", F.when(F.col("date") > F.lit(day(10)), 9.0).otherwise(F.col("y"))))]
    assert vol[0] == vol[1]


def test_postprocess_keeps_rows_and_bounds(spark):
    p = L.forward_return(random_panel(spark), "px")
    out = L.postprocess_label(p, keep_raw=True, rank={"method": "average"}, zscore={}, clip=2.0, winsorize={})
    assert out.count() == p.count()
    assert out.where("y is null").count() == p.where("y is null").count()
    assert out.agg(F.max(F.abs("y"))).first()[0] <= 2.0
    with pytest.raises(ValueError):
        L.clip_label(p, [1.0, -1.0])


def test_single_stock_date_zscore_is_zero(spark):
    df = frame(spark, [(day(0), 1, 5.0), (day(1), 1, None)], "date date, stockid long, y double")
    assert [r["y"] for r in L.zscore_label(df).orderBy("date").collect()] == [0.0, None]


def test_basic_fix_and_schema(spark):
    inf = float("inf")
    rows = [("2024-01-01", 1, 1.0, True), ("bad", 1, 2.0, True), ("2024-01-02", 1, inf, False),
            ("2024-01-03", 1, float("nan"), None), ("2024-01-04", 1, -inf, True)]
    df = frame(spark, rows, "date string, stockid long, f double, b boolean")
    out = R.basic_fix(df)
    assert out.count() == 4 and out.where("f is null").count() == 3
    assert str(out.schema["date"].dataType) == "DateType()"
    assert infer_features(df.withColumn("y_raw", F.lit(1.0)).withColumn("t", F.lit("x"))) == ["f", "b"]
    assert base_columns(["a", "a__miss", "b"]) == ["a", "b"]
    assert filter_by_mask(["c", "a", "b"], ["a", "c"]) == ["c", "a"]
    assert as_date(df, "date").where("date is null").count() == 1


def test_duplicates_are_an_error(spark):
    df = frame(spark, [(day(0), 1, 1.0), (day(0), 1, 2.0), (day(0), 1, 3.0)], "date date, stockid long, f double")
    with pytest.raises(ValueError, match="2"):
        J.validate_long(df)
    with pytest.raises(ValueError):
        J.validate_disjoint(df)
    with pytest.raises(Exception, match="duplicate"):
        R.to_matrix(df, "f", stocks=df).collect()
    with pytest.raises(KeyError):
        J.validate_long(df, required=["g"])


def test_wide_round_trip(spark, tmp_path):
    p = random_panel(spark).select("date", "stockid", "f1", "f2")
    for f in ("f1", "f2"):
        R.to_matrix(p, f, stocks=p).write.parquet(f"{tmp_path}/{f}.parquet")
    back = P.load_wide(spark, str(tmp_path), ["f1", "f2"], stock_type="long")
    joined = back.join(p.withColumnsRenamed({"f1": "g1", "f2": "g2"}), ["date", "stockid"], "left")
    assert back.count() == p.select("date").distinct().count() * p.select("stockid").distinct().count()
    assert joined.where("not (f1 <=> g1 and f2 <=> g2)").count() == 0
    gone = P.load_cross_section(spark, "2030-01-01", ["f1"], folder=str(tmp_path), stock_type="long")
    assert gone.count() == p.select("stockid").distinct().count() and gone.where("f1 is not null").count() == 0


def test_scan_pushes_filters_and_prunes(spark, tmp_path):
    path = str(tmp_path / "p")
    random_panel(spark).write.parquet(path)
    plan = P.scan_long(spark, path, ["date", "f2"], start="2024-01-03", end="2024-01-05")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(date,2024-01-03)" in plan and "ReadSchema: struct<date:date,f2:double>" in plan
    saved = str(tmp_path / "by_date")
    P.write_panel(random_panel(spark), saved)
    plan = P.read_slice(spark, saved, start="2024-01-03", end="2024-01-05")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_chunk_outer_join_keeps_dates_of_later_files(spark, tmp_path):
    a = frame(spark, [(day(0), 1, 1.0)], "date date, stockid long, f1 double")
    b = frame(spark, [(day(0), 1, 2.0), (day(1), 1, 3.0)], "date date, stockid long, f2 double")
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert P.load_chunks(spark, paths, how="outer", label=None).count() == 2
    assert P.load_chunks(spark, paths, how="inner", label=None).count() == 1
    with pytest.raises(KeyError):
        P.load_chunks(spark, paths, ["nope"], label=None)


def test_masks_and_flags(spark, tmp_path):
    (tmp_path / "m.csv").write_text("feature,use\nb,1\na,0\nc,1\nb,1\n")
    assert [r[0] for r in T.read_feature_mask(spark, str(tmp_path / "m.csv")).orderBy("position").collect()] == ["b", "c"]
    (tmp_path / "w.csv").write_text("a,b,c\n1,0,1\n")
    assert [r[0] for r in T.read_feature_mask(spark, str(tmp_path / "w.csv")).orderBy("position").collect()] == ["a", "c"]
    (tmp_path / "f.csv").write_text("date,a,b\n2024-01-01,1,x\n2024-01-02,1,1\n2024-01-01,0,1\n")
    got = {(str(r[0]), r[1]): r[2] for r in T.read_use_flags(spark, str(tmp_path / "f.csv")).collect()}
    assert got == {("2024-01-01", "a"): 0.0, ("2024-01-01", "b"): 1.0, ("2024-01-02", "a"): 1.0, ("2024-01-02", "b"): 1.0}
    (tmp_path / "g.csv").write_text("date,a\nno,1\n")
    with pytest.raises(Exception, match="bad date"):
        T.read_use_flags(spark, str(tmp_path / "g.csv")).collect()


def test_prediction_folder(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = frame(spark, [(day(i), 1, 1.0, 2.0, "test" if i else "train", i, i) for i in range(4)],
                 "date date, stockid long, y_true double, y_pred double, part string, fold long, step_id long")
    T.write_predictions(rows, path)
    assert T.read_predictions(spark, path, parts=["test"], steps=(2, None)).count() == 2
    assert T.read_predictions(spark, path, folds=[0]).first()["part"] == "train"
    with pytest.raises(FileNotFoundError):
        T.read_predictions(spark, path, parts=["future"])


@pytest.mark.parametrize("by", ["date", "global"])
@pytest.mark.parametrize("method", ["standard", "robust"])
def test_clean_matches_pandas(both_paths, by, method):
    spark = both_paths
    p = random_panel(spark, dates=6, stocks=220, seed=3).withColumn("y", F.lit(1.0))
    s = CleanSettings(fill="median", winsorize=by, lower=0.05, upper=0.95, zscore=by, method=method, clip=3.0, ddof=1)
    model, out = PanelCleaner(s).fit_transform(p, ["f1", "f2"])
    pdf = p.toPandas()
    for c in ("f1", "f2"):
        pdf[c] = pdf[c].fillna(pdf[c].median())
        g = pdf.groupby("date")[c] if by == "date" else None
        lo = g.transform(lambda v: v.quantile(0.05)) if by == "date" else pdf[c].quantile(0.05)
        hi = g.transform(lambda v: v.quantile(0.95)) if by == "date" else pdf[c].quantile(0.95)
        pdf[c] = pdf[c].clip(lo, hi)
        g = pdf.groupby("date")[c] if by == "date" else None

        def stat(f):
            return g.transform(f) if by == "date" else f(pdf[c])

        if method == "standard":
            z = (pdf[c] - stat(lambda v: v.mean())) / stat(lambda v: v.std(ddof=1))
        else:
            z = (pdf[c] - stat(lambda v: v.median())) / (stat(lambda v: (v - v.median()).abs().median()) + 1e-12)
        pdf[c] = z.clip(-3, 3)
    got = out.toPandas().sort_values(["date", "stockid"])
    want = pdf.sort_values(["date", "stockid"])
    np.testing.assert_allclose(got[["f1", "f2"]], want[["f1", "f2"]], atol=1e-9)
    if by == "global":  # statistics come from the state, so a transform repeats the fit exactly
        again = model.transform(p).toPandas().sort_values(["date", "stockid"])
        np.testing.assert_allclose(again[["f1", "f2"]], got[["f1", "f2"]])


def test_clean_policies(spark, tmp_path):
    p = L.forward_return(random_panel(spark), "px")
    with pytest.raises(ValueError):
        PanelCleaner(CleanSettings(fill="ffill_all")).fit(p)
    s = CleanSettings(policy="tree_friendly", masks=True, max_col_missing=0.05)
    model, out = PanelCleaner(s).fit_transform(p, ["f1", "f2"])
    assert model.base == ["f2"] and model.dropped == ["f1"]
    assert out.columns == ["date", "stockid", "y", "f2", "f2__miss"]
    assert out.where("y is null").count() == 0
    model.save(spark, str(tmp_path / "s"))
    back = PanelCleanerModel.load(spark, str(tmp_path / "s"))
    assert back.state() == model.state()
    fresh = back.transform(p.drop("f2", "y"))  # an absent feature becomes missing, no row is dropped
    assert fresh.count() == p.count() and fresh.where("f2 is null").count() == p.count()
    strict = PanelCleaner(CleanSettings(fill="zero")).fit(p, ["f1"])
    assert strict.transform(p, validate=True).where("f1 is null").count() == 0


def test_wide_panels_agree_with_narrow_ones(spark, monkeypatch):
    """The array form used above WIDE_COLUMNS gives the same cells in the same columns."""
    p = random_panel(spark).withColumn("f3", F.when(F.col("date") > F.lit(day(3)), F.col("f2") * 2))
    cols = ["f2", "f1", "f3"]
    for run in (lambda: X.zscore_by_date(p, cols, ddof=1, clip=1.5),
                lambda: X.winsorize_by_date(p, cols, lower=0.1, upper=0.8),
                lambda: X.robust_zscore_by_date(p, cols, scaled=True, clip=4.0)):
        monkeypatch.setattr(X, "WIDE_COLUMNS", 32)
        narrow = run()
        monkeypatch.setattr(X, "WIDE_COLUMNS", 1)
        wide = run()
        assert narrow.columns == wide.columns == p.columns
        a, b = (d.toPandas().sort_values(["stockid", "date"]) for d in (narrow, wide))
        for c in cols:
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=1e-12)


def test_zero_mad_and_constant_factor(spark):
    df = frame(spark, [(day(0), i, 1.0, 5.0 if i == 0 else 1.0) for i in range(5)],
               "date date, stockid long, c double, m double")
    assert {r["c"] for r in X.zscore_by_date(df, ["c"]).collect()} == {0.0}
    assert X.robust_zscore_by_date(df, ["m"], clip=9.0).agg(F.max("m")).first()[0] == 9.0


def test_sparse_columns_until_a_date(spark):
    rows = [(day(i), 1, None if i >= 5 else 1.0) for i in range(10)]
    df = frame(spark, rows, "date date, stockid long, f double")
    assert R.drop_sparse_columns(df, ["f"], 0.3)[1] == ["f"]
    assert R.drop_sparse_columns(df, ["f"], 0.3, fit_until=day(4))[1] == []


@pytest.mark.parametrize("policy,side", [("pad_zero", "left"), ("pad_zero", "right"), ("pad_first", "left"), ("pad_first", "right")])
def test_sequences(spark, policy, side):
    rows = [(day(i), s, float(i + 1), float(10 * s), 0.0) for s, n in ((1, 2), (2, 4)) for i in range(n)]
    df = frame(spark, rows, "date date, stockid long, a double, b double, y double")
    out = W.sequences(df, ["a", "b"], 3, incomplete=policy, pad_side=side, with_mask=True).orderBy("stockid", "date").collect()
    assert [(r["stockid"], r["date"]) for r in out] == [(1, day(1)), (2, day(2)), (2, day(3))]
    real = [[1.0, 10.0], [2.0, 10.0]]
    pad = [[0.0, 0.0]] if policy == "pad_zero" else [real[0]]
    assert out[0]["seq"] == (pad + real if side == "left" else real + pad)
    assert out[0]["mask"] == ([False, True, True] if side == "left" else [True, True, False])
    assert out[2]["seq"] == [[2.0, 20.0], [3.0, 20.0], [4.0, 20.0]] and all(out[2]["mask"])
    assert W.sequences(df, ["a"], 3).count() == 2
    assert W.sequences(df, ["a"], 3, incomplete=policy, min_len=3).count() == 2


def test_rolling_matches_pandas(spark):
    p = random_panel(spark)
    got = W.rolling_stats(p, ["f1"], [4], min_periods=2, ddof=1).toPandas().sort_values(["stockid", "date"])
    pdf = p.toPandas().sort_values(["stockid", "date"])
    roll = pdf.groupby("stockid")["f1"].rolling(4, min_periods=2)
    np.testing.assert_allclose(got["f1__roll_mean_4"].astype(float), roll.mean().to_numpy(), atol=1e-12)
    std = roll.std(ddof=1).to_numpy()
    np.testing.assert_allclose(got["f1__roll_std_4"].astype(float), std, atol=1e-9)
    filled = W.forward_fill(p, ["f1"], limit=2).toPandas().sort_values(["stockid", "date"])
    np.testing.assert_allclose(filled["f1"].astype(float), pdf.groupby("stockid")["f1"].ffill(limit=2))
    assert pd.notna(filled["f2"]).all()


def test_cross_join_free_plans(spark):
    """No operator plan falls back to a cartesian product or an unbounded nested loop."""
    from panelyard.operators.folds import assign_folds, date_index, rolling_folds

    p = random_panel(spark)
    index = date_index(p)
    folds = rolling_folds(index, window_ratio=0.5, min_dates=5, step_days=3)
    plan = assign_folds(p, folds, index)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
