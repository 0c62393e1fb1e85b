import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.plans import skew

D0 = dt.date(2024, 1, 1)


def panel(n_hot=600, n_cold=30, dates=4, ties=True, seed=0):
    """One date holds most of the rows; one value holds a third of that date."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(dates):
        n = n_hot if d == 1 else n_cold
        v = np.round(rng.normal(size=n), 2 if ties else 9)
        v[: n // 3] = 0.0
        v[n // 3: n // 3 + 5] = np.nan
        rows.append(pd.DataFrame({"date": D0 + dt.timedelta(d), "stockid": np.arange(n), "v": v}))
    return pd.concat(rows, ignore_index=True)


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                 "date date, stockid long, v double").repartition(5)


@pytest.mark.parametrize("method", skew.RANK_METHODS)
@pytest.mark.parametrize("na_option,pct", [("keep", False), ("top", True), ("bottom", True)])
def test_rank_matches_pandas(both_paths, method, na_option, pct):
    pdf = panel()
    got = skew.add_ranks(to_spark(both_paths, pdf), ["date"], "v", "r", method=method, na_option=na_option,
                         pct=pct, tie_break=["stockid"], count_out="n").toPandas()
    want = pdf.sort_values(["date", "stockid"])
    g = want.groupby("date")["v"]
    want["r"] = g.rank(method=method, na_option=na_option, pct=pct).where(want["v"].notna())
    want["n"] = g.transform("count")
    got = got.sort_values(["date", "stockid"])
    np.testing.assert_allclose(got["r"].astype(float), want["r"], atol=1e-12)
    assert (got["n"].to_numpy() == want["n"].to_numpy()).all()


@pytest.mark.parametrize("method", ["average", "dense", "first"])
def test_global_rank(both_paths, method):
    pdf = panel()
    df = to_spark(both_paths, pdf)
    got = skew.add_ranks(df, [], "v", "r", method=method, tie_break=["date", "stockid"]).toPandas()
    want = pdf.sort_values(["date", "stockid"])
    want["r"] = want["v"].rank(method=method)
    got = got.sort_values(["date", "stockid"])
    np.testing.assert_allclose(got["r"].astype(float), want["r"])


@pytest.mark.parametrize("group", [["date"], []])
def test_quantiles_are_exact(both_paths, group):
    pdf = panel(n_hot=3000)
    pdf["w"] = pdf["v"].fillna(1.0) ** 3
    df = both_paths.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                    "date date, stockid long, v double, w double")
    probs = [0.0, 0.05, 0.5, 0.913, 1.0]
    got = skew.quantile_table(df, group, ["v", "w"], probs).toPandas()
    src = pdf if group else pdf.assign(date=D0)
    assert len(got) == src["date"].nunique()
    for _, row in got.iterrows():
        part = src if not group else src[src["date"] == row["date"]]
        for c in ("v", "w"):
            np.testing.assert_allclose(row[c], part[c].quantile(probs), atol=1e-12)


@pytest.mark.parametrize("ties", [True, False])
def test_quantiles_do_not_rest_on_the_sketch(tiny_tasks, monkeypatch, ties):
    """A sketch of few values, far off, costs rounds; the result stays exact."""
    monkeypatch.setattr(skew, "SKETCH_ACCURACY", 20)
    monkeypatch.setattr(skew, "SKETCH_CUTS", 8)
    pdf = panel(n_hot=2000, ties=ties)
    got = skew.quantile_table(to_spark(tiny_tasks, pdf), ["date"], ["v"], [0.1, 0.9]).toPandas()
    for _, row in got.iterrows():
        np.testing.assert_allclose(row["v"], pdf[pdf["date"] == row["date"]]["v"].quantile([0.1, 0.9]), atol=1e-12)


def test_no_task_sees_more_of_a_hot_group_than_its_bound(tiny_tasks):
    """20 000 rows in one group, a bound of 150: brackets end within it, and the one window is over them."""
    df = tiny_tasks.range(20_000).selectExpr("1 AS g", "cast((id * 7919) % 20011 as double) AS __v")
    out = skew._select_quantiles(df, ["g"], [0.25, 0.5])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window " in plan
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("__t" in line for line in windows)  # by group and position, never by group alone
    v = sorted((i * 7919) % 20011 for i in range(20_000))
    assert out.first()["__q"] == list(np.quantile(v, [0.25, 0.5]))


def test_attach_and_latest(both_paths):
    df = to_spark(both_paths, panel())
    stats = df.groupBy("date").agg(F.avg("v").alias("m"))
    assert skew.attach(df, stats, ["date"]).count() == df.count()
    copies = df.union(df.withColumn("v", F.lit(9.0))).withColumn("o", F.monotonically_increasing_id())
    latest = skew.keep_latest(copies, ["date", "stockid"], ["o"])
    assert latest.where("v = 9.0").count() == df.count() == latest.count()


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 200), "k": np.tile(np.arange(200.0), 2), "c": 1})
    df = spark.createDataFrame(pdf).repartition(4)
    got = skew.running_totals(df, ["g"], "k", {"c": "run"}, descending=descending).toPandas()
    want = got["k"] + 1 if not descending else 200 - got["k"]
    assert (got["run"] == want).all() and len(got) == 400


def test_measured_bytes_of_every_kind_of_column(spark):
    """Sizes of long values are counted wherever they are; a type without a known size is refused."""
    big = 100_000
    for value in (f"repeat('x', {big})", f"cast(repeat('x', {big}) as binary)", f"array(repeat('x', {big}))",
                  f"named_struct('a', 1, 'b', repeat('x', {big}))", f"map('k', repeat('x', {big}))",
                  f"array(named_struct('a', array(cast(repeat('x', {big}) as binary))))", f"array_repeat(1L, {big // 8})"):
        size = skew.measured_bytes(spark.range(3).selectExpr("id", f"{value} AS v"))
        assert 3 * big <= size <= 4 * big, value
    assert skew.measured_bytes(spark.sql("SELECT CAST(NULL AS binary) AS b, CAST(NULL AS array<string>) AS a, 1.5BD AS d")) < 200
    with pytest.raises(TypeError, match="measured"):
        skew.measured_bytes(spark.sql("SELECT parse_json('{}') AS v"))


def test_a_table_of_long_binaries_is_not_broadcast(spark):
    """100 MB of binary values take the salted join with the limit as it is."""
    table = spark.range(100).selectExpr("id AS k", "cast(repeat('x', 1000000) as binary) AS b")
    out = skew.attach(spark.range(1000).selectExpr("id % 100 AS k"), table, ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and "broadcast" not in plan.lower()
