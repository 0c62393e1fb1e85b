"""Scores, classification metrics, curves, quantile portfolios, backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.base import (
    CLS, LAB, PANEL_M, PRED, bucket_sql, class_predictions, ic_sql, labelled, predictions, query, r6, rounded, rr, sql,
    staged,
)
from panelyard.operators import backtest as B
from panelyard.operators import evaluate as V
from panelyard.plans.stage import stage_path
from panelyard.sources import tables as T

BASE = (PANEL_M, LAB, PRED)


@query("a6_errors", sql(*BASE, body=f"""SELECT part, {rr('avg((y_true-y_pred)*(y_true-y_pred))', 'mse', 4)},
{rr('sqrt(avg((y_true-y_pred)*(y_true-y_pred)))', 'rmse', 5)}, {rr('avg(abs(y_true-y_pred))', 'mae', 5)}, count(*) AS n
FROM pred GROUP BY part"""))
def a6(spark, sf):
    out = V.regression_metrics(predictions(spark, sf), ["mse", "rmse", "mae"])
    return rounded(rounded(out, "mse", digits=4), "rmse", "mae", digits=5)


@query("a7_r2", sql(*BASE, body=f"""SELECT part, {rr('1 - sum((y_true-p)*(y_true-p))/(var_pop(y_true)*count(*))', 'r2')}, count(*) AS n
FROM (SELECT *, y_pred/1e3 AS p FROM pred) GROUP BY part"""))
def a7(spark, sf):
    df = predictions(spark, sf).withColumn("y_pred", F.col("y_pred") / 1000.0)
    return rounded(V.regression_metrics(df, ["r2"]), "r2")


IC = ic_sql("pred", "date")


@query("a8_daily_ic", sql(*BASE, IC, body=f"SELECT date, {rr('ic')}, n FROM ic"))
def a8(spark, sf):
    return rounded(V.daily_ic(predictions(spark, sf)), "ic")


@query("a8_daily_ic_pearson", sql(*BASE, body=f"SELECT date, {rr('corr(y_true, y_pred)', 'ic')}, count(*) AS n FROM pred GROUP BY date"))
def a8_pearson(spark, sf):
    return rounded(V.daily_ic(predictions(spark, sf), method="pearson"), "ic")


@query("a9_mean_ic", sql(*BASE, IC, body=f"SELECT {rr('avg(ic)', 'rankic')}, count(*) AS n_dates FROM ic"))
def a9(spark, sf):
    return rounded(V.mean_ic(predictions(spark, sf)), "rankic")


@query("a10_icir", sql(*BASE, IC, body=f"SELECT {rr('avg(ic)/stddev_samp(ic)', 'icir')}, count(*) AS n_dates FROM ic"))
def a10(spark, sf):
    return rounded(V.ic_ratio(predictions(spark, sf)), "icir")


@query("a11_overall_ic", sql(*BASE, """r AS (SELECT rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1)/2e0 AS a,
 rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1)/2e0 AS b FROM pred)""",
    body=f"SELECT {rr('corr(a, b)', 'ic')}, count(*) AS n FROM r"))
def a11(spark, sf):
    return rounded(V.overall_ic(predictions(spark, sf)), "ic")


PIC = ic_sql("pred", "part, date", name="pic")


@query("a12_part_metrics", sql(*BASE, PIC, """s AS (SELECT part, avg(ic) AS rankic, avg(ic)/stddev_samp(ic) AS icir, count(*) AS n_dates
 FROM pic GROUP BY part)""", body=f"""SELECT part, {rr('mae', 'mae', 5)}, {rr('rankic')}, {rr('icir')}, n, n_dates
FROM (SELECT part, avg(abs(y_true-y_pred)) AS mae, count(*) AS n FROM pred GROUP BY part) JOIN s USING (part)"""))
def a12(spark, sf):
    out = V.part_metrics(predictions(spark, sf), ["mae", "rankic", "icir"])
    return rounded(rounded(out, "mae", digits=5), "rankic", "icir")


@query("a13_time_curve_mean", sql(*BASE, body=f"""SELECT part, date, {rr('avg(y_true)', 'y_true')}, {rr('avg(y_pred)', 'y_pred', 5)},
{rr('avg(y_true - y_pred)', 'residual', 5)} FROM pred GROUP BY part, date"""))
def a13(spark, sf):
    out = V.time_curve(predictions(spark, sf))
    return rounded(rounded(out, "y_true"), "y_pred", "residual", digits=5)


@query("a13_time_curve_median", sql(*BASE, body=f"""SELECT part, date, {rr('median(y_true)', 'y_true')}, {rr('median(y_pred)', 'y_pred', 5)},
{rr('median(y_true - y_pred)', 'residual', 5)} FROM pred GROUP BY part, date"""))
def a13_median(spark, sf):
    out = V.time_curve(predictions(spark, sf), how="median")
    return rounded(rounded(out, "y_true"), "y_pred", "residual", digits=5)


QB = f"""rq AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY y_pred, stockid) AS r, count(*) OVER (PARTITION BY date) AS n FROM pred),
qb AS (SELECT date, stockid, y_true, CAST({bucket_sql('r', 'n', 10)} AS BIGINT) AS quantile FROM rq),
dq AS (SELECT date, quantile, avg(y_true) AS ret FROM qb GROUP BY 1, 2)"""


@query("w11_quantile_bucket", sql(*BASE, QB, body="SELECT date, stockid, quantile FROM qb"))
def w11(spark, sf):
    return V.assign_quantile(predictions(spark, sf)).select("date", "stockid", "quantile")


@query("a14_quantile_daily", sql(*BASE, QB, body=f"SELECT date, quantile, {rr('ret')} FROM dq"))
def a14(spark, sf):
    return rounded(V.quantile_daily_return(V.assign_quantile(predictions(spark, sf))), "ret")


@query("a15_quantile_mean", sql(*BASE, QB, body=f"""SELECT CAST(i AS BIGINT) AS quantile, {rr('coalesce(m, 0)', 'mean_ret')}
FROM range(10) t(i) LEFT JOIN (SELECT quantile, avg(ret) AS m FROM dq GROUP BY 1) ON i = quantile"""))
def a15(spark, sf):
    daily = V.quantile_daily_return(V.assign_quantile(predictions(spark, sf)))
    return rounded(V.quantile_mean_return(daily), "mean_ret")


@query("a16_quantile_cumulative", sql(*BASE, QB, body=f"""SELECT CAST(i AS BIGINT) AS quantile, {rr('coalesce(m, 0)', 'cum_return', 4)}
FROM range(10) t(i) LEFT JOIN (SELECT quantile, product(1 + ret) - 1 AS m FROM dq GROUP BY 1) ON i = quantile"""))
def a16(spark, sf):
    daily = V.quantile_daily_return(V.assign_quantile(predictions(spark, sf)))
    return rounded(V.quantile_cumulative_return(daily), "cum_return", digits=4)


@query("a17_part_counts", sql(*BASE, body="SELECT part, count(*) AS n FROM pred GROUP BY part"))
def a17(spark, sf):
    return V.part_counts(predictions(spark, sf))


def _hist_sql(source, value, bins):
    return f"""sp AS (SELECT part, min({value}) AS lo, max({value}) AS hi, count(*) AS n FROM {source} GROUP BY part),
hb AS (SELECT part, least(CAST(floor({bins} * ({value} - lo) / (hi - lo)) AS BIGINT), {bins - 1}) AS bin, lo, hi, sp.n AS n
 FROM {source} JOIN sp USING (part))"""


# the IC is rounded first, so that a value on a bin edge falls on the same side in both engines
@query("a19_ic_histogram", sql(*BASE, PIC, "pir AS (SELECT part, round(ic, 9) AS ic FROM pic)", _hist_sql("pir", "ic", 40), body=f"""SELECT part, bin, {rr('lo + bin*(hi-lo)/40', 'left')},
count(*) AS count, {rr('count(*)/(n*(hi-lo)/40)', 'density', 4)} FROM hb GROUP BY part, bin, lo, hi, n""").replace("AS left", "AS \"left\""))
def a19(spark, sf):
    ic = rounded(V.daily_ic(predictions(spark, sf), keys=["part", "date"]), "ic", digits=9)
    out = V.histogram(ic, "ic", 40)
    return rounded(rounded(out, "left"), "density", digits=4)


@query("a19_residual_histogram", sql(*BASE, "rs AS (SELECT part, y_true - y_pred AS v FROM pred)", _hist_sql("rs", "v", 80),
    body=f"""SELECT part, bin, {rr('lo + bin*(hi-lo)/80', 'left', 4)}, count(*) AS count,
{rr('count(*)/(n*(hi-lo)/80)', 'density')} FROM hb GROUP BY part, bin, lo, hi, n""").replace("AS left", "AS \"left\""))
def a19_residual(spark, sf):
    rows = predictions(spark, sf).withColumn("v", F.col("y_true") - F.col("y_pred"))
    return rounded(rounded(V.histogram(rows, "v", 80), "left", digits=4), "density")


# --- binary classification -----------------------------------------------------

PROB = """pr AS (SELECT doc_id, part, y_true, CASE WHEN min(y_pred) OVER w < -1e-6 OR max(y_pred) OVER w > 1 + 1e-6
 THEN 1/(1 + exp(-greatest(least(y_pred, 50), -50))) ELSE greatest(least(y_pred, 1), 0) END AS y_prob
 FROM cls WINDOW w AS (PARTITION BY part))"""
CONF = """cf AS (SELECT part, count(*) FILTER (y_true = 1 AND y_prob >= 0.7) AS tp, count(*) FILTER (y_true = 0 AND y_prob < 0.7) AS tn,
 count(*) FILTER (y_true = 0 AND y_prob >= 0.7) AS fp, count(*) FILTER (y_true = 1 AND y_prob < 0.7) AS fn FROM pr GROUP BY part)"""
STEPS = """st AS (SELECT part, y_prob, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM pr GROUP BY 1, 2),
tt AS (SELECT part, sum(pos) AS np, sum(neg) AS nn FROM st GROUP BY 1)"""


@query("c1_probability", sql(CLS, PROB, body=f"SELECT doc_id, part, {rr('y_prob', 'y_prob', 8)} FROM pr"))
def c1(spark, sf):
    out = V.resolve_prob(class_predictions(spark, sf))
    return rounded(out.select("doc_id", "part", "y_prob"), "y_prob", digits=8)


@query("c2_confusion", sql(CLS, PROB, CONF, body="SELECT part, tp, tn, fp, fn FROM cf"))
def c2(spark, sf):
    return V.confusion_table(V.resolve_prob(class_predictions(spark, sf)), threshold=0.7)


@query("c3_threshold_metrics", sql(CLS, PROB, CONF, """pq AS (SELECT *, coalesce(tp/nullif(tp+fp, 0), 0) AS p,
 coalesce(tp/nullif(tp+fn, 0), 0) AS r FROM cf)""", body=f"""SELECT part, {rr('(tp+tn)/(tp+tn+fp+fn)', 'acc')}, {rr('p', 'precision')},
{rr('r', 'recall')}, {rr('coalesce(2*p*r/nullif(p+r, 0), 0)', 'f1')}, tp+tn+fp+fn AS n FROM pq"""))
def c3(spark, sf):
    out = V.classification_metrics(class_predictions(spark, sf), ["acc", "precision", "recall", "f1"], threshold=0.7)
    return rounded(out, "acc", "precision", "recall", "f1")


AUC = """ar AS (SELECT part, y_true, rank() OVER (PARTITION BY part ORDER BY y_prob) + (count(*) OVER (PARTITION BY part, y_prob) - 1)/2e0 AS r FROM pr),
au AS (SELECT part, (sum(r) FILTER (y_true = 1) - count(*) FILTER (y_true = 1)*(count(*) FILTER (y_true = 1) + 1)/2e0)
 / (count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0)) AS auc FROM ar GROUP BY part)"""


@query("c4_auc", sql(CLS, PROB, AUC, body=f"SELECT part, {rr('coalesce(auc, 0)', 'auc')} FROM au"))
def c4(spark, sf):
    return rounded(V.auc_ks(V.resolve_prob(class_predictions(spark, sf))).select("part", "auc"), "auc")


@query("c5_ks", sql(CLS, PROB, STEPS, """cu AS (SELECT part, sum(pos) OVER w / np - sum(neg) OVER w / nn AS d FROM st JOIN tt USING (part)
 WINDOW w AS (PARTITION BY part ORDER BY y_prob))""", body=f"SELECT part, {rr('max(abs(d))', 'ks')} FROM cu GROUP BY part"))
def c5(spark, sf):
    return rounded(V.auc_ks(V.resolve_prob(class_predictions(spark, sf))).select("part", "ks"), "ks")


CURVE = """cv AS (SELECT part, y_prob, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, np, nn FROM st JOIN tt USING (part)
 WINDOW w AS (PARTITION BY part ORDER BY y_prob DESC))"""


@query("c6_roc_points", sql(CLS, PROB, STEPS, CURVE, body=f"""SELECT part, {rr('y_prob', 'y_prob', 8)},
{rr('cn/greatest(nn, 1)', 'fpr')}, {rr('cp/greatest(np, 1)', 'tpr')} FROM cv"""))
def c6(spark, sf):
    out = V.roc_points(V.resolve_prob(class_predictions(spark, sf)))
    return rounded(rounded(out, "y_prob", digits=8), "fpr", "tpr")


@query("c7_pr_points", sql(CLS, PROB, STEPS, CURVE, body=f"""SELECT part, {rr('y_prob', 'y_prob', 8)},
{rr('cp/greatest(np, 1)', 'recall')}, {rr('cp/greatest(cp+cn, 1)', 'precision')} FROM cv"""))
def c7(spark, sf):
    out = V.pr_points(V.resolve_prob(class_predictions(spark, sf)))
    return rounded(rounded(out, "y_prob", digits=8), "recall", "precision")


@query("c8_metric_dispatch", sql(CLS, PROB, CONF, AUC, body=f"""SELECT part, {rr('coalesce(auc, 0)', 'auc')},
{rr('coalesce(tp/nullif(tp+fn, 0), 0)', 'recall')}, tp+tn+fp+fn AS n FROM cf JOIN au USING (part)"""))
def c8(spark, sf):
    out = V.part_metrics(class_predictions(spark, sf), ["auc", "recall"], task="classification", threshold=0.7)
    return rounded(out, "auc", "recall")


# --- stitching, sampling, runs -------------------------------------------------


def _overlapping(spark, sf):
    """Predictions in which each fold also repeats the dates of the fold before it, one unit higher."""
    p = staged(predictions(spark, sf))
    again = p.withColumns({"fold": F.col("fold") + 1, "y_pred": F.col("y_pred") + 1})
    return p.unionByName(again.where("fold % 2 = 0"))


@query("k3_stitch", sql(*BASE, body="""SELECT date, stockid, y_pred + CASE WHEN (fold + 1) % 2 = 0 THEN 1 ELSE 0 END AS y_pred FROM pred"""))
def k3(spark, sf):
    return V.stitch(_overlapping(spark, sf), order=["fold"]).select("date", "stockid", "y_pred")


@query("k5_stratified_sample", sql(*BASE, """c AS (SELECT part, count(*) AS n, sum(count(*)) OVER () AS t FROM pred GROUP BY part)""",
    body="SELECT part, CAST(least(greatest(round(500e0*n/t), 1), n) AS BIGINT) AS n FROM c"))
def k5(spark, sf):
    return V.stratified_sample(predictions(spark, sf), 500).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("u1_concat_predictions", sql(*BASE, body=f"""SELECT date, stockid, {rr('y_true')}, y_pred, part,
CASE WHEN part = 'test' THEN 'm' END AS model_name FROM pred WHERE part <> 'train'"""))
def u1(spark, sf):
    p = staged(predictions(spark, sf))
    test = p.where("part = 'test'").withColumn("model_name", F.lit("m"))
    out = V.concat_predictions([test, p.where("part = 'future'")])
    return rounded(out.select("date", "stockid", "y_true", "y_pred", "part", "model_name"), "y_true")


@query("b1_evaluation_run", sql(*BASE, PIC, """m AS (SELECT part, avg(abs(y_true-y_pred)) AS mae, count(*) AS n FROM pred GROUP BY part),
s AS (SELECT part, avg(ic) AS rankic, count(*) AS n_dates FROM pic GROUP BY part),
j AS (SELECT part, mae, rankic, n, n_dates FROM m JOIN s USING (part))""", body=f"""SELECT 'all' AS report, part, {rr('mae', 'mae', 5)}, {rr('rankic')}, n, n_dates FROM j
UNION ALL SELECT 'test', part, round(mae, 5) + 0.0, round(rankic, 6) + 0.0, n, n_dates FROM j WHERE part = 'test'
UNION ALL SELECT 'future', 'future_all', round(mae, 5) + 0.0, round(rankic, 6) + 0.0, n, n_dates FROM j WHERE part = 'future'"""))
def b1(spark, sf):
    path = stage_path(spark, "preds")
    T.write_predictions(predictions(spark, sf), path)
    tables = V.evaluation_run(T.read_predictions(spark, path), metrics=["mae", "rankic"])
    out = V.concat_predictions([t.select(F.lit(k).alias("report"), "*") for k, t in tables.items()])
    return rounded(rounded(out, "mae", digits=5), "rankic")


@query("b2_factor_source", sql(*BASE, body="""SELECT date, stockid, y_pred + CASE WHEN (fold + 1) % 2 = 0 THEN 1 ELSE 0 END AS y_pred,
'stitched_part_test' AS source FROM pred WHERE part = 'test'"""))
def b2(spark, sf):
    df, source = V.factor_source("rolling", predictions=_overlapping(spark, sf))
    return df.withColumn("source", F.lit(source))


@query("b3_chart_tables", sql(*BASE, PIC, QB.replace("FROM pred)", "FROM pred WHERE part = 'test')"), body=f"""
SELECT 'quantile_mean' AS chart, CAST(i AS BIGINT) AS bin, {rr('coalesce(m, 0)', 'value')} FROM range(10) t(i)
 LEFT JOIN (SELECT quantile, avg(ret) AS m FROM dq GROUP BY 1) ON i = quantile
UNION ALL SELECT 'dates', CAST(NULL AS BIGINT), CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT part, date FROM pred)"""))
def b3(spark, sf):
    charts = V.chart_tables(predictions(spark, sf))
    means = charts["quantile_mean"].select(F.lit("quantile_mean").alias("chart"), F.col("quantile").alias("bin"),
                                           r6("mean_ret").alias("value"))
    dates = charts["time_curve"].agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("dates").alias("chart"), F.lit(None).cast("long").alias("bin"), "value")
    return means.unionByName(dates)


GR = f"""gr0 AS (SELECT date, stockid, y AS ret, row_number() OVER (PARTITION BY date ORDER BY f_qty, stockid) AS r,
 count(*) OVER (PARTITION BY date) AS n FROM lab WHERE y IS NOT NULL),
gr AS (SELECT date, stockid, ret, 1 + {bucket_sql('r', 'n', 5)} AS grp FROM gr0),
di AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM gr))"""


def _leg_sql(name, groups, excess):
    minus = f" - (SELECT avg(ret) FROM gr m WHERE m.date = g.date)" if excess else ""
    return f"""{name}m AS (SELECT i, date, stockid, ret, 1e0/count(*) OVER (PARTITION BY date) AS w FROM gr JOIN di USING (date) WHERE grp IN {groups}),
{name}c AS (SELECT i, stockid, w, 0e0 AS o FROM {name}m UNION ALL SELECT i + 1, stockid, 0e0, w FROM {name}m),
{name}t AS (SELECT i, sum(abs(d)) * CASE WHEN i = 0 THEN 1e0 ELSE 0.5e0 END AS turnover FROM
 (SELECT i, stockid, sum(w) - sum(o) AS d FROM {name}c GROUP BY 1, 2) GROUP BY i),
{name} AS (SELECT date, avg(ret){minus} AS ret, any_value(turnover) AS turnover FROM {name}m g JOIN {name}t USING (i) GROUP BY date)"""


BT = B.BacktestSettings(group_num=5, long_groups=(4, 5), short_groups=(1,), portfolio_type="long_short", turnover_fee_rate=0.001)


@query("b4_group_backtest", sql(PANEL_M, LAB, GR, _leg_sql("lo", "(4, 5)", False), _leg_sql("sh", "(1)", False),
    "dl AS (SELECT date, lo.ret - sh.ret AS gross, lo.turnover + sh.turnover AS turnover FROM lo JOIN sh USING (date))",
    body=f"""SELECT date, {rr('gross')}, {rr('turnover')}, {rr('turnover*0.001', 'fee', 7)}, {rr('gross - turnover*0.001', 'net')},
{rr('product(1 + gross - turnover*0.001) OVER (ORDER BY date) - 1', 'cum_net', 4)} FROM dl"""))
def b4(spark, sf):
    rows = staged(labelled(spark, sf).where("y is not null").select("date", "stockid", "f_qty", F.col("y").alias("ret")))
    groups = staged(B.factor_groups(rows, rows, BT, value="f_qty"))
    out = B.group_backtest(groups, BT)
    return rounded(rounded(rounded(out, "gross", "turnover", "net"), "fee", digits=7), "cum_net", digits=4)


@query("b4_group_backtest_excess", sql(PANEL_M, LAB, GR, _leg_sql("lo", "(4, 5)", True),
    body=f"SELECT date, {rr('ret', 'gross')}, {rr('turnover')} FROM lo"))
def b4_excess(spark, sf):
    rows = staged(labelled(spark, sf).where("y is not null").select("date", "stockid", "f_qty", F.col("y").alias("ret")))
    s = B.BacktestSettings(group_num=5, long_groups=(4, 5), excess_return=True)
    out = B.group_backtest(staged(B.factor_groups(rows, rows, s, value="f_qty")), s)
    return rounded(out.select("date", "gross", "turnover"), "gross", "turnover")


@query("b4_group_returns", sql(PANEL_M, LAB, GR, body=f"""SELECT date, grp AS "group",
{rr('avg(ret) - (SELECT avg(ret) FROM gr m WHERE m.date = gr.date)', 'ret')} FROM gr GROUP BY date, grp"""))
def b4_groups(spark, sf):
    rows = staged(labelled(spark, sf).where("y is not null").select("date", "stockid", "f_qty", F.col("y").alias("ret")))
    groups = staged(B.factor_groups(rows, rows, BT, value="f_qty"))
    return rounded(B.group_returns(groups, excess=True), "ret")


@query("b5_evaluation_meta", sql(*BASE, body="""SELECT 'stitched_part_test' AS source, count(*) AS n_rows,
count(DISTINCT date) AS n_dates, count(DISTINCT stockid) AS n_stocks, min(date) AS first_date, max(date) AS last_date
FROM pred WHERE part = 'test'"""))
def b5(spark, sf):
    df, source = V.factor_source("rolling", predictions=predictions(spark, sf))
    return B.evaluation_meta(spark, df, source, BT).drop("params")
