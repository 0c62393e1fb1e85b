"""Labels, rolling features, cleaning statistics, folds, weights, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.base import (
    CLS, GAPS, LAB, PANEL_E, PANEL_M, PANEL_W, PRED, class_predictions, labelled, panel_e, panel_m, panel_w, predictions,
    query, r6, rounded, rr, saved_labels, sql, table, with_gaps,
)
from panelyard.functions import losses as E
from panelyard.operators import cross_section as X
from panelyard.operators import folds as D
from panelyard.operators import label as L
from panelyard.operators import rolling as W
from panelyard.operators import weights as S
from panelyard.operators.clean import CleanSettings, PanelCleaner
from panelyard.plans.skew import add_ranks
from panelyard.plans.stage import stage

# --- labels --------------------------------------------------------------------


@query("l1_forward_return", sql(PANEL_M, LAB, body=f"SELECT date, stockid, {rr('y')} FROM lab"))
def l1(spark, sf):
    return rounded(labelled(spark, sf).select("date", "stockid", "y"), "y")


@query("l1_forward_log_return", sql(PANEL_M, body=f"""SELECT date, stockid,
{rr('ln(lead(px, 2) OVER ws) - ln(lead(px, 1) OVER ws)', 'y')} FROM panel WINDOW ws AS (PARTITION BY stockid ORDER BY date)"""))
def l1_log(spark, sf):
    return rounded(L.forward_return(panel_m(spark, sf), "px", log=True).select("date", "stockid", "y"), "y")


# f_disc has ties and gaps, so it exercises every rank method and missing-value option
_RANK = "rank() OVER (PARTITION BY date ORDER BY v NULLS LAST)"
_PEERS = "count(*) OVER (PARTITION BY date, v)"
_METHODS = {
    "average": f"({_RANK} + ({_PEERS} - 1)/2e0)", "min": f"CAST({_RANK} AS DOUBLE)",
    "max": f"({_RANK} + {_PEERS} - 1e0)",
    "first": "CAST(row_number() OVER (PARTITION BY date ORDER BY v NULLS LAST, stockid) AS DOUBLE)",
    "dense": "CAST(dense_rank() OVER (PARTITION BY date ORDER BY v NULLS LAST) AS DOUBLE)"}
RKV = "rv AS (SELECT date, stockid, round(f_disc, 2) AS v FROM gaps)"


def _rank_input(spark, sf):
    return with_gaps(spark, sf).select("date", "stockid", F.round("f_disc", 2).alias("y"))


for _m, _expr in _METHODS.items():
    _distinct = "(SELECT count(DISTINCT v) FROM rv b WHERE b.date = rv.date)"

    @query(f"l2_rank_label_{_m}", sql(PANEL_M, LAB, GAPS, RKV, body=f"""SELECT date, stockid,
CASE WHEN v IS NOT NULL THEN {rr(f"{_expr} / {_distinct if _m == 'dense' else 'count(v) OVER (PARTITION BY date)'}", 'y').replace(' AS y', '')} END AS y
FROM rv"""))
    def l2(spark, sf, m=_m):
        return rounded(L.rank_label(_rank_input(spark, sf), method=m), "y")


@query("l2_rank_label_top", sql(PANEL_M, LAB, GAPS, RKV, body=f"""SELECT date, stockid, CASE WHEN v IS NOT NULL THEN
round(({_METHODS['average']} + count(*) OVER (PARTITION BY date) - count(v) OVER (PARTITION BY date))
 / count(*) OVER (PARTITION BY date), 6) + 0.0 END AS y FROM rv"""))
def l2_top(spark, sf):
    return rounded(L.rank_label(_rank_input(spark, sf), na_option="top"), "y")


@query("l2_rank_label_centered", sql(PANEL_M, LAB, GAPS, RKV, body=f"""SELECT date, stockid, CASE WHEN v IS NOT NULL THEN
round({_METHODS['average']} - (count(v) OVER (PARTITION BY date) + 1)/2e0, 6) + 0.0 END AS y FROM rv"""))
def l2_centered(spark, sf):
    return rounded(L.rank_label(_rank_input(spark, sf), pct=False, centered=True), "y")


ZL = """z AS (SELECT date, stockid, (y - avg(y) OVER d) / (coalesce(stddev_pop(y) OVER d, 0) + 1e-12) AS y FROM lab
 WINDOW d AS (PARTITION BY date))"""


@query("l3_zscore_label", sql(PANEL_M, LAB, ZL, body=f"SELECT date, stockid, {rr('y')} FROM z"))
def l3(spark, sf):
    return rounded(L.zscore_label(saved_labels(spark, sf).select("date", "stockid", "y")), "y")


@query("l4_clip_label", sql(PANEL_M, LAB, body=f"""SELECT date, stockid,
CASE WHEN y IS NOT NULL THEN round(greatest(least(y, 0.25), -0.1), 6) + 0.0 END AS y FROM lab"""))
def l4(spark, sf):
    return rounded(L.clip_label(labelled(spark, sf).select("date", "stockid", "y"), [-0.1, 0.25]), "y")


WL = """q AS (SELECT date, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM lab GROUP BY date)"""


@query("l5_winsorize_label", sql(PANEL_M, LAB, WL, body="""SELECT date, stockid,
CASE WHEN y IS NOT NULL THEN round(greatest(least(y, hi), lo), 6) + 0.0 END AS y FROM lab JOIN q USING (date)"""))
def l5(spark, sf):
    return rounded(L.winsorize_label(saved_labels(spark, sf).select("date", "stockid", "y")), "y")


@query("l6_label_chain", sql(PANEL_M, LAB, """rk AS (SELECT date, stockid, y AS y_raw, CASE WHEN y IS NOT NULL THEN
 (rank() OVER (PARTITION BY date ORDER BY y NULLS LAST) + (count(*) OVER (PARTITION BY date, y) - 1)/2e0)
 / count(y) OVER (PARTITION BY date) - 0.5 END AS y FROM lab)""",
    """z AS (SELECT date, stockid, y_raw, (y - avg(y) OVER d) / (coalesce(stddev_pop(y) OVER d, 0) + 1e-12) AS y FROM rk
 WINDOW d AS (PARTITION BY date))""",
    "c AS (SELECT date, stockid, y_raw, CASE WHEN y IS NOT NULL THEN greatest(least(y, 1.5), -1.5) END AS y FROM z)",
    "q AS (SELECT date, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM c GROUP BY date)",
    body=f"""SELECT date, stockid, {rr('y_raw')},
CASE WHEN y IS NOT NULL THEN round(greatest(least(y, hi), lo), 6) + 0.0 END AS y FROM c JOIN q USING (date)"""))
def l6(spark, sf):
    out = L.postprocess_label(saved_labels(spark, sf).select("date", "stockid", "y"), keep_raw=True,
                              rank={"centered": True}, zscore={}, clip=1.5, winsorize={"lower": 0.1, "upper": 0.9})
    return rounded(out, "y", "y_raw")


@query("w17_volatility_label", sql(PANEL_M, LAB, body=f"""SELECT date, stockid, {rr('''y / nullif(CASE WHEN count(y) OVER ws >= 3
THEN stddev_samp(y) OVER ws END, 0)''', 'y_vol')} FROM lab
WINDOW ws AS (PARTITION BY stockid ORDER BY date ROWS BETWEEN 7 PRECEDING AND 2 PRECEDING)"""))
def w17(spark, sf):
    out = L.volatility_scaled_label(labelled(spark, sf), window=6, min_periods=3)
    return rounded(out.select("date", "stockid", "y_vol"), "y_vol")


# --- rolling, fill, sequences --------------------------------------------------


# ten digits: means of short decimals often end in an exact 5 at the seventh
def _roll_sql(stat, fn, w, mp):
    frame = f"OVER (PARTITION BY stockid ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count(f_disc) {frame} >= {mp} THEN {fn}(f_disc) {frame} END, 10) + 0.0 AS f_disc__roll_{stat}_{w}"


@query("w1_rolling_mean", sql(PANEL_M, LAB, GAPS, body=f"""SELECT date, stockid, {_roll_sql('mean', 'avg', 5, 3)} FROM gaps"""))
def w1(spark, sf):
    out = W.rolling_stats(with_gaps(spark, sf).select("date", "stockid", "f_disc"), ["f_disc"], [5],
                          stats=["mean"], min_periods=3)
    return rounded(out.drop("f_disc"), "f_disc__roll_mean_5", digits=10)


@query("w2_rolling_std", sql(PANEL_M, LAB, GAPS, body=f"SELECT date, stockid, {_roll_sql('std', 'stddev_samp', 5, 3)} FROM gaps"))
def w2(spark, sf):
    out = W.rolling_stats(with_gaps(spark, sf).select("date", "stockid", "f_disc"), ["f_disc"], [5],
                          stats=["std"], min_periods=3, ddof=1)
    return rounded(out.drop("f_disc"), "f_disc__roll_std_5", digits=10)


@query("w3_feature_stage", sql(PANEL_W, body="SELECT date, stockid, " + ", ".join(
    _roll_sql(s, f, w, w) for w in (5, 10, 20) for s, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM panel"))
def w3(spark, sf):
    out = W.feature_stage(panel_w(spark, sf).select("date", "stockid", "f_disc"), features=["f_disc"])
    return rounded(out.drop("f_disc"), *[c for c in out.columns if "__roll_" in c], digits=10)


@query("w4_average_rank", sql(PANEL_M, body="""SELECT date, stockid,
rank() OVER (PARTITION BY date ORDER BY f_qty) + (count(*) OVER (PARTITION BY date, f_qty) - 1)/2e0 AS r FROM panel"""))
def w4(spark, sf):
    return add_ranks(panel_m(spark, sf).select("date", "stockid", "f_qty"), ["date"], "f_qty", "r").drop("f_qty")


@query("w5_rank_methods", sql(PANEL_M, body="""SELECT date, stockid,
CAST(rank() OVER d AS DOUBLE) AS r_min, rank() OVER d + count(*) OVER (PARTITION BY date, f_qty) - 1e0 AS r_max,
CAST(row_number() OVER (PARTITION BY date ORDER BY f_qty, stockid) AS DOUBLE) AS r_first,
CAST(dense_rank() OVER d AS DOUBLE) AS r_dense FROM panel WINDOW d AS (PARTITION BY date ORDER BY f_qty)"""))
def w5(spark, sf):
    out = stage(panel_m(spark, sf).select("date", "stockid", "f_qty"))
    for m in ("min", "max", "first", "dense"):
        out = add_ranks(out, ["date"], "f_qty", f"r_{m}", method=m, tie_break=["stockid"])
    return out.drop("f_qty")


@query("w6_percentile_rank", sql(PANEL_M, LAB, GAPS, RKV, body=f"""SELECT date, stockid, CASE WHEN v IS NOT NULL THEN
round({_METHODS['max']} / count(*) OVER (PARTITION BY date), 6) + 0.0 END AS r FROM rv"""))
def w6(spark, sf):
    out = add_ranks(_rank_input(spark, sf), ["date"], "y", "r", method="max", pct=True, na_option="bottom")
    return rounded(out.drop("y"), "r")


_FF = "last_value(f_disc IGNORE NULLS) OVER (PARTITION BY stockid ORDER BY date ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"


@query("w7_forward_fill", sql(PANEL_M, LAB, GAPS, body=f"""SELECT date, stockid,
{rr('coalesce(f_disc, ' + _FF.format(2) + ')', 'f_disc')} FROM gaps"""))
def w7(spark, sf):
    return rounded(W.forward_fill(with_gaps(spark, sf).select("date", "stockid", "f_disc"), ["f_disc"], limit=2), "f_disc")


SEQ = """sq AS (SELECT date, stockid, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY stockid) AS m,
 count(*) OVER f AS k, sum(f_view + 10*f_click + 100*f_error + 1000*f_signup + 10000*f_purchase) OVER f AS total, first_value(f_view) OVER f AS first_view
 FROM (SELECT *, CAST(n AS DOUBLE) AS y FROM panel) WINDOW w AS (PARTITION BY stockid ORDER BY date),
 f AS (PARTITION BY stockid ORDER BY date ROWS BETWEEN 26 PRECEDING AND CURRENT ROW))"""


def _seq_panel(spark, sf):
    return panel_e(spark, sf).withColumn("y", F.col("n").cast("double"))


_KINDS = ["f_view", "f_click", "f_error", "f_signup", "f_purchase"]


def _seq_total(df):
    """Sum over the sequence in which each event type has its own power of ten."""
    weighed = F.transform(F.flatten("seq"), lambda x, i: x * F.pow(F.lit(10.0), i % len(_KINDS)))
    return F.aggregate(weighed, F.lit(0.0), lambda acc, x: acc + x)


@query("w12_sequences_drop", sql(PANEL_E, SEQ, body="""SELECT date, stockid, y, CAST(total AS DOUBLE) AS total,
CAST(first_view AS DOUBLE) AS first_view, CAST(27 AS BIGINT) AS len FROM sq WHERE i >= 27"""))
def w12_drop(spark, sf):
    s = W.sequences(_seq_panel(spark, sf), _KINDS, 27)
    return s.select("date", "stockid", "y", _seq_total(s).alias("total"), F.col("seq")[0][0].alias("first_view"),
                    F.size("seq").cast("long").alias("len"))


@query("w12_sequences_pad_zero", sql(PANEL_E, SEQ, body="""SELECT date, stockid, y, CAST(total AS DOUBLE) AS total,
CASE WHEN m < 27 THEN 0e0 ELSE CAST(first_view AS DOUBLE) END AS first_view, CAST(27 AS BIGINT) AS len,
CAST(k AS BIGINT) AS real FROM sq WHERE i >= 27 OR (m < 27 AND i = m)"""))
def w12_zero(spark, sf):
    s = W.sequences(_seq_panel(spark, sf), _KINDS, 27, incomplete="pad_zero", with_mask=True)
    return s.select("date", "stockid", "y", _seq_total(s).alias("total"), F.col("seq")[0][0].alias("first_view"),
                    F.size("seq").cast("long").alias("len"),
                    F.size(F.filter("mask", lambda b: b)).cast("long").alias("real"))


@query("w12_sequences_pad_first", sql(PANEL_E, SEQ, body="""SELECT date, stockid, y,
CAST(first_view AS DOUBLE) AS first_view, CAST(27 AS BIGINT) AS len FROM sq WHERE i >= 27 OR (m < 27 AND i = m)"""))
def w12_first(spark, sf):
    s = W.sequences(_seq_panel(spark, sf), _KINDS, 27, incomplete="pad_first", pad_side="left")
    return s.select("date", "stockid", "y", F.col("seq")[0][0].alias("first_view"), F.size("seq").cast("long").alias("len"))


# --- cross-section statistics --------------------------------------------------

FS = ("f_qty", "f_disc", "f_tax")


@query("w8_winsorize_by_date", sql(PANEL_M, LAB, GAPS, """q AS (SELECT date, quantile_cont(f_qty, 0.05) AS a1,
 quantile_cont(f_qty, 0.9) AS b1, quantile_cont(f_disc, 0.05) AS a2, quantile_cont(f_disc, 0.9) AS b2 FROM gaps GROUP BY date)""",
    body="""SELECT date, stockid, CASE WHEN f_qty IS NOT NULL THEN round(greatest(least(f_qty, b1), a1), 6) + 0.0 END AS f_qty,
CASE WHEN f_disc IS NOT NULL THEN round(greatest(least(f_disc, b2), a2), 6) + 0.0 END AS f_disc FROM gaps JOIN q USING (date)"""))
def w8(spark, sf):
    out = X.winsorize_by_date(with_gaps(spark, sf).select("date", "stockid", "f_qty", "f_disc"), ["f_qty", "f_disc"],
                              lower=0.05, upper=0.9)
    return rounded(out, "f_qty", "f_disc")


@query("w9_zscore_by_date", sql(PANEL_M, LAB, GAPS, body="""SELECT date, stockid,
round(greatest(least(coalesce((f_qty - avg(f_qty) OVER d) / nullif(stddev_pop(f_qty) OVER d, 0), 0), 2), -2), 6) + 0.0 AS f_qty,
round(greatest(least(coalesce((f_disc - avg(f_disc) OVER d) / nullif(stddev_pop(f_disc) OVER d, 0), 0), 2), -2), 6) + 0.0 AS f_disc
FROM gaps WINDOW d AS (PARTITION BY date)"""))
def w9(spark, sf):
    out = X.zscore_by_date(with_gaps(spark, sf).select("date", "stockid", "f_qty", "f_disc"), ["f_qty", "f_disc"], clip=2.0)
    return rounded(out, "f_qty", "f_disc")


@query("w10_robust_zscore", sql(PANEL_M, LAB, GAPS,
    "md AS (SELECT date, median(f_qty) AS m FROM gaps GROUP BY date)",
    "ad AS (SELECT date, median(abs(f_qty - m)) AS d FROM gaps JOIN md USING (date) GROUP BY date)",
    body="""SELECT date, stockid, round(greatest(least((f_qty - m) / (d + 1e-12) * 0.6745, 5), -5), 6) + 0.0 AS f_qty
FROM gaps JOIN md USING (date) JOIN ad USING (date)"""))
def w10(spark, sf):
    out = X.robust_zscore_by_date(with_gaps(spark, sf).select("date", "stockid", "f_qty"), ["f_qty"], scaled=True, clip=5.0)
    return rounded(out, "f_qty")


def _one_row(df, values, prefix=""):
    """Driver-side statistics of a table as rows ``(factor, value)``."""
    return df.sparkSession.createDataFrame([(k, v) for k, v in values.items()], "factor string, value double").select(
        "factor", r6("value").alias("value"))


def _stats_sql(fn):
    return sql(PANEL_M, LAB, GAPS, body=" UNION ALL ".join(
        f"SELECT '{c}' AS factor, round({fn.format(c=c)}, 6) + 0.0 AS value FROM gaps" for c in FS))


@query("a1_means", _stats_sql("avg({c})"))
def a1_means(spark, sf):
    g = with_gaps(spark, sf)
    return _one_row(g, X.column_means(g, FS))


@query("a1_medians", _stats_sql("median({c})"))
def a1_medians(spark, sf):
    g = with_gaps(spark, sf)
    return _one_row(g, X.column_medians(g, FS))


@query("a2_quantiles", sql(PANEL_M, LAB, GAPS, body=" UNION ALL ".join(
    f"SELECT '{c}' AS factor, round(quantile_cont({c}, 0.01), 6) + 0.0 AS lo, round(quantile_cont({c}, 0.99), 6) + 0.0 AS hi FROM gaps"
    for c in FS)))
def a2(spark, sf):
    g = with_gaps(spark, sf)
    rows = [(c, *q) for c, q in X.column_quantiles(g, FS, [0.01, 0.99]).items()]
    return rounded(spark.createDataFrame(rows, "factor string, lo double, hi double"), "lo", "hi")


@query("a3_std", _stats_sql("stddev_samp({c})"))
def a3(spark, sf):
    g = with_gaps(spark, sf)
    return _one_row(g, X.column_std(g, FS, ddof=1))


@query("a4_mad", sql(PANEL_M, LAB, GAPS, body=" UNION ALL ".join(
    f"SELECT '{c}' AS factor, round(median(abs({c} - (SELECT median({c}) FROM gaps))), 6) + 0.0 AS value FROM gaps" for c in FS)))
def a4(spark, sf):
    g = with_gaps(spark, sf)
    return _one_row(g, X.column_mad(g, FS, X.column_medians(g, FS)))


# --- cleaning ------------------------------------------------------------------

CLEAN = CleanSettings(fill="median", winsorize="date", lower=0.05, upper=0.95, zscore="date", masks=True,
                      max_row_missing=0.5)
CLEAN_SQL = [
    PANEL_M, LAB, GAPS,
    """k AS (SELECT * FROM gaps WHERE y IS NOT NULL AND
 (CASE WHEN f_disc IS NULL THEN 1 ELSE 0 END + CASE WHEN f_tax IS NULL THEN 1 ELSE 0 END)/2e0 <= 0.5)""",
    "md AS (SELECT median(f_disc) AS m1, median(f_tax) AS m2 FROM k)",
    "fl AS (SELECT date, stockid, y, coalesce(f_disc, m1) AS f_disc, coalesce(f_tax, m2) AS f_tax FROM k, md)",
    """q AS (SELECT date, quantile_cont(f_disc, 0.05) AS a1, quantile_cont(f_disc, 0.95) AS b1,
 quantile_cont(f_tax, 0.05) AS a2, quantile_cont(f_tax, 0.95) AS b2 FROM fl GROUP BY date)""",
    """wz AS (SELECT date, stockid, y, greatest(least(f_disc, b1), a1) AS f_disc, greatest(least(f_tax, b2), a2) AS f_tax
 FROM fl JOIN q USING (date))"""]


@query("m1_clean_fit", sql(*CLEAN_SQL, body=f"""SELECT date, stockid, {rr('y')},
round(coalesce((f_disc - avg(f_disc) OVER d) / nullif(stddev_pop(f_disc) OVER d, 0), 0), 5) + 0.0 AS f_disc,
round(coalesce((f_tax - avg(f_tax) OVER d) / nullif(stddev_pop(f_tax) OVER d, 0), 0), 5) + 0.0 AS f_tax,
CASE WHEN k.f_disc IS NULL THEN 1e0 ELSE 0e0 END AS f_disc__miss, CASE WHEN k.f_tax IS NULL THEN 1e0 ELSE 0e0 END AS f_tax__miss
FROM wz JOIN (SELECT date, stockid, f_disc, f_tax FROM k) k USING (date, stockid) WINDOW d AS (PARTITION BY date)"""
    .replace("(f_disc -", "(wz.f_disc -").replace("avg(f_disc)", "avg(wz.f_disc)").replace("stddev_pop(f_disc)", "stddev_pop(wz.f_disc)")
    .replace("(f_tax -", "(wz.f_tax -").replace("avg(f_tax)", "avg(wz.f_tax)").replace("stddev_pop(f_tax)", "stddev_pop(wz.f_tax)")))
def m1(spark, sf):
    _, out = PanelCleaner(CLEAN).fit_transform(with_gaps(spark, sf), ["f_disc", "f_tax"])
    out = out.select("date", "stockid", "y", "f_disc", "f_tax", F.col("f_disc__miss").cast("double").alias("f_disc__miss"),
                     F.col("f_tax__miss").cast("double").alias("f_tax__miss"))
    return rounded(rounded(out, "y"), "f_disc", "f_tax", digits=5)


SPLIT = "DATE '1999-06-01'"


@query("m2_clean_transform", sql(PANEL_M, LAB, GAPS,
    f"ft AS (SELECT * FROM gaps WHERE y IS NOT NULL AND date < {SPLIT})",
    "md AS (SELECT avg(f_disc) AS m1 FROM ft)",
    "f1 AS (SELECT coalesce(f_disc, m1) AS f_disc FROM ft, md)",
    "q AS (SELECT quantile_cont(f_disc, 0.05) AS lo, quantile_cont(f_disc, 0.95) AS hi FROM f1)",
    "s AS (SELECT avg(greatest(least(f_disc, hi), lo)) AS mu, stddev_pop(greatest(least(f_disc, hi), lo)) AS sd FROM f1, q)",
    body=f"""SELECT date, stockid, {rr('(greatest(least(coalesce(f_disc, m1), hi), lo) - mu) / sd', 'f_disc', 5)}
FROM gaps, md, q, s WHERE date >= {SPLIT}"""))
def m2(spark, sf):
    g = with_gaps(spark, sf)
    s = CleanSettings(fill="mean", winsorize="global", lower=0.05, upper=0.95, zscore="global")
    model = PanelCleaner(s).fit(g.where("date < '1999-06-01'"), ["f_disc"])
    out = model.transform(g.where("date >= '1999-06-01'"), validate=True)
    return rounded(out.select("date", "stockid", "f_disc"), "f_disc", digits=5)


for _fill, _sql in {
    "zero": "coalesce(f_disc, 0)", "mean": "coalesce(f_disc, (SELECT avg(f_disc) FROM lbl))",
    "median": "coalesce(f_disc, (SELECT median(f_disc) FROM lbl))",
    "ffill_then_zero": "coalesce(f_disc, " + _FF.format(3) + ", 0)",
    "ffill_all": "coalesce(f_disc, " + _FF.format("UNBOUNDED") + ")",
}.items():
    @query(f"m3_fill_{_fill}", sql(PANEL_M, LAB, GAPS, "lbl AS (SELECT * FROM gaps WHERE y IS NOT NULL)",
                                   body=f"SELECT date, stockid, {rr(_sql, 'f_disc')} FROM lbl"))
    def m3(spark, sf, fill=_fill):
        s = CleanSettings(policy="tree_friendly", fill_for_tree=True, fill=fill, ffill_limit=3)
        _, out = PanelCleaner(s).fit_transform(with_gaps(spark, sf), ["f_disc"])
        return rounded(out.select("date", "stockid", "f_disc"), "f_disc")


@query("m4_global_robust", sql(PANEL_M, LAB, "lbl AS (SELECT * FROM lab WHERE y IS NOT NULL)",
    "q AS (SELECT quantile_cont(f_qty, 0.02) AS lo, quantile_cont(f_qty, 0.98) AS hi FROM lbl)",
    "w AS (SELECT date, stockid, greatest(least(f_qty, hi), lo) AS x FROM lbl, q)",
    "m AS (SELECT median(x) AS m FROM w)", "d AS (SELECT median(abs(x - m)) AS d FROM w, m)",
    body=f"SELECT date, stockid, {rr('(x - m) / (d + 1e-12) * 0.6745', 'f_qty')} FROM w, m, d"))
def m4(spark, sf):
    s = CleanSettings(winsorize="global", lower=0.02, upper=0.98, zscore="global", method="robust", scaled=True)
    _, out = PanelCleaner(s).fit_transform(saved_labels(spark, sf), ["f_qty"])
    return rounded(out.select("date", "stockid", "f_qty"), "f_qty")


# --- folds and windows ---------------------------------------------------------

DX = """dx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n
 FROM (SELECT DISTINCT date FROM panel))"""


def _fold_sql(spans: str) -> str:
    return sql(PANEL_M, DX, *spans.split(";;"), body="""SELECT CAST(fold AS BIGINT) AS fold, part, a.date AS date_start, b.date AS date_end
FROM sp JOIN dx a ON a.idx = i0 JOIN dx b ON b.idx = i1""")


@query("f1_holdout_split", _fold_sql("""c AS (SELECT count(*) AS n, CAST(floor(count(*)*0.6) AS BIGINT) AS nt,
 CAST(floor(count(*)*0.15) AS BIGINT) AS nv FROM dx);;sp AS (SELECT 0 AS fold, 'train' AS part, 0 AS i0, nt-1 AS i1 FROM c
 UNION ALL SELECT 0, 'valid', nt, nt+nv-1 FROM c UNION ALL SELECT 0, 'test', nt+nv, n-1 FROM c)"""))
def f1(spark, sf):
    index = stage(D.date_index(panel_m(spark, sf)))
    return D.holdout_folds(index, train=0.6, valid=0.15, test=0.25).select("fold", "part", "date_start", "date_end")


@query("f2_step_ratio", _fold_sql("""c AS (SELECT n, CAST(floor(n*0.4) AS BIGINT) AS w, greatest(CAST(floor(n*0.07) AS BIGINT), 1) AS st
 FROM (SELECT count(*) AS n FROM dx));;fs AS (SELECT s // st AS fold, s, w, CAST(floor(w*0.8) AS BIGINT) AS nt
 FROM (SELECT unnest(generate_series(0, n - w, st)) AS s, w, st FROM c));;sp AS (SELECT fold, 'train' AS part, s AS i0, s+nt-1 AS i1 FROM fs
 UNION ALL SELECT fold, 'test', s+nt, s+w-1 FROM fs)"""))
def f2(spark, sf):
    index = stage(D.date_index(panel_m(spark, sf)))
    out = D.rolling_folds(index, window_ratio=0.4, min_dates=10, step_ratio=0.07, train=0.8, valid=0.0, test=0.2)
    return out.select("fold", "part", "date_start", "date_end")


ROLL_SPANS = """c AS (SELECT n, least(greatest(CAST(floor(n*0.5) AS BIGINT), 20), n) AS w FROM (SELECT count(*) AS n FROM dx));;
fs AS (SELECT s // 12 AS fold, s, w, CAST(floor(w*0.7) AS BIGINT) AS nt, CAST(floor(w*0.1) AS BIGINT) AS nv
 FROM (SELECT unnest(generate_series(0, n - w, 12)) AS s, w FROM c));;
sp AS (SELECT fold, 'train' AS part, s AS i0, s+nt-1 AS i1 FROM fs UNION ALL SELECT fold, 'valid', s+nt, s+nt+nv-1 FROM fs
 UNION ALL SELECT fold, 'test', s+nt+nv, s+w-1 FROM fs)"""
ROLL = dict(window_ratio=0.5, min_dates=20, step_days=12, train=0.7, valid=0.1, test=0.2)


@query("f3_rolling_folds", _fold_sql(ROLL_SPANS))
def f3(spark, sf):
    index = stage(D.date_index(panel_m(spark, sf)))
    return D.rolling_folds(index, **ROLL).select("fold", "part", "date_start", "date_end")


@query("f4_holdout_dispatch", _fold_sql("""c AS (SELECT count(*) AS n, CAST(floor(count(*)*0.7) AS BIGINT) AS nt FROM dx);;
sp AS (SELECT 0 AS fold, 'train' AS part, 0 AS i0, nt-1 AS i1 FROM c UNION ALL SELECT 0, 'test', nt, n-1 FROM c)"""))
def f4(spark, sf):
    index = stage(D.date_index(panel_m(spark, sf)))
    out = D.make_folds(index, "holdout_ratio", train=0.7, valid=0.0, test=0.3)
    return out.select("fold", "part", "date_start", "date_end")


@query("f5_fold_dispatch", sql(PANEL_M, DX, *ROLL_SPANS.split(";;"), body="""SELECT fold, part, count(*) AS n,
sum(f_qty) AS total FROM panel JOIN dx USING (date) JOIN sp ON idx BETWEEN i0 AND i1 GROUP BY 1, 2"""))
def f5(spark, sf):
    p = stage(panel_m(spark, sf))
    index = stage(D.date_index(p))
    rows = D.assign_folds(p, D.make_folds(index, "step_then_ratio", **ROLL), index)
    return rows.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("f_qty").alias("total"))


@query("f6_fold_slices", sql(PANEL_M, DX, *ROLL_SPANS.split(";;"), body="""SELECT fold, part, min(date) AS first_date,
max(date) AS last_date, count(DISTINCT date) AS n_dates, count(DISTINCT stockid) AS n_stocks
FROM panel JOIN dx USING (date) JOIN sp ON idx BETWEEN i0 AND i1 GROUP BY 1, 2"""))
def f6(spark, sf):
    p = stage(panel_m(spark, sf).select("date", "stockid"))
    index = stage(D.date_index(p))
    rows = D.assign_folds(p, D.rolling_folds(index, **ROLL), index)
    return rows.groupBy("fold", "part").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("n_dates"),
        F.countDistinct("stockid").alias("n_stocks"))


def _window_sql(first: str, test: str, fut: str, step: str, start: str) -> str:
    return sql(PANEL_M, DX, f"c AS (SELECT n, {first} AS tr, {test} AS te, {fut} AS fu, {step} AS st FROM (SELECT count(*) AS n FROM dx))",
               f"""w AS (SELECT (t - tr) // st AS window_id, {start} AS i0, t - 1 AS i1, t AS i2, t + te - 1 AS i3,
 t + te AS i4, t + te + fu - 1 AS i5 FROM (SELECT unnest(generate_series(tr, n - fu - te, st)) AS t, * FROM c))""",
               body="""SELECT window_id, a.date AS train_start, b.date AS train_end, c1.date AS test_start, d.date AS test_end,
e.date AS future_start, f.date AS future_end FROM w JOIN dx a ON a.idx = i0 JOIN dx b ON b.idx = i1 JOIN dx c1 ON c1.idx = i2
JOIN dx d ON d.idx = i3 JOIN dx e ON e.idx = i4 JOIN dx f ON f.idx = i5""")


_ENDS = [f"{p}_{e}" for p in D.WINDOW_PARTS for e in ("start", "end")]


@query("f7_refit_windows_days", _window_sql("30", "6", "4", "4", "0"))
def f7_days(spark, sf):
    index = stage(D.date_index(panel_m(spark, sf)))
    return D.refit_windows(index, train_days=30, test_days=6, future_days=4).select("window_id", *_ENDS)


@query("f7_refit_windows_ratio", _window_sql(
    "CAST(floor(n*0.4) AS BIGINT)", "CAST(floor(n*0.1) AS BIGINT)", "greatest(CAST(floor(n*0.05) AS BIGINT), 3)",
    "greatest(CAST(floor(n*0.08) AS BIGINT), 3)", "greatest(0, t - 1 - 20 + 1)"))
def f7_ratio(spark, sf):
    index = stage(D.date_index(panel_m(spark, sf)))
    out = D.refit_windows(index, mode="ratio", train_ratio=0.4, test_ratio=0.1, future_ratio=0.05, step_ratio=0.08,
                          min_future=3, expanding=False, max_train_days=20)
    return out.select("window_id", *_ENDS)


@query("f8_anchor_dates", _window_sql("30", "6", "4", "4", "0").replace(
    "SELECT window_id, a.date AS train_start, b.date AS train_end, c1.date AS test_start, d.date AS test_end,\ne.date AS future_start, f.date AS future_end",
    "SELECT window_id, d.date AS asof"))
def f8(spark, sf):
    index = stage(D.date_index(panel_m(spark, sf)))
    return D.anchor_dates(D.refit_windows(index, train_days=30, test_days=6, future_days=4), "test_end")


# --- weights and pseudo-labels -------------------------------------------------


@query("w13_recency_exp", sql(PANEL_M, body=f"""SELECT date, stockid,
{rr("0.1 + 0.9*exp(-ln(2)*date_diff('day', date, (SELECT max(date) FROM panel))/200e0)", 'w_recency')} FROM panel"""))
def w13(spark, sf):
    out = S.recency_weight(panel_m(spark, sf).select("date", "stockid"), half_life=200.0)
    return rounded(out, "w_recency")


@query("w13_recency_linear", sql(PANEL_M, "b AS (SELECT min(date) AS a, max(date) AS b FROM panel)", body=f"""SELECT date, stockid,
{rr("0.2 + 0.8*(1 - date_diff('day', date, b)/CAST(date_diff('day', a, b) AS DOUBLE))", 'w_recency')} FROM panel, b"""))
def w13_linear(spark, sf):
    out = S.recency_weight(panel_m(spark, sf).select("date", "stockid"), mode="linear", min_weight=0.2)
    return rounded(out, "w_recency")


TAIL_D = "q AS (SELECT date, quantile_cont(y, 0.2) AS lo, quantile_cont(y, 0.8) AS hi FROM lab GROUP BY date)"


@query("w14_tail_by_date", sql(PANEL_M, LAB, TAIL_D, body="""SELECT date, stockid,
CASE WHEN y <= lo OR y >= hi THEN 3e0 ELSE 1e0 END AS w_tail FROM lab JOIN q USING (date)"""))
def w14_date(spark, sf):
    out = S.tail_weight(saved_labels(spark, sf), lower=0.2, upper=0.8, tail=3.0, scope="date")
    return out.select("date", "stockid", "w_tail")


@query("w14_tail_global", sql(PANEL_M, LAB, "q AS (SELECT quantile_cont(y, 0.9) AS hi FROM lab)", body="""SELECT date, stockid,
CASE WHEN y >= hi THEN 2e0 ELSE 1e0 END AS w_tail FROM lab, q"""))
def w14_global(spark, sf):
    return S.tail_weight(saved_labels(spark, sf), side="upper").select("date", "stockid", "w_tail")


@query("w15_sample_weights", sql(PANEL_M, LAB, TAIL_D, """r AS (SELECT date, stockid, CASE WHEN y IS NULL THEN 1e0 ELSE
 (0.1 + 0.9*exp(-ln(2)*date_diff('day', date, (SELECT max(date) FROM lab))/200e0))
 * CASE WHEN y <= lo OR y >= hi THEN 2e0 ELSE 1e0 END END AS w FROM lab JOIN q USING (date))""",
    body=f"SELECT date, stockid, {rr('greatest(least(w / (SELECT avg(w) FROM r), 4), 0.2)', 'weight')} FROM r"))
def w15(spark, sf):
    out = S.sample_weights(saved_labels(spark, sf), recency={"half_life": 200.0},
                           tail={"lower": 0.2, "upper": 0.8, "scope": "date"}, clip_min=0.2, clip_max=4.0)
    return rounded(out.select("date", "stockid", "weight"), "weight")


@query("w16_pseudo_class", sql(PANEL_M, LAB, "q AS (SELECT date, quantile_cont(y, 0.3) AS lo, quantile_cont(y, 0.7) AS hi FROM lab GROUP BY date)",
    body="""SELECT date, stockid, CASE WHEN y >= hi THEN 1e0 ELSE -1e0 END AS y FROM lab JOIN q USING (date) WHERE y >= hi OR y <= lo"""))
def w16(spark, sf):
    return S.pseudo_class(saved_labels(spark, sf)).select("date", "stockid", "y")


@query("w16_pseudo_class_global", sql(PANEL_M, LAB, "q AS (SELECT quantile_cont(y, 0.25) AS lo, quantile_cont(y, 0.75) AS hi FROM lab)",
    body="""SELECT date, stockid, CASE WHEN y >= hi THEN 1e0 ELSE 0e0 END AS y FROM lab, q WHERE y >= hi OR y <= lo"""))
def w16_global(spark, sf):
    out = S.pseudo_class(saved_labels(spark, sf), lower=0.25, upper=0.75, low_label=0.0, scope="global")
    return out.select("date", "stockid", "y")


# --- losses --------------------------------------------------------------------

LOSS = "e AS (SELECT part, y_true AS t, y_pred/1e2 AS p FROM pred)"


def _loss_rows(spark, sf):
    return predictions(spark, sf).withColumn("y_pred", F.col("y_pred") / 100.0)


def _by_part(df, **aggs):
    return df.groupBy("part").agg(*[r6(c).alias(k) for k, c in aggs.items()])


@query("e1_mse_mae", sql(PANEL_M, LAB, PRED, LOSS, body=f"""SELECT part, {rr('avg((p-t)*(p-t))', 'mse')},
{rr('sum(abs(p-t))', 'mae_sum')} FROM e GROUP BY part"""))
def e1(spark, sf):
    return _by_part(_loss_rows(spark, sf), mse=E.reduce_loss(E.mse("y_pred", "y_true")),
                    mae_sum=E.reduce_loss(E.mae("y_pred", "y_true"), "sum"))


@query("e2_huber", sql(PANEL_M, LAB, PRED, LOSS, body=f"""SELECT part, {rr('''avg(CASE WHEN abs(p-t) <= 0.7 THEN 0.5*(p-t)*(p-t)
ELSE 0.7*(abs(p-t) - 0.35) END)''', 'huber')} FROM e GROUP BY part"""))
def e2(spark, sf):
    return _by_part(_loss_rows(spark, sf), huber=E.reduce_loss(E.huber("y_pred", "y_true", 0.7)))


@query("e3_logcosh", sql(PANEL_M, LAB, PRED, LOSS, body=f"SELECT part, {rr('avg(ln((exp(p-t) + exp(t-p))/2))', 'logcosh')} FROM e GROUP BY part"))
def e3(spark, sf):
    return _by_part(_loss_rows(spark, sf), logcosh=E.reduce_loss(E.logcosh("y_pred", "y_true")))


@query("e4_quantile", sql(PANEL_M, LAB, PRED, LOSS, body=f"""SELECT part,
{rr('avg(CASE WHEN t > p THEN 0.3*(t-p) ELSE 0.7*(p-t) END)', 'pinball')} FROM e GROUP BY part"""))
def e4(spark, sf):
    return _by_part(_loss_rows(spark, sf), pinball=E.reduce_loss(E.quantile("y_pred", "y_true", 0.3)))


@query("e5_poisson", sql(PANEL_M, LAB, body=f"""SELECT {rr('avg(exp(f_qty/1e3) - n*f_qty/1e3)', 'nll')},
{rr('''avg(f_qty - n*ln(f_qty + 1e-8) + CASE WHEN n > 1 THEN n*ln(n) - n + 0.5*ln(2*pi()*n) ELSE 0 END)''', 'nll_full')} FROM lab"""))
def e5(spark, sf):
    p = labelled(spark, sf)
    return p.agg(r6(E.reduce_loss(E.poisson_nll(F.col("f_qty") / 1000.0, "n"))).alias("nll"),
                 r6(E.reduce_loss(E.poisson_nll("f_qty", "n", log_input=False, full=True))).alias("nll_full"))


@query("e6_bce", sql(CLS, body=f"""SELECT part, {rr('avg(2.5*y_true*ln(1+exp(-y_pred)) + (1-y_true)*ln(1+exp(y_pred)))', 'logits')},
{rr('avg(-(y_true*ln(s) + (1-y_true)*ln(1-s)))', 'probs')}
FROM (SELECT *, 1/(1+exp(-least(y_pred, 5)))  AS s FROM cls) GROUP BY part"""))
def e6(spark, sf):
    c = class_predictions(spark, sf).withColumn("s", 1 / (1 + F.exp(-F.least("y_pred", F.lit(5.0)))))
    return _by_part(c, logits=E.reduce_loss(E.bce("y_pred", "y_true", pos_weight=2.5)),
                    probs=E.reduce_loss(E.bce("s", "y_true", from_logits=False)))


@query("e7_hinge", sql(CLS, body=f"SELECT part, {rr('avg(greatest(0.8 - (2*y_true - 1)*y_pred, 0))', 'hinge')} FROM cls GROUP BY part"))
def e7(spark, sf):
    c = class_predictions(spark, sf)
    return _by_part(c, hinge=E.reduce_loss(E.hinge("y_pred", F.col("y_true") * 2 - 1, 0.8)))


EMB = """z AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
lp AS (SELECT label, z, list_transform(z, lambda x: x - ln(list_sum(list_transform(z, lambda u: exp(u))))) AS lp FROM z),
ce AS (SELECT label, lp, -lp[label + 1] AS ce, list_sum(lp) AS s, 0.5 + label/64e0 AS w FROM lp)"""
_CW = [0.5 + i / 64.0 for i in range(64)]


@query("e8_multiclass", sql(EMB, body=f"""SELECT {rr('avg(ce)', 'sparse_cce')}, {rr('sum(w*ce)/sum(w)', 'wce')},
{rr('avg(0.9*ce + 0.1*(-s)/64)', 'smooth_cce')},
{rr('avg(0.9*ce + 0.1/63*(-s - ce))', 'label_smoothing_ce')}, {rr('avg(ce)', 'nll')},
{rr('avg(ce + 2*(1 - exp(-ce)))', 'polyloss')}, {rr('avg(-s/64)', 'cce_uniform')} FROM ce"""))
def e8(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    e = e.withColumn("lp", E.log_softmax("z"))
    even = F.array_repeat(F.lit(1 / 64), 64)
    cols = {"sparse_cce": E.sparse_cce("z", "label"), "wce": E.weighted_ce("z", "label", _CW),
            "smooth_cce": E.sparse_cce("z", "label", label_smoothing=0.1),
            "label_smoothing_ce": E.reduce_loss(E.label_smoothing_ce("z", "label", 0.1)),
            "nll": E.nll("lp", "label"), "polyloss": E.reduce_loss(E.polyloss("z", "label", 2.0)),
            "cce_uniform": E.reduce_loss(E.cce("z", even))}
    return e.agg(*[r6(c).alias(k) for k, c in cols.items()])
