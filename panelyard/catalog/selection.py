"""Factor history and factor selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.base import LAB, PANEL_M, ic_sql, labelled, query, rounded, rr, saved_labels, saved, sql, staged
from panelyard.operators import folds as D
from panelyard.operators import select as G
from panelyard.plans.stage import stage_path
from panelyard.sources import tables as T

FACTORS = ["f_disc", "f_qty", "f_tax", "n"]
LONG = "lf AS (UNPIVOT (SELECT date, y, f_disc, f_qty, f_tax, CAST(n AS DOUBLE) AS n FROM lab) ON f_disc, f_qty, f_tax, n INTO NAME factor VALUE v)"
HIST = (PANEL_M, LAB, LONG, ic_sql("lf", "date, factor", "y", "v"), "h AS (SELECT date, factor, ic AS rankic FROM ic)")
ASOF = "DATE '2000-06-01'"
WIN = """dx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS nd FROM (SELECT DISTINCT date FROM panel)),
wn AS (SELECT (t - 30) // 8 AS window_id, a.date AS train_end, b.date AS future_start
 FROM (SELECT unnest(generate_series(30, nd - 10, 8)) AS t FROM (SELECT DISTINCT nd FROM dx))
 JOIN dx a ON a.idx = t - 1 JOIN dx b ON b.idx = t + 6)"""


def history(spark, sf):
    return staged(G.factor_daily_rankic(saved_labels(spark, sf), FACTORS))


def windows(spark, sf):
    index = staged(D.date_index(labelled(spark, sf)))
    return staged(D.refit_windows(index, train_days=30, test_days=6, future_days=4, step_days=8))


@query("g8_factor_history", sql(*HIST, """dx AS (SELECT date, lead(date, 2) OVER (ORDER BY date) AS available_from
 FROM (SELECT DISTINCT date FROM panel))""", body=f"SELECT date, factor, {rr('rankic')}, available_from FROM h JOIN dx USING (date)"))
def g8(spark, sf):
    return rounded(G.factor_daily_rankic(saved_labels(spark, sf), FACTORS), "rankic")


@query("s9_ic_history", sql(*HIST, body=f"SELECT date, factor, {rr('rankic')} FROM h"))
def s9(spark, sf):
    path, _ = saved(history(spark, sf).withColumn("date", F.col("date").cast("string")), "history")
    return rounded(T.read_ic_history(spark, path).select("date", "factor", "rankic"), "rankic")


@query("a5_factor_scores", sql(*HIST, body=f"SELECT factor, {rr('abs(avg(rankic))', 'score')}, count(*) AS n_days FROM h GROUP BY factor"))
def a5(spark, sf):
    return rounded(G.factor_scores(history(spark, sf)), "score")


@query("a5_factor_scores_mean_abs", sql(*HIST, body=f"SELECT factor, {rr('avg(abs(rankic))', 'score')}, count(*) AS n_days FROM h GROUP BY factor"))
def a5_mean_abs(spark, sf):
    return rounded(G.factor_scores(history(spark, sf), "mean_abs"), "score")


@query("a20_selection_counts", sql(*HIST, body=f"""SELECT CAST(sum(k) AS BIGINT) AS n_hist_rows, count(*) AS n_factors_seen,
count(*) FILTER (s >= 0.01) AS n_selected FROM (SELECT factor, count(*) AS k, abs(avg(rankic)) AS s FROM h WHERE date <= {ASOF} GROUP BY factor)"""))
def a20(spark, sf):
    return G.selection_counts(history(spark, sf), "2000-06-01", threshold=0.01)


@query("g1_history_cut", sql(*HIST, body=f"SELECT date, factor, {rr('rankic')} FROM h WHERE date < {ASOF}"))
def g1(spark, sf):
    out = G.filter_history(history(spark, sf), "2000-06-01", inclusive=False)
    return rounded(out.select("date", "factor", "rankic"), "rankic")


@query("g2_select_by_history", sql(*HIST, f"""s AS (SELECT factor, abs(avg(rankic)) AS score, count(*) AS n_days FROM h
 WHERE date <= {ASOF} AND factor <> 'n' GROUP BY factor)""", body=f"""SELECT factor, {rr('score')}, n_days,
row_number() OVER (ORDER BY round(score, 12) DESC, factor) AS position FROM s WHERE score >= 0.005 AND n_days >= 20"""))
def g2(spark, sf):
    out = G.select_by_history(history(spark, sf), "2000-06-01", threshold=0.005, min_days=20, pool=FACTORS[:3])
    return rounded(out, "score")


for _inc in (True, False):
    @query("g2_select_by_history_many" + ("" if _inc else "_strict"), sql(*HIST, WIN, f"""s AS (SELECT train_end AS "asof", factor,
 avg(abs(rankic)) AS score, count(*) AS n_days FROM wn JOIN h ON date {'<=' if _inc else '<'} train_end GROUP BY 1, 2)""",
        body=f"""SELECT "asof", factor, {rr('score')}, n_days, row_number() OVER (PARTITION BY "asof" ORDER BY round(score, 12) DESC, factor) AS position
FROM s WHERE score >= 0.08 AND n_days >= 5"""))
    def g2_many(spark, sf, inc=_inc):
        asofs = D.anchor_dates(windows(spark, sf))
        out = G.select_by_history_many(history(spark, sf), asofs, threshold=0.08, aggregate="mean_abs", inclusive=inc, min_days=5)
        return rounded(out, "score")


@query("g3_select_by_day", sql(*HIST, WIN, """d AS (SELECT train_end AS "asof", factor, abs(rankic) AS score FROM wn JOIN h ON date = train_end),
dr AS (SELECT *, row_number() OVER (PARTITION BY "asof" ORDER BY round(score, 12) DESC, factor) AS position,
 count(*) FILTER (score >= 0.15) OVER (PARTITION BY "asof") AS k FROM d)""",
    body=f'''SELECT "asof", factor, {rr("score")}, position FROM dr WHERE position <= greatest(k, 2)'''))
def g3(spark, sf):
    out = G.select_by_day(history(spark, sf), D.anchor_dates(windows(spark, sf)), threshold=0.15, min_selected=2)
    return rounded(out, "score")


@query("k2_top_factors", sql(*HIST, """d AS (SELECT date AS "asof", factor, abs(rankic) AS score FROM h),
dr AS (SELECT *, row_number() OVER (PARTITION BY "asof" ORDER BY round(score, 12) DESC, factor) AS position FROM d)""",
    body=f'''SELECT "asof", factor, {rr("score")}, position FROM dr WHERE position <= 2'''))
def k2(spark, sf):
    h = history(spark, sf)
    days = h.select(F.col("date").alias("asof")).distinct()
    return rounded(G.select_by_day(h, days, threshold=9.0, min_selected=2), "score")


def _flags(spark, sf):
    h = history(spark, sf)
    wide = h.groupBy("date").pivot("factor", FACTORS).agg(F.max((F.abs("rankic") >= 0.05).cast("int")))
    path = stage_path(spark, "flags")
    wide.coalesce(1).write.option("header", True).csv(path)
    return T.read_use_flags(spark, path)


FLAG = "fl AS (SELECT date, factor FROM h WHERE abs(rankic) >= 0.05)"


@query("g4_select_by_flags", sql(*HIST, FLAG, WIN, body="""SELECT train_end AS "asof", factor,
row_number() OVER (PARTITION BY train_end ORDER BY factor) AS position FROM wn JOIN fl ON date = train_end"""))
def g4(spark, sf):
    return G.select_by_flags(_flags(spark, sf), D.anchor_dates(windows(spark, sf)), check=False)


@query("k4_latest_flags", sql(*HIST, FLAG, body="SELECT factor, count(*) AS n FROM fl GROUP BY factor"))
def k4(spark, sf):
    return _flags(spark, sf).where("flag > 0").groupBy("factor").agg(F.count(F.lit(1)).alias("n"))


SEL = """d AS (SELECT train_end AS "asof", factor, abs(rankic) AS score FROM wn JOIN h ON date = train_end),
dr AS (SELECT *, row_number() OVER (PARTITION BY "asof" ORDER BY round(score, 12) DESC, factor) AS position FROM d),
sl AS (SELECT * FROM dr WHERE score >= 0.1)"""
UN = """un AS (SELECT factor, min({'a': "asof", 'p': position}) AS f FROM sl GROUP BY factor)"""


def _selection(spark, sf):
    return staged(G.select_by_day(history(spark, sf), D.anchor_dates(windows(spark, sf)), threshold=0.1))


@query("u3_union_factors", sql(*HIST, WIN, SEL, UN, body="""SELECT factor, f.a AS first_asof,
row_number() OVER (ORDER BY f.a, f.p, factor) AS position FROM un"""))
def u3(spark, sf):
    return G.union_factors(_selection(spark, sf))


@query("g5_planned_scan", sql(*HIST, WIN, SEL, UN, body="""SELECT factor, round(avg(v), 6) + 0.0 AS mean FROM lf
WHERE factor IN (SELECT factor FROM un) GROUP BY factor"""))
def g5(spark, sf):
    cols = G.plan_columns(_selection(spark, sf), FACTORS)
    p = labelled(spark, sf).select(*[F.col(c).cast("double").alias(c) for c in cols])
    return rounded(p.unpivot([], cols, "factor", "v").groupBy("factor").agg(F.avg("v").alias("mean")), "mean")


@query("g6_scoped_selection", sql(*HIST, WIN, SEL, """sg AS (SELECT window_id, 'eval' AS stage, train_end AS "asof" FROM wn
 UNION ALL SELECT window_id, 'future', train_end FROM wn),
ch AS (SELECT window_id, stage, factor, position FROM sg JOIN sl USING ("asof"))""", body="""SELECT * FROM ch UNION ALL
SELECT window_id, stage, unnest(['f_disc', 'f_qty', 'f_tax', 'n']), unnest([1, 2, 3, 4]) FROM sg
WHERE (window_id, stage) NOT IN (SELECT window_id, stage FROM ch)"""))
def g6(spark, sf):
    return G.scope_selection(_selection(spark, sf), windows(spark, sf), pool=FACTORS)


@query("g7_saved_selection", sql(*HIST, WIN, SEL, body='SELECT "asof", factor, position FROM sl'))
def g7(spark, sf):
    path = stage_path(spark, "selection")
    G.write_selection(_selection(spark, sf), path)
    return spark.read.schema("asof date, factor string, position long").json(path)
