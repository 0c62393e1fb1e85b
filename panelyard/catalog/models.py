"""Models, walk-forward runs, tuning, sweeps, scoring, streaming.

Runs with one linear factor have a closed form, so they are compared with SQL
regressions; tree runs and searches are checked for rows only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.base import LAB, PANEL_M, labelled, panel_m, query, r6, rounded, rr, sql, staged
from panelyard.operators import folds as D
from panelyard.operators import model as M
from panelyard.operators import score as Sc
from panelyard.operators import tuning as T
from panelyard.operators import walk as W
from panelyard.operators.clean import CleanSettings, PanelCleaner
from panelyard.plans.stage import stage_path
from panelyard.streaming.daily import score_stream

LBL = "lb AS (SELECT * FROM lab WHERE y IS NOT NULL)"
FIT = "ft AS (SELECT regr_slope(y, f_qty) AS b, regr_intercept(y, f_qty) AS a FROM lb WHERE date < DATE '2000-01-01')"
LINEAR = dict(model="linear", metric="rmse")
TREE = {"maxIter": 3, "maxDepth": 2, "maxBins": 16}


def _rows(spark, sf):
    return staged(labelled(spark, sf).where("y is not null").select("date", "stockid", "y", "f_qty", "f_disc", "f_tax", "n"))


@query("m6_pca", sql(PANEL_M, LAB, LBL, """z AS (SELECT date, stockid, (f_qty - avg(f_qty) OVER ())/stddev_pop(f_qty) OVER () AS z1,
 (n - avg(n) OVER ())/stddev_pop(n) OVER () AS z2 FROM lb)""", body=f"SELECT date, stockid, {rr('(z1 + z2)/sqrt(2)', 'pc_000', 5)} FROM z"))
def m6(spark, sf):
    rows = _rows(spark, sf)
    state = M.fit_pca(rows, ["f_qty", "n"], share=0.8)
    return rounded(M.transform_pca(rows, state).select("date", "stockid", "pc_000"), "pc_000", digits=5)


@query("m6_pca_explained", sql(PANEL_M, LAB, LBL, body=f"""SELECT CAST(1 AS BIGINT) AS k, {rr('(1 + corr(f_qty, n))/2', 'share')} FROM lb"""))
def m6_explained(spark, sf):
    state = M.fit_pca(_rows(spark, sf), ["f_qty", "n"], share=0.8)
    return spark.createDataFrame([(len(state.columns), sum(state.explained))], "k long, share double").select(
        "k", r6("share").alias("share"))


@query("m6_pca_embeddings")
def m6_embeddings(spark, sf):
    from panelyard.catalog.base import table

    e = table(spark, sf, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0]
    wide = M.vector_columns(e.select("vec_id", "embedding"), "embedding", "e", size)
    return M.transform_pca(wide, M.fit_pca(wide, [f"e{i}" for i in range(size)], components=4, whiten=True))


@query("m6_pca_embedding_norms", sql("""e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
z AS (SELECT vec_id, (v - avg(v) OVER w)/stddev_pop(v) OVER w AS z FROM e WINDOW w AS (PARTITION BY i))""",
    body=f"SELECT vec_id, {rr('sum(z*z)', 'norm', 4)} FROM z GROUP BY vec_id"))
def m6_norms(spark, sf):
    """All components together keep the length of every standardised vector."""
    from panelyard.catalog.base import table

    e = table(spark, sf, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0]
    wide = M.vector_columns(e.select("vec_id", "embedding"), "embedding", "e", size)
    state = M.fit_pca(wide, [f"e{i}" for i in range(size)], components=size)
    norm = sum((F.col(c) * F.col(c) for c in state.columns[1:]), F.col(state.columns[0]) * F.col(state.columns[0]))
    return M.transform_pca(wide, state).select("vec_id", r6(norm, 4).alias("norm"))


@query("m7_tree_regression")
def m7(spark, sf):
    rows = _rows(spark, sf).withColumn("w", F.when(F.abs("y") > 0.5, 2.0).otherwise(1.0))
    model = M.fit_model(rows.where("date < '2000-01-01'"), ["f_qty", "f_disc", "n"], name="gbt", params=TREE, weight="w")
    return M.predict(model, rows.where("date >= '2000-01-01'"), ["f_qty", "f_disc", "n"])


FOLDS = dict(window_ratio=0.6, min_dates=20, step_days=15, train=0.6, valid=0.2, test=0.2)
FOLD_SPANS = """dx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS nd FROM (SELECT DISTINCT date FROM lb)),
fs AS (SELECT s // 15 AS fold, s, w, CAST(floor(w*0.6) AS BIGINT) AS nt, CAST(floor(w*0.2) AS BIGINT) AS nv FROM
 (SELECT unnest(generate_series(0, nd - w, 15)) AS s, w FROM (SELECT nd, CAST(floor(nd*0.6) AS BIGINT) AS w FROM dx LIMIT 1))),
sp AS (SELECT fold, 'train' AS part, s AS a, s + nt - 1 AS b FROM fs UNION ALL SELECT fold, 'valid', s + nt, s + nt + nv - 1 FROM fs
 UNION ALL SELECT fold, 'test', s + nt + nv, s + w - 1 FROM fs),
fr AS (SELECT fold, part, date, stockid, y, f_qty FROM lb JOIN dx USING (date) JOIN sp ON idx BETWEEN a AND b),
mo AS (SELECT fold, regr_slope(y, f_qty) AS k, regr_intercept(y, f_qty) AS c FROM fr WHERE part = 'train' GROUP BY fold),
sc AS (SELECT fold, part, date, stockid, y, c + k*f_qty AS p FROM fr JOIN mo USING (fold)),
rm AS (SELECT fold, part, -sqrt(avg((y-p)*(y-p))) AS s FROM sc GROUP BY 1, 2),
hs AS (SELECT fold AS step_id, max(s) FILTER (part = 'train') AS train_score, max(s) FILTER (part = 'valid') AS valid_score,
 max(s) FILTER (part = 'test') AS test_score FROM rm GROUP BY fold)"""
WALK = (PANEL_M, LAB, LBL, FOLD_SPANS)
WALK_STUMPS = (PANEL_M, LAB, LBL, FOLD_SPANS, """sr AS (SELECT fold, part, l.date, l.stockid, l.y, CASE WHEN n >= 8 THEN 1 ELSE 0 END AS f
 FROM lb l JOIN dx ON l.date = dx.date JOIN sp ON idx BETWEEN a AND b),
sm AS (SELECT fold, f, avg(y) AS p FROM sr WHERE part = 'train' GROUP BY 1, 2),
se AS (SELECT fold, part, -sqrt(avg((y-p)*(y-p))) AS s FROM sr JOIN sm USING (fold, f) GROUP BY 1, 2),
sh AS (SELECT fold, max(s) FILTER (part = 'train') AS train_score, max(s) FILTER (part = 'test') AS test_score FROM se GROUP BY fold)""")


# one factor of two values: the first tree of depth 1 gives the weighted mean of each side, and a second one finds nothing more
STUMP = """sd AS (SELECT date, stockid, y, CASE WHEN n >= 8 THEN 1.0 ELSE 0.0 END AS f, CASE WHEN abs(y) > 0.5 THEN 2.0 ELSE 1.0 END AS w FROM lb),
mn AS (SELECT f, sum(w*y)/sum(w) AS p FROM sd WHERE date < DATE '2000-01-01' GROUP BY f)"""


@query("m7_early_stopping", sql(PANEL_M, LAB, LBL, STUMP, body=f"""SELECT date, stockid, {rr('y', 'y_true')}, {rr('p', 'y_pred', 5)}, CAST(1 AS BIGINT) AS n_trees
FROM sd JOIN mn USING (f) WHERE date >= DATE '2001-01-01'"""))
def m7_stopped(spark, sf):
    rows = _rows(spark, sf).withColumns({"w": F.when(F.abs("y") > 0.5, 2.0).otherwise(1.0), "f": (F.col("n") >= 8).cast("double")})
    model = M.fit_model(rows.where("date < '2000-01-01'"), ["f"], name="gbt", params={"maxIter": 12, "maxDepth": 1}, weight="w",
                        valid=rows.where("date >= '2000-01-01' AND date < '2001-01-01'"))
    scored = M.predict(model, rows.where("date >= '2001-01-01'"), ["f"]).withColumn("n_trees", F.lit(model.getNumTrees).cast("long"))
    return rounded(rounded(scored, "y_true"), "y_pred", digits=5)


@query("m10_walk_forward_stumps", sql(*WALK_STUMPS, body=f"""SELECT fold AS step_id, {rr('train_score', 'train_score', 5)}, {rr('test_score', 'test_score', 5)} FROM sh"""))
def m10_stumps(spark, sf):
    """Weighted trees of depth 1 on a factor of two values, fold by fold, each stopped by the error on its valid part."""
    rows = staged(_rows(spark, sf).withColumn("f", (F.col("n") >= 8).cast("double")))
    index = staged(D.date_index(rows))
    folds = staged(D.rolling_folds(index, **FOLDS))
    run = W.walk_forward(rows, folds, index, ["f"], W.WalkSettings(
        model="gbt", metric="rmse", params={"maxIter": 6, "maxDepth": 1}, early_stop=True))
    return rounded(run.history.select("step_id", "train_score", "test_score"), "train_score", "test_score", digits=5)


@query("m8_linear_regression", sql(PANEL_M, LAB, LBL, FIT, body=f"SELECT {rr('b', 'slope', 7)}, {rr('a', 'intercept', 5)} FROM ft"))
def m8(spark, sf):
    model = M.fit_model(_rows(spark, sf).where("date < '2000-01-01'"), ["f_qty"], name="linear")
    row = spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
    return row.select(r6("slope", 7).alias("slope"), r6("intercept", 5).alias("intercept"))


@query("m9_prediction_table", sql(PANEL_M, LAB, LBL, FIT, body=f"""SELECT date, stockid, {rr('y', 'y_true')}, {rr('a + b*f_qty', 'y_pred', 5)},
'test' AS part, CAST(3 AS BIGINT) AS step_id, CAST(3 AS BIGINT) AS fold, 'r1' AS run_id, 'linear' AS model_name
FROM lb, ft WHERE date >= DATE '2000-01-01'"""))
def m9(spark, sf):
    rows = _rows(spark, sf)
    model = M.fit_model(rows.where("date < '2000-01-01'"), ["f_qty"], name="linear")
    scored = M.predict(model, rows.where("date >= '2000-01-01'"), ["f_qty"])
    out = M.prediction_table(scored, part="test", step_id=3, fold=3, run_id="r1", model_name="linear")
    return rounded(rounded(out, "y_true"), "y_pred", digits=5)


def _walk(spark, sf, **settings):
    rows = _rows(spark, sf)
    index = staged(D.date_index(rows))
    folds = staged(D.rolling_folds(index, **FOLDS))
    features = settings.pop("features", ["f_qty"])
    return W.walk_forward(rows, folds, index, features, W.WalkSettings(**{**LINEAR, **settings}))


@query("m10_walk_forward", sql(*WALK, body=f"""SELECT step_id, {rr('train_score', 'train_score', 5)}, {rr('valid_score', 'valid_score', 5)},
{rr('test_score', 'test_score', 5)}, 'done' AS status FROM hs"""))
def m10(spark, sf):
    h = _walk(spark, sf).history.select("step_id", "train_score", "valid_score", "test_score", "status")
    return rounded(h, "train_score", "valid_score", "test_score", digits=5)


@query("m10_walk_forward_predictions", sql(*WALK, body=f"""SELECT fold, part, date, stockid, {rr('y', 'y_true')}, {rr('p', 'y_pred', 5)} FROM sc"""))
def m10_predictions(spark, sf):
    p = _walk(spark, sf).predictions.select("fold", "part", "date", "stockid", "y_true", "y_pred")
    return rounded(rounded(p, "y_true"), "y_pred", digits=5)


@query("m10_walk_forward_trees")
def m10_trees(spark, sf):
    run = _walk(spark, sf, model="gbt", metric="rankic", params=TREE, features=["f_qty", "f_disc", "n"],
                weights={"recency": {}, "tail": {"scope": "date"}})
    return run.history


WINDOWS = dict(train_days=40, test_days=8, future_days=6, step_days=12)
REFIT = (PANEL_M, LAB, LBL, """dx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS nd FROM (SELECT DISTINCT date FROM lb)),
wn AS (SELECT (t - 40)//12 AS w, t FROM (SELECT unnest(generate_series(40, nd - 14, 12)) AS t FROM (SELECT nd FROM dx LIMIT 1))),
rw AS (SELECT w, CASE WHEN idx < t THEN 'train' WHEN idx < t + 8 THEN 'test' ELSE 'future' END AS part, date, stockid, y, f_qty
 FROM lb JOIN dx USING (date) JOIN wn ON idx < t + 14),
m1 AS (SELECT w, regr_slope(y, f_qty) AS k1, regr_intercept(y, f_qty) AS c1 FROM rw WHERE part = 'train' GROUP BY w),
m2 AS (SELECT w, regr_slope(y, f_qty) AS k2, regr_intercept(y, f_qty) AS c2 FROM rw WHERE part <> 'future' GROUP BY w),
sc AS (SELECT w, part, date, stockid, y, CASE WHEN part = 'future' THEN c2 + k2*f_qty ELSE c1 + k1*f_qty END AS p
 FROM rw JOIN m1 USING (w) JOIN m2 USING (w)),
rm AS (SELECT w, part, -sqrt(avg((y-p)*(y-p))) AS s FROM sc GROUP BY 1, 2),
hs AS (SELECT w AS step_id, max(s) FILTER (part = 'train') AS train_score, max(s) FILTER (part = 'test') AS test_score,
 max(s) FILTER (part = 'future') AS future_score FROM rm GROUP BY w)""")


def _refit(spark, sf, selection=None, **settings):
    rows = _rows(spark, sf)
    index = staged(D.date_index(rows))
    windows = staged(D.refit_windows(index, **WINDOWS))
    features = settings.pop("features", ["f_qty"])
    chosen = selection(rows, windows) if selection else None
    return W.refit_walk(rows, windows, index, features, W.WalkSettings(**{**LINEAR, **settings}), selection=chosen)


@query("m11_refit_history", sql(*REFIT, body=f"""SELECT step_id, {rr('train_score', 'train_score', 5)}, {rr('test_score', 'test_score', 5)},
{rr('future_score', 'future_score', 5)} FROM hs"""))
def m11(spark, sf):
    h = _refit(spark, sf).history.select("step_id", "train_score", "test_score", "future_score")
    return rounded(h, "train_score", "test_score", "future_score", digits=5)


@query("m11_refit_future", sql(*REFIT, body=f"SELECT w AS fold, date, stockid, {rr('p', 'y_pred', 5)} FROM sc WHERE part = 'future'"))
def m11_future(spark, sf):
    p = _refit(spark, sf).predictions.where("part = 'future'").select("fold", "date", "stockid", "y_pred")
    return rounded(p, "y_pred", digits=5)


@query("m11_refit_selected_pseudo")
def m11_full(spark, sf):
    """Factor selection per window, pseudo-labels, PCA and trees together."""
    from panelyard.operators import select as G

    def choose(rows, windows):
        history = staged(G.factor_daily_rankic(rows, ["f_qty", "f_disc", "f_tax", "n"]))
        asofs = D.anchor_dates(windows, "train_end")
        picked = G.select_by_history_many(history.withColumn("date", F.col("available_from")).where("date is not null"),
                                          asofs, threshold=0.005)
        return staged(G.scope_selection(staged(picked), windows, pool=["f_qty", "f_disc"]))

    run = _refit(spark, sf, selection=choose, model="gbt", metric="rankic", params=TREE, pca={"share": 0.9},
                 pseudo={"lower": 0.3, "upper": 0.7}, features=["f_qty", "f_disc", "f_tax", "n"])
    return run.history


@query("m12_skip_reasons", sql(PANEL_M, LAB, LBL, """dx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS nd FROM (SELECT DISTINCT date FROM lb)),
wn AS (SELECT (t - 40)//12 AS w, t FROM (SELECT unnest(generate_series(40, nd - 14, 12)) AS t FROM (SELECT nd FROM dx LIMIT 1)))""",
    body="""SELECT w AS step_id, CASE WHEN w = 0 THEN 'done' ELSE 'skipped' END AS status,
CASE WHEN w > 0 THEN 'empty_selection' END AS reason FROM wn"""))
def m12(spark, sf):
    def only_first(rows, windows):
        return windows.where("window_id = 0").select(
            "window_id", F.explode(F.array(F.lit("eval"), F.lit("future"))).alias("stage"),
            F.lit("f_qty").alias("factor"), F.lit(1).cast("long").alias("position"))
    return _refit(spark, sf, selection=only_first).history.select("step_id", "status", "reason")


@query("m12_window_counts", sql(*REFIT, body="""SELECT w AS step_id, CASE WHEN w = 0 THEN 'done' ELSE 'skipped' END AS status,
count(*) FILTER (part = 'train') AS n_train, CAST(0 AS BIGINT) AS n_valid, count(*) FILTER (part = 'test') AS n_test,
count(*) FILTER (part = 'future') AS n_future, CAST(CASE w WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS n_features,
CAST(CASE w WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS n_features_future FROM rw GROUP BY w"""))
def m12_counts(spark, sf):
    """Row and factor counts of every window, also of those that are skipped; window 1 has factors for one stage only."""
    def some(rows, windows):
        return windows.where("window_id < 2").select(
            "window_id", F.explode(F.array(F.lit("eval"), F.when(F.col("window_id") == 0, "future"))).alias("stage"),
            F.lit("f_qty").alias("factor"), F.lit(1).cast("long").alias("position")).where("stage IS NOT NULL")
    return _refit(spark, sf, selection=some).history.select(
        "step_id", "status", "n_train", "n_valid", "n_test", "n_future", "n_features", "n_features_future")


@query("m13_signed_score", sql(*WALK, body=f"""SELECT {rr('-sqrt(avg((y-p)*(y-p)))', 'rmse', 5)}, {rr('-avg(abs(y-p))', 'mae', 5)},
{rr('1 - sum((y-p)*(y-p))/(var_pop(y)*count(*))', 'r2', 5)} FROM sc WHERE fold = 0 AND part = 'test'"""))
def m13(spark, sf):
    p = staged(_walk(spark, sf).predictions.where("fold = 0 and part = 'test'"))
    row = [tuple(W.score(p, m) for m in ("rmse", "mae", "r2"))]
    return rounded(spark.createDataFrame(row, "rmse double, mae double, r2 double"), "rmse", "mae", "r2", digits=5)


@query("m14_random_search")
def m14(spark, sf):
    rows = _rows(spark, sf)
    fit, check = rows.where("date < '2000-01-01'"), rows.where("date >= '2000-01-01'")
    s = W.WalkSettings(model="gbt", metric="rankic")
    tries = T.random_candidates({"maxIter": [2, 4], "maxDepth": [1, 2, 3]}, trials=3, seed=1)
    found = T.search(lambda p: W.score(W.fit_step(fit, ["f_qty", "f_disc"], p, s).score(check), "rankic"), tries)
    return spark.createDataFrame([(T.stable_hash(p), float(v), p == found.best) for p, v in zip(tries, found.scores)],
                                 "params_hash string, score double, best boolean")


# ridge of one factor: the slope of least squares over 1 + penalty / deviation of the label
RANGES = {"regParam": {"type": "float", "low": 0.001, "high": 10.0, "log": True}}
DRAWN = T.random_candidates(RANGES, trials=6, seed=11)
FIT_ONE = """covar_pop(y, f_qty)/var_pop(f_qty) AS k, stddev_pop(y) AS sy, avg(y) AS my, avg(f_qty) AS mf"""


@query("m14_range_search", sql(PANEL_M, LAB, LBL, f"""pr AS (SELECT * FROM (VALUES {", ".join(f"({i}, CAST({c['regParam']!r} AS DOUBLE))" for i, c in enumerate(DRAWN))}) AS t(trial, l)),
fo AS (SELECT {FIT_ONE} FROM lb WHERE date < DATE '2000-01-01'),
tr AS (SELECT trial, l, -sqrt(avg((y - my - k/(1 + l/sy)*(f_qty - mf))**2)) AS score FROM lb, fo, pr WHERE date >= DATE '2000-01-01' GROUP BY 1, 2)""",
    body=f"SELECT CAST(trial AS BIGINT) AS trial, l AS penalty, {rr('score', 'score', 6)}, trial = (SELECT arg_max(trial, score) FROM tr) AS best FROM tr"))
def m14_ranges(spark, sf):
    rows = W.save_by_date(_rows(spark, sf))
    fit, check = rows.where("date < '2000-01-01'"), rows.where("date >= '2000-01-01'")
    s = W.WalkSettings(**LINEAR)
    found = T.search(lambda p: W.score(W.fit_step(fit, ["f_qty"], p, s).score(check), "rmse"), DRAWN)
    out = spark.createDataFrame([(i, p["regParam"], float(v), p == found.best) for i, (p, v) in enumerate(zip(DRAWN, found.scores))],
                                "trial long, penalty double, score double, best boolean")
    return rounded(out, "score")


@query("m15_tuned_walk", sql(PANEL_M, LAB, LBL, FOLD_SPANS, f"""la AS (SELECT * FROM (VALUES (0, CAST(0 AS DOUBLE), '0.0'), (1, CAST(0.5 AS DOUBLE), '0.5'), (2, CAST(5 AS DOUBLE), '5.0')) AS t(o, l, s)),
tn AS (SELECT fold, a, b, b - greatest(1, CAST(floor((b - a + 1)*0.2) AS BIGINT)) AS last FROM sp WHERE part = 'train'),
tf AS (SELECT fold, {FIT_ONE} FROM lb JOIN dx USING (date) JOIN tn ON idx BETWEEN a AND last GROUP BY fold),
ts AS (SELECT fold, o, s, -sqrt(avg((y - my - k/(1 + l/sy)*(f_qty - mf))**2)) AS score
 FROM lb JOIN dx USING (date) JOIN tn ON idx BETWEEN last + 1 AND b JOIN tf USING (fold), la GROUP BY 1, 2, 3),
bt AS (SELECT fold, arg_max(o, score) AS o, max(score) AS score FROM ts GROUP BY fold),
us AS (SELECT f.fold, coalesce(bt.o, 0) AS o FROM (SELECT DISTINCT fold FROM sp) f LEFT JOIN bt ON f.fold > 0 AND bt.fold = 2*((f.fold - 1)//2)),
wf AS (SELECT fold, {FIT_ONE} FROM fr WHERE part = 'train' GROUP BY fold),
te AS (SELECT fold, -sqrt(avg((y - my - k/(1 + l/sy)*(f_qty - mf))**2)) AS score FROM fr JOIN wf USING (fold) JOIN us USING (fold) JOIN la USING (o)
 WHERE part = 'test' GROUP BY fold)""", body=f"""SELECT us.fold AS step_id, '{{"regParam": ' || s || '}}' AS params, substr(md5('{{"regParam": ' || s || '}}'), 1, 10) AS params_hash,
us.fold % 2 = 0 AS tuned, us.fold % 2 = 0 AS updated, round(CASE WHEN us.fold % 2 = 0 THEN bt.score END, 5) + 0.0 AS tune_score, {rr('te.score', 'test_score', 5)}
FROM us JOIN la USING (o) JOIN bt ON bt.fold = us.fold JOIN te ON te.fold = us.fold"""))
def m15(spark, sf):
    run = _walk(spark, sf, params={"regParam": 0.0}, candidates=[{"regParam": 0.5}, {"regParam": 5.0}],
                schedule=T.every_k_steps(2), min_improve=0.0)
    h = run.history.select("step_id", "params", "params_hash", "tuned", "updated", "tune_score", "test_score")
    return rounded(h, "tune_score", "test_score", digits=5)


@query("m19_sweep_ridge", sql(PANEL_M, LAB, LBL, FOLD_SPANS, f"""la AS (SELECT * FROM (VALUES (0, CAST(0 AS DOUBLE)), (1, CAST(1 AS DOUBLE))) AS t(o, l)),
wf AS (SELECT fold, {FIT_ONE} FROM fr WHERE part = 'train' GROUP BY fold),
we AS (SELECT o, fold, part, -sqrt(avg((y - my - k/(1 + l/sy)*(f_qty - mf))**2)) AS score FROM fr JOIN wf USING (fold), la GROUP BY 1, 2, 3)""",
    body=f"""SELECT CAST(o AS BIGINT) AS set_id, count(DISTINCT fold) AS n_steps, {rr("avg(score) FILTER (part = 'train')", 'mean_train_score', 5)},
{rr("avg(score) FILTER (part = 'test')", 'mean_test_score', 5)}, {rr("arg_max(score, fold) FILTER (part = 'test')", 'last_test_score', 5)} FROM we GROUP BY o"""))
def m19_ridge(spark, sf):
    rows = W.save_by_date(_rows(spark, sf))
    index = staged(D.date_index(rows))
    folds = staged(D.rolling_folds(index, **FOLDS))
    history, _ = W.sweep(W.WalkSettings(**LINEAR, by_date=True), [{"regParam": 0.0}, {"regParam": 1.0}],
                         lambda s: W.walk_forward(rows, folds, index, ["f_qty"], s))
    out = W.compare_sweep(T.history_summary(history, ["set_id"]))
    out = out.select("set_id", "n_steps", "mean_train_score", "mean_test_score", "last_test_score")
    return rounded(out, "mean_train_score", "mean_test_score", "last_test_score", digits=5)


@query("m16_choose_step", sql(*WALK, body="""SELECT 'last' AS strategy, max(step_id) AS step_id FROM hs UNION ALL
SELECT 'best_valid', (SELECT step_id FROM hs ORDER BY valid_score DESC, step_id LIMIT 1) UNION ALL
SELECT 'best_valid_last_n', (SELECT step_id FROM (SELECT * FROM hs ORDER BY step_id DESC LIMIT 2) ORDER BY valid_score DESC, step_id LIMIT 1)"""))
def m16(spark, sf):
    h = _walk(spark, sf).history
    tables = [T.choose_step(h, s, last_n=2).select(F.lit(s).alias("strategy"), "step_id")
              for s in ("last", "best_valid", "best_valid_last_n")]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


CLEANED = """cl AS (SELECT date, stockid, y, (f_qty - mu)/sd AS x FROM lab, (SELECT avg(f_qty) AS mu, stddev_pop(f_qty) AS sd FROM lb
 WHERE date < DATE '2000-01-01')),
cf AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM cl WHERE y IS NOT NULL AND date < DATE '2000-01-01')"""


def _bundle(spark, sf):
    p = staged(labelled(spark, sf).select("date", "stockid", "y", "f_qty"))
    past = p.where("date < '2000-01-01'")
    cleaner, clean = PanelCleaner(CleanSettings(zscore="global")).fit_transform(past, ["f_qty"])
    return p, M.Bundle(M.fit_model(clean, ["f_qty"], name="linear"), ["f_qty"], cleaner, None, {"run": "r1"})


@query("m17_bundle_round_trip", sql(PANEL_M, LAB, LBL, CLEANED, body=f"""SELECT date, stockid, {rr('a + b*x', 'y_pred', 5)} FROM cl, cf
WHERE date >= DATE '2000-01-01'"""))
def m17(spark, sf):
    p, bundle = _bundle(spark, sf)
    path = stage_path(spark, "bundle")
    M.save_bundle(bundle, spark, path)
    back = M.load_bundle(spark, path)
    rows = back.cleaner.transform(p.where("date >= '2000-01-01'").drop("y"))
    return rounded(back.score(rows, label=None), "y_pred", digits=5)


@query("m18_score_date", sql(PANEL_M, LAB, LBL, CLEANED, body=f"""SELECT date, stockid, {rr('a + b*x', 'y_pred', 5)}, date AS asof_date,
'score' AS run_id, 'daily' AS pred_mode FROM cl, cf WHERE date = DATE '2001-02-01'"""))
def m18(spark, sf):
    p, bundle = _bundle(spark, sf)
    return rounded(Sc.score_date(p.drop("y"), "2001-02-01", bundle), "y_pred", digits=5)


@query("m18_score_latest", sql(PANEL_M, LAB, LBL, CLEANED, body=f"""SELECT date, stockid, {rr('a + b*x', 'y_pred', 5)}, 'last_day' AS pred_mode
FROM cl, cf WHERE date = (SELECT max(date) FROM cl)"""))
def m18_latest(spark, sf):
    p, bundle = _bundle(spark, sf)
    return rounded(Sc.score_latest(p.drop("y"), bundle).select("date", "stockid", "y_pred", "pred_mode"), "y_pred", digits=5)


@query("m18_score_rolling", sql(PANEL_M, LAB, """ro AS (SELECT date, stockid, y, CASE WHEN count(f_qty) OVER f >= 5 THEN avg(f_qty) OVER f END AS x
 FROM lab WINDOW f AS (PARTITION BY stockid ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""",
    """rf AS (SELECT regr_slope(y, coalesce(x, 0)) AS b, regr_intercept(y, coalesce(x, 0)) AS a FROM ro WHERE y IS NOT NULL AND date < DATE '2000-01-01')""",
    body=f"SELECT date, stockid, {rr('a + b*coalesce(x, 0)', 'y_pred', 5)} FROM ro, rf WHERE date = DATE '2001-02-01'"))
def m18_rolling(spark, sf):
    """A rolling feature at scoring time sees the history it had in training."""
    from panelyard.operators.rolling import rolling_stats

    p = staged(labelled(spark, sf).select("date", "stockid", "y", "f_qty"))
    roll = {"features": ["f_qty"], "windows": [5], "stats": ["mean"]}
    cleaner, clean = PanelCleaner(CleanSettings()).fit_transform(
        rolling_stats(p, **roll).where("date < '2000-01-01'"), ["f_qty__roll_mean_5"])
    features = ["f_qty__roll_mean_5"]
    bundle = M.Bundle(M.fit_model(clean, features, name="linear"), features, cleaner)
    n_dates = p.select("date").distinct().count()
    out = Sc.score_date(p.drop("y"), "2001-02-01", bundle, rolling=roll, lookback=n_dates)
    return rounded(out.select("date", "stockid", "y_pred"), "y_pred", digits=5)


@query("m18_daily_state", sql(PANEL_M, LAB, """ro AS (SELECT date, stockid, y, CASE WHEN count(f_qty) OVER f >= 5 THEN avg(f_qty) OVER f END AS x
 FROM lab WINDOW f AS (PARTITION BY stockid ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""",
    """rf AS (SELECT regr_slope(y, coalesce(x, 0)) AS b, regr_intercept(y, coalesce(x, 0)) AS a FROM ro WHERE y IS NOT NULL AND date < DATE '2000-01-01')""",
    body=f"""SELECT date, stockid, {rr('a + b*coalesce(x, 0)', 'y_pred', 5)}, date AS asof_date, CAST(date + INTERVAL 1 MONTH AS DATE) AS target_date,
'd1' AS run_id, 'daily' AS pred_mode FROM ro, rf WHERE date IN (DATE '2000-11-01', DATE '2000-12-01', DATE '2001-02-01')"""))
def m18_state(spark, sf):
    """Three runs in a row, the last after a skipped date; each but the first reads the state and the new folders alone."""
    from panelyard.operators.rolling import rolling_stats

    p = W.save_by_date(labelled(spark, sf).select("date", "stockid", "y", "f_qty"))
    roll = {"features": ["f_qty"], "windows": [5], "stats": ["mean"]}
    features = ["f_qty__roll_mean_5"]
    cleaner, clean = PanelCleaner(CleanSettings()).fit_transform(rolling_stats(p, **roll).where("date < '2000-01-01'"), features)
    bundle = M.Bundle(M.fit_model(clean, features, name="linear"), features, cleaner)
    state, sink, out = stage_path(spark, "state"), stage_path(spark, "daily"), []
    for day, target in (("2000-11-01", "2000-12-01"), ("2000-12-01", "2001-01-01"), ("2001-02-01", "2001-03-01")):
        out.append(Sc.score_daily(p.select("date", "stockid", "f_qty"), day, bundle, rows_back=4, state_path=state, sink=sink,
                                  rolling=roll, target_date=target, run_id="d1").drop("state_path"))
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]), "y_pred", digits=5)


@query("m19_sweep")
def m19(spark, sf):
    rows = W.save_by_date(_rows(spark, sf))
    index = staged(D.date_index(rows))
    folds = staged(D.rolling_folds(index, **{**FOLDS, "step_days": 30}))
    history, _ = W.sweep(W.WalkSettings(**LINEAR, by_date=True), [{"regParam": 0.0}, {"regParam": 1.0}],
                         lambda s: W.walk_forward(rows, folds, index, ["f_qty", "n"], s))
    return W.compare_sweep(T.history_summary(history, ["set_id", "set_hash"]))


@query("m20_parameter_hash", sql(PANEL_M, body="""SELECT stockid, substr(md5('{"n": ' || count(*) || ', "total": ' || sum(n) || '}'), 1, 10) AS h
FROM panel GROUP BY stockid"""))
def m20(spark, sf):
    g = panel_m(spark, sf).groupBy("stockid").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total"))
    text = F.format_string('{"n": %d, "total": %d}', "n", "total")
    return g.select("stockid", T.hash_column(text).alias("h"))


@query("a18_history_summary", sql(*WALK, body=f"""SELECT count(*) AS n_steps, {rr('avg(train_score)', 'mean_train_score', 5)},
{rr('avg(valid_score)', 'mean_valid_score', 5)}, {rr('avg(test_score)', 'mean_test_score', 5)},
{rr('arg_max(train_score, step_id)', 'last_train_score', 5)}, {rr('arg_max(valid_score, step_id)', 'last_valid_score', 5)},
{rr('arg_max(test_score, step_id)', 'last_test_score', 5)} FROM hs"""))
def a18(spark, sf):
    out = T.history_summary(_walk(spark, sf).history)
    return rounded(out, *[c for c in out.columns if c != "n_steps"], digits=5)


@query("b6_sweep_comparison", sql(*WALK, body=f"""SELECT CAST(0 AS BIGINT) AS set_id, (SELECT count(*) FROM hs) AS n_steps,
{rr('(SELECT arg_max(test_score, step_id) FROM hs)', 'last_test_score', 5)}, {rr("sqrt(avg((y-p)*(y-p)))", 'rmse', 5)}
FROM sc WHERE part = 'test'"""))
def b6(spark, sf):
    from panelyard.operators.evaluate import regression_metrics

    rows = W.save_by_date(_rows(spark, sf))
    index = staged(D.date_index(rows))
    folds = staged(D.rolling_folds(index, **FOLDS))
    history, preds = W.sweep(W.WalkSettings(**LINEAR, by_date=True), [{"regParam": 0.0}],
                             lambda s: W.walk_forward(rows, folds, index, ["f_qty"], s))
    metrics = regression_metrics(preds.where("part = 'test'"), ["rmse"], keys=["set_id"]).drop("n")
    out = W.compare_sweep(T.history_summary(history, ["set_id"]), metrics)
    return rounded(out.select("set_id", "n_steps", "last_test_score", "rmse"), "last_test_score", "rmse", digits=5)


@query("k6_sweep_ranking", sql(PANEL_M, LAB, LBL, """hs AS (SELECT stockid AS set_id, avg(y) AS last_test_score FROM lb GROUP BY 1)""",
    body=f"SELECT set_id, {rr('last_test_score')} FROM hs"))
def k6(spark, sf):
    table = _rows(spark, sf).groupBy(F.col("stockid").alias("set_id")).agg(F.avg("y").alias("last_test_score"))
    return rounded(W.compare_sweep(table), "last_test_score")


@query("u2_refit_rows", sql(PANEL_M, LAB, LBL, """dx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM lb))""",
    body="SELECT date, stockid, f_qty FROM lb JOIN dx USING (date) WHERE idx < 48"))
def u2(spark, sf):
    rows = _rows(spark, sf)
    index = staged(D.date_index(rows))
    spans = D.window_spans(D.refit_windows(index, **WINDOWS).where("window_id = 0"))
    return W.combine_parts(D.assign_folds(rows, spans, index)).select("date", "stockid", "f_qty")


@query("d1_stream_scoring", sql(PANEL_M, LAB, LBL, CLEANED, body=f"""SELECT date, stockid, {rr('a + b*x', 'y_pred', 5)} FROM cl, cf
WHERE date >= DATE '2000-01-01'"""))
def d1(spark, sf):
    p, bundle = _bundle(spark, sf)
    source, sink = stage_path(spark, "arriving"), stage_path(spark, "scored")
    fresh = p.where("date >= '2000-01-01'").drop("y")
    # one file per date, as the job expects
    n = fresh.select("date").distinct().count()
    fresh.repartitionByRange(n, "date").write.parquet(source)
    for name in ("first", "replay"):
        score_stream(spark, source, fresh.schema, bundle, sink, stage_path(spark, f"cp-{name}")).awaitTermination()
    out = spark.read.parquet(sink).select("date", "stockid", "y_pred")
    return rounded(out, "y_pred", digits=5)


