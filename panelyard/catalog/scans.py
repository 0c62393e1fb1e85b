"""Sources, sinks, projections, reshapes, joins, validation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelyard.catalog.base import (
    GAPS, LAB, PANEL_M, PANEL_N, PRED, labelled, panel_m, panel_n, predictions, query, r6, rounded, rr, saved, saved_labels, sql,
    table, with_gaps,
)
from panelyard.operators import joins as J
from panelyard.operators import reshape as R
from panelyard.operators.clean import CleanSettings, PanelCleaner, PanelCleanerModel
from panelyard.operators.evaluate import canonical_order, part_metrics
from panelyard.operators.folds import assign_folds, date_index, rolling_folds
from panelyard.operators.rolling import check_complete
from panelyard.plans.stage import stage, stage_path
from panelyard.schema import base_columns, infer_features, rename_label
from panelyard.sources import panel as P
from panelyard.sources import tables as T

ROW = ["date", "stockid", "px", "f_qty", "f_disc", "f_tax"]


@query("s1_long_scan", """SELECT CAST(l_shipdate AS DATE) AS l_shipdate, l_suppkey, l_quantity FROM lineitem
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-02-01' AND DATE '1999-01-31'""")
def s1(spark, sf):
    return P.scan_long(spark, f"{sf}/lineitem.parquet", ["l_shipdate", "l_suppkey", "l_quantity"],
                       start="1998-02-01", end="1999-01-31", date="l_shipdate")


@query("s2_load_panel", sql(PANEL_M, LAB, """rk AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY y NULLS LAST)
 + (count(*) OVER (PARTITION BY date, y) - 1)/2e0) / count(y) OVER (PARTITION BY date) AS r FROM lab)""",
    body=f"SELECT date, stockid, {rr('CASE WHEN y IS NOT NULL THEN r END', 'y')}, {rr('y', 'y_raw')}, f_tax, f_qty FROM rk"))
def s2(spark, sf):
    path, _ = saved(panel_m(spark, sf), "panel")
    out = P.load_panel(spark, path, ["f_tax", "f_disc", "f_qty"], mask=["f_qty", "f_tax"], price="px",
                       post={"keep_raw": True, "rank": {}})
    return rounded(out, "y", "y_raw")


@query("s3_load_chunks", sql(PANEL_M, body=f"""SELECT a.date, a.stockid, a.f_qty, {rr('b.f_disc', 'f_disc')}
FROM panel a LEFT JOIN (SELECT * FROM panel WHERE n >= 3) b USING (date, stockid)
WHERE a.date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'"""))
def s3(spark, sf):
    p = stage(panel_m(spark, sf))
    one, _ = saved(p.select("date", "stockid", "px", "f_qty"), "chunk")
    two, _ = saved(p.where("n >= 3").select("date", "stockid", "f_disc", "f_qty"), "chunk")
    keys, _ = saved(p.select("date", "stockid"), "chunk")
    out = P.load_chunks(spark, [one, keys, two], ["f_qty", "f_disc"], how="left", start="1997-01-01",
                        end="2000-12-31", label=None)
    return rounded(out, "f_disc")


@query("s3_load_chunks_label", sql(PANEL_M, LAB, body=f"SELECT date, stockid, {rr('y')}, f_qty, {rr('f_disc')} FROM lab"))
def s3_label(spark, sf):
    p = stage(panel_m(spark, sf))
    one, _ = saved(p.select("date", "stockid", "px", "f_qty"), "chunk")
    two, _ = saved(p.select("date", "stockid", "f_disc"), "chunk")
    return rounded(P.load_chunks(spark, [one, two], ["f_qty", "f_disc"], price="px"), "y", "f_disc")


def _wide_folder(spark, sf):
    """One matrix per field; the second lacks the last year."""
    p = stage(panel_n(spark, sf))
    folder = stage_path(spark, "wide")
    stocks = [r[0] for r in p.select("stockid").distinct().orderBy("stockid").collect()]  # nations
    R.to_matrix(p, "f_qty", stocks=stocks).write.parquet(f"{folder}/f_qty.parquet")
    R.to_matrix(p.where("date < '2001-01-01'"), "f_disc", stocks=stocks).write.parquet(f"{folder}/f_disc.parquet")
    return folder, p


WIDE_SQL = """grid AS (SELECT d.date, s.stockid FROM (SELECT DISTINCT date FROM panel) d,
 (SELECT DISTINCT stockid FROM panel) s)"""


@query("s4_load_wide", sql(PANEL_N, WIDE_SQL, body=f"""SELECT date, stockid, f_qty,
{rr("CASE WHEN date < DATE '2001-01-01' THEN f_disc END", 'f_disc')} FROM grid LEFT JOIN panel USING (date, stockid)"""))
def s4(spark, sf):
    folder, _ = _wide_folder(spark, sf)
    return rounded(P.load_wide(spark, folder, ["f_qty", "f_disc"], stock_type="long"), "f_disc")


@query("s5_cross_section", sql(PANEL_M, body=f"SELECT date, stockid, f_qty, {rr('f_tax')} FROM panel WHERE date = DATE '1999-05-01'"))
def s5(spark, sf):
    path, _ = saved(panel_m(spark, sf), "panel")
    return rounded(P.load_cross_section(spark, "1999-05-01", ["f_qty", "f_tax"], path=path), "f_tax")


@query("s5_cross_section_chunks", sql(PANEL_M, body=f"SELECT date, stockid, f_qty, {rr('f_tax')} FROM panel WHERE date = DATE '1999-05-01'"))
def s5_chunks(spark, sf):
    p = stage(panel_m(spark, sf))
    one, _ = saved(p.select("date", "stockid", "f_qty"), "chunk")
    two, _ = saved(p.select("date", "stockid", "f_tax"), "chunk")
    return rounded(P.load_cross_section(spark, "1999-05-01", ["f_qty", "f_tax"], paths=[one, two]), "f_tax")


@query("s5_cross_section_wide", sql(PANEL_N, WIDE_SQL, body="""SELECT DATE '2001-03-01' AS date, s.stockid, f_qty,
CAST(NULL AS DOUBLE) AS f_disc FROM (SELECT DISTINCT stockid FROM panel) s
LEFT JOIN (SELECT * FROM panel WHERE date = DATE '2001-03-01') p USING (stockid)"""))
def s5_wide(spark, sf):
    folder, _ = _wide_folder(spark, sf)
    return P.load_cross_section(spark, "2001-03-01", ["f_qty", "f_disc"], folder=folder, stock_type="long")


STATS = """stats AS (SELECT 'f_disc' AS feature, avg(f_disc) AS m, 1 AS o FROM panel UNION ALL
 SELECT 'f_qty', avg(f_qty), 2 FROM panel UNION ALL SELECT 'f_tax', avg(f_tax), 3 FROM panel)"""


@query("s7_feature_mask_rows", sql(PANEL_M, STATS, body="""SELECT feature,
row_number() OVER (ORDER BY o) AS position FROM stats WHERE m < 1"""))
def s7_rows(spark, sf):
    p = panel_m(spark, sf)
    means = p.agg(*[F.avg(c).alias(c) for c in ("f_disc", "f_qty", "f_tax")])
    rows = means.unpivot([], ["f_disc", "f_qty", "f_tax"], "feature", "m")
    path = stage_path(spark, "mask")
    out = rows.select("feature", (F.col("m") < 1).cast("int").alias("use"))
    out.unionByName(out).coalesce(1).write.option("header", True).csv(path)
    return T.read_feature_mask(spark, path)


@query("s7_feature_mask_wide", sql(PANEL_M, STATS, body="""SELECT feature,
row_number() OVER (ORDER BY o) AS position FROM stats WHERE m < 1"""))
def s7_wide(spark, sf):
    means = panel_m(spark, sf).agg(*[(F.avg(c) < 1).cast("int").alias(c) for c in ("f_disc", "f_qty", "f_tax")])
    path = stage_path(spark, "mask")
    means.coalesce(1).write.option("header", True).csv(path)
    return T.read_feature_mask(spark, path)


@query("s8_use_flags", sql(PANEL_M, body="""SELECT date, unnest(['f_disc', 'f_qty']) AS factor,
unnest([CASE WHEN avg(f_disc) > 0.05 THEN 1e0 ELSE 0e0 END, 0e0]) AS flag FROM panel GROUP BY date"""))
def s8(spark, sf):
    daily = panel_m(spark, sf).groupBy("date").agg((F.avg("f_disc") > 0.05).cast("int").cast("string").alias("f_disc"))
    path = stage_path(spark, "flags")
    old = daily.select("date", F.lit("1").alias("f_disc"), F.lit("1").alias("f_qty"), F.lit(0).alias("o"))
    new = daily.select("date", "f_disc", F.lit("n/a").alias("f_qty"), F.lit(1).alias("o"))
    # two rows per date, the later one wins; text that is no number counts as 0
    (old.unionByName(new).coalesce(1).sortWithinPartitions("date", "o").drop("o")
     .write.option("header", True).csv(path))
    return T.read_use_flags(spark, path)


@query("s10_predictions", sql(PANEL_M, LAB, PRED, body=f"""SELECT date, stockid, {rr('y_true')}, y_pred, part, fold
FROM pred WHERE part IN ('test', 'future') AND fold BETWEEN 5 AND 7"""))
def s10(spark, sf):
    path = stage_path(spark, "preds")
    T.write_predictions(predictions(spark, sf).withColumn("step_id", F.col("fold")), path)
    out = T.read_predictions(spark, path, parts=["test", "future"], folds=[5, 6, 7], steps=(5, 7))
    return rounded(out.select("date", "stockid", "y_true", "y_pred", "part", F.col("fold").cast("long").alias("fold")),
                   "y_true")


@query("s11_factor_predictions", sql(PANEL_M, LAB, PRED, body="""SELECT date, stockid, y_pred FROM pred WHERE part = 'test'"""))
def s11(spark, sf):
    path = stage_path(spark, "preds")
    T.write_predictions(predictions(spark, sf), path)
    return T.read_factor_predictions(spark, path, parts=["test"]).select("date", "stockid", "y_pred")


@query("s12_slice", sql(PANEL_M, body="""SELECT date, stockid, f_qty FROM panel
WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-09-01'"""))
def s12(spark, sf):
    path = stage_path(spark, "clean")
    P.write_panel(panel_m(spark, sf), path)
    return P.read_slice(spark, path, columns=["date", "stockid", "f_qty"], start="1998-03-01", end="1998-09-01")


@query("s13_latest", sql(PANEL_M, body="SELECT date, stockid, f_qty FROM panel WHERE date = (SELECT max(date) FROM panel)"))
def s13(spark, sf):
    return P.latest_section(panel_m(spark, sf)).select("date", "stockid", "f_qty")


@query("s14_dates", sql(PANEL_M, body="SELECT DISTINCT date FROM panel"))
def s14(spark, sf):
    return P.panel_dates(panel_m(spark, sf))


@query("s15_prediction_sink", sql(PANEL_M, LAB, PRED, body="""SELECT part, fold, count(*) AS n,
CAST(sum(y_pred) AS DOUBLE) AS total FROM pred WHERE part <> 'train' GROUP BY 1, 2"""))
def s15(spark, sf):
    path = stage_path(spark, "preds")
    rows = predictions(spark, sf)
    T.write_predictions(rows, path, parts=["test", "future"])
    T.write_predictions(rows.where("part = 'test'"), path)  # a rerun replaces its own folders only
    back = spark.read.parquet(path)
    return back.groupBy("part", F.col("fold").cast("long").alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_pred").alias("total"))


@query("s16_panel_sink", sql(PANEL_M, body="SELECT date, count(*) AS n, sum(f_qty) AS total FROM panel GROUP BY 1"))
def s16(spark, sf):
    path = stage_path(spark, "clean")
    P.write_panel(panel_m(spark, sf), path)
    return spark.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("f_qty").alias("total"))


@query("s17_metrics_csv", sql(PANEL_M, LAB, PRED, body=f"""SELECT part, {rr('avg(abs(y_true - y_pred))', 'mae', 4)},
count(*) AS n FROM pred GROUP BY part"""))
def s17(spark, sf):
    path = stage_path(spark, "metrics")
    T.write_metrics_csv(part_metrics(predictions(spark, sf), ["mae"]), path)
    return rounded(spark.read.option("header", True).schema("part string, mae double, n long").csv(path), "mae", digits=4)


GLOBAL_STATS = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in ("f_qty", "f_disc", "f_tax"))


@query("s18_state", sql(PANEL_M, LAB, "f AS (SELECT * FROM lab WHERE y IS NOT NULL)", body=" UNION ALL ".join(
    f"SELECT '{c}' AS col, 'mu' AS stat, {rr(f'avg({c})', 'value')} FROM f UNION ALL "
    f"SELECT '{c}', 'sd', round(stddev_pop({c}), 6) + 0.0 FROM f" for c in ("f_qty", "f_disc", "f_tax"))))
def s18(spark, sf):
    model = PanelCleaner(CleanSettings(zscore="global")).fit(saved_labels(spark, sf), ["f_qty", "f_disc", "f_tax"])
    path = stage_path(spark, "state")
    model.save(spark, path)
    back = PanelCleanerModel.load(spark, path).state_table(spark)
    return back.select("col", "stat", r6("value").alias("value"))


@query("s19_samples", sql(PANEL_M, LAB, body=f"SELECT date, stockid, {rr('y')}, f_qty FROM lab WHERE y IS NOT NULL"))
def s19(spark, sf):
    path = stage_path(spark, "samples")
    P.write_samples(labelled(spark, sf).where("y is not null"), path, ["date", "stockid", "y", "f_qty", "f_tax"])
    return rounded(spark.read.parquet(path).select("date", "stockid", "y", "f_qty"), "y")


FOLD_SQL = """dx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM panel)),
nn AS (SELECT count(*) AS n, greatest(CAST(floor(count(*)*0.5) AS BIGINT), 20) AS w FROM dx),
fs AS (SELECT s // 12 AS fold, s, w, CAST(floor(w*0.7) AS BIGINT) AS nt, CAST(floor(w*0.1) AS BIGINT) AS nv
 FROM (SELECT unnest(generate_series(0, n - w, 12)) AS s, w FROM nn)),
sp AS (SELECT fold, 'train' AS part, s AS a, s + nt - 1 AS b FROM fs UNION ALL
 SELECT fold, 'valid', s + nt, s + nt + nv - 1 FROM fs UNION ALL SELECT fold, 'test', s + nt + nv, s + w - 1 FROM fs)"""
FOLD_ARGS = dict(window_ratio=0.5, min_dates=20, step_days=12, train=0.7, valid=0.1, test=0.2)


@query("s20_split_sink", sql(PANEL_M, FOLD_SQL, body="""SELECT fold, part, count(*) AS n, sum(f_qty) AS total
FROM panel JOIN dx USING (date) JOIN sp ON idx BETWEEN a AND b GROUP BY 1, 2"""))
def s20(spark, sf):
    p = stage(panel_m(spark, sf))
    index = stage(date_index(p))
    path = stage_path(spark, "folds")
    P.write_folds(assign_folds(p, rolling_folds(index, **FOLD_ARGS), index), path)
    return spark.read.parquet(path).groupBy(F.col("fold").cast("long").alias("fold"), "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("f_qty").alias("total"))


# --- projections and reshapes --------------------------------------------------


@query("p1_mask_projection", sql(PANEL_M, body=f"SELECT date, stockid, {rr('f_tax')}, f_qty FROM panel"))
def p1(spark, sf):
    from panelyard.schema import filter_by_mask

    fields = filter_by_mask(["f_tax", "f_disc", "f_qty"], ["f_qty", "f_tax", "absent"])
    return rounded(panel_m(spark, sf).select("date", "stockid", *fields), "f_tax")


@query("p2_inferred_features", sql(PANEL_M, body="""SELECT unnest(['f_disc','f_qty','f_tax','is_big','n']) AS factor,
unnest([round(sum(f_disc),4), sum(f_qty), round(sum(f_tax),4), sum(CASE WHEN n > 5 THEN 1e0 ELSE 0 END), CAST(sum(n) AS DOUBLE)]) AS total
FROM panel"""))
def p2(spark, sf):
    p = labelled(spark, sf).withColumns({"note": F.lit("text"), "is_big": F.col("n") > 5})
    cols = infer_features(p, exclude=["px"])
    long = p.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "factor", "v")
    return long.groupBy("factor").agg(F.round(F.sum("v"), 4).alias("total"))


@query("p3_label_rename", sql(PANEL_M, LAB, body=f"SELECT date, stockid, {rr('y')} FROM lab"))
def p3(spark, sf):
    df = labelled(spark, sf).withColumnRenamed("y", "ret_2d")
    return rounded(rename_label(df, "y", ["target", "ret_2d"]).select("date", "stockid", "y"), "y")


@query("p4_basic_fix", sql(PANEL_M, body=f"""SELECT date, stockid,
CASE WHEN n > 2 THEN px END AS px, f_qty FROM panel WHERE n <> 4"""))
def p4(spark, sf):
    n = F.col("n")
    inf = F.lit(float("inf"))
    dirty = panel_m(spark, sf).withColumns({
        "px": F.when(n == 1, F.lit(float("nan"))).when(n == 2, F.when(F.col("stockid") % 2 == 0, inf).otherwise(-inf))
        .otherwise(F.col("px")),
        "date": F.when(n == 4, "no date").otherwise(F.date_format("date", "yyyy-MM-dd"))})
    return R.basic_fix(dirty).select("date", "stockid", "px", "f_qty")


@query("p5_float32", sql(PANEL_M, body=f"SELECT date, stockid, {rr('CAST(CAST(f_disc AS FLOAT) AS DOUBLE)', 'f_disc', 8)} FROM panel"))
def p5(spark, sf):
    out = R.cast_float32(panel_m(spark, sf).select("date", "stockid", "f_disc"), ["f_disc"])
    return rounded(out, "f_disc", digits=8)


@query("p6_drop_missing_label", sql(PANEL_M, LAB, body="""SELECT part, count(*) AS n FROM (
SELECT CASE WHEN y IS NULL THEN 'dropped' ELSE 'kept' END AS part FROM lab) GROUP BY 1"""))
def p6(spark, sf):
    kept, seen = R.drop_missing_label(labelled(spark, sf))
    n = kept.count()
    out = spark.range(2).select(F.when(F.col("id") == 0, "kept").otherwise("dropped").alias("part"),
                                F.when(F.col("id") == 0, F.lit(n)).otherwise(F.lit(seen.get["dropped"])).alias("n"))
    return out.select("part", F.col("n").cast("long").alias("n"))


@query("p7_drop_sparse_columns", sql(PANEL_M, LAB, GAPS, body="""SELECT unnest(['f_disc','f_qty','f_tax']) AS factor, unnest([
CASE WHEN avg(CASE WHEN f_disc IS NULL THEN 1 ELSE 0 END) > 0.05 THEN 'dropped' ELSE 'kept' END,
CASE WHEN avg(CASE WHEN f_qty IS NULL THEN 1 ELSE 0 END) > 0.05 THEN 'dropped' ELSE 'kept' END,
CASE WHEN avg(CASE WHEN f_tax IS NULL THEN 1 ELSE 0 END) > 0.05 THEN 'dropped' ELSE 'kept' END]) AS state FROM gaps"""))
def p7(spark, sf):
    g = with_gaps(spark, sf)
    _, dropped = R.drop_sparse_columns(g, ["f_disc", "f_qty", "f_tax"], 0.05)
    names = g.agg(*[F.lit("dropped" if c in dropped else "kept").alias(c) for c in ("f_disc", "f_qty", "f_tax")])
    return names.unpivot([], ["f_disc", "f_qty", "f_tax"], "factor", "state")


@query("p8_drop_sparse_rows", sql(PANEL_M, LAB, GAPS, body="""SELECT date, stockid, f_qty FROM gaps
WHERE (CASE WHEN f_disc IS NULL THEN 1 ELSE 0 END + CASE WHEN f_tax IS NULL THEN 1 ELSE 0 END) / 3e0 <= 0.4"""))
def p8(spark, sf):
    return R.drop_sparse_rows(with_gaps(spark, sf), ["f_disc", "f_qty", "f_tax"], 0.4).select("date", "stockid", "f_qty")


@query("p9_missing_masks", sql(PANEL_M, LAB, GAPS, body=f"""SELECT date, stockid, {rr('f_disc')},
CASE WHEN f_disc IS NULL THEN 1e0 ELSE 0e0 END AS f_disc__miss, CASE WHEN f_tax IS NULL THEN 1e0 ELSE 0e0 END AS f_tax__miss
FROM gaps"""))
def p9(spark, sf):
    out = R.add_missing_masks(with_gaps(spark, sf), ["f_disc", "f_tax"])
    return out.select("date", "stockid", r6("f_disc").alias("f_disc"), F.col("f_disc__miss").cast("double").alias("f_disc__miss"),
                      F.col("f_tax__miss").cast("double").alias("f_tax__miss"))


@query("p10_align_features", sql(PANEL_M, body=f"""SELECT date, stockid, CAST(NULL AS DOUBLE) AS f_new,
{rr('f_tax')}, f_qty FROM panel"""))
def p10(spark, sf):
    return rounded(R.align_features(panel_m(spark, sf), ["f_new", "f_tax", "f_qty"]), "f_tax")


@query("p11_base_columns", sql(PANEL_M, body=f"SELECT date, stockid, f_qty, {rr('f_disc')} FROM panel"))
def p11(spark, sf):
    masked = R.add_missing_masks(panel_m(spark, sf).select("date", "stockid", "f_qty", "f_disc"), ["f_qty", "f_disc"])
    return rounded(masked.select("date", "stockid", *base_columns([c for c in masked.columns if c.startswith("f_")])), "f_disc")


@query("p12_model_sample", sql(PANEL_M, LAB, body=f"""SELECT date, stockid, {rr('y')}, f_qty AS x0,
{rr('f_tax', 'x1')} FROM lab WHERE y IS NOT NULL"""))
def p12(spark, sf):
    rows = R.assemble(labelled(spark, sf).where("y is not null"), ["f_qty", "f_tax"])
    arr = vector_to_array("features")
    return rows.select("date", "stockid", r6("y").alias("y"), arr[0].alias("x0"), r6(arr[1]).alias("x1"))


@query("r1_wide_to_long", sql(PANEL_N, WIDE_SQL, body=f"""SELECT date, stockid, f_qty,
{rr("CASE WHEN date < DATE '2001-01-01' THEN f_disc END", 'f_disc')}, px
FROM grid LEFT JOIN panel USING (date, stockid)"""))
def r1(spark, sf):
    folder, p = _wide_folder(spark, sf)
    fields = {f: spark.read.parquet(f"{folder}/{f}.parquet") for f in ("f_qty", "f_disc")}
    fields["px"] = R.to_matrix(p, "px", stocks=p)
    return rounded(R.wide_to_long(fields, label="px", stock_type="long"), "f_disc")


@query("r2_factor_matrix", sql(PANEL_N, body="SELECT date, " + ", ".join(
    f"max(CASE WHEN stockid = {i} THEN f_qty END) AS s{i}" for i in range(25)) + " FROM panel GROUP BY date"))
def r2(spark, sf):
    out = R.to_matrix(panel_n(spark, sf), "f_qty", stocks=list(range(25)))
    return out.select("date", *[F.col(str(i)).alias(f"s{i}") for i in range(25)])


@query("r3_jsonify", sql(PANEL_M, body="""SELECT date, CAST(count(*) AS BIGINT) AS n,
'{"lo":' || min(n) || ',"hi":' || max(n) || '}' AS span FROM panel GROUP BY date"""))
def r3(spark, sf):
    daily = panel_m(spark, sf).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.struct(F.min("n").alias("lo"), F.max("n").alias("hi")).alias("span"))
    return R.jsonify(daily)


@query("r4_date_filter", sql(PANEL_M, body="""SELECT date, stockid, f_qty FROM panel
WHERE date IN (SELECT date FROM panel GROUP BY date HAVING sum(n) % 2 = 0)"""))
def r4(spark, sf):
    p = panel_m(spark, sf)
    even = p.groupBy("date").agg(F.sum("n").alias("s")).where("s % 2 = 0")
    return R.filter_dates(p, even).select("date", "stockid", "f_qty")


# --- joins and validation ------------------------------------------------------

for _how in J.JOIN_KINDS:
    _kind = {"outer": "FULL OUTER"}.get(_how, _how.upper())

    @query(f"j1_merge_{_how}", sql(PANEL_M, body=f"""SELECT date, stockid, a.f_qty, {rr('b.f_disc', 'f_disc')}
FROM (SELECT * FROM panel WHERE n <= 9) a {_kind} JOIN (SELECT * FROM panel WHERE n >= 3) b USING (date, stockid)"""))
    def j1(spark, sf, how=_how):
        p = stage(panel_m(spark, sf))
        a = p.where("n <= 9").select("date", "stockid", "f_qty")
        b = p.where("n >= 3").select("date", "stockid", (F.col("f_qty") * 0 - 1).alias("f_qty"), "f_disc")
        return rounded(J.merge_parts([a, b], how=how), "f_disc")


@query("j2_label_join", sql(PANEL_M, LAB, body=f"""SELECT p.date, p.stockid, p.f_qty, {rr('l.y', 'y')} FROM panel p
LEFT JOIN (SELECT date, stockid, y FROM lab WHERE y > 0) l USING (date, stockid)"""))
def j2(spark, sf):
    lab = stage(labelled(spark, sf))
    up = lab.where("y > 0").select("date", "stockid", "y")
    return rounded(J.join_label(lab.select("date", "stockid", "f_qty"), up), "y")


@query("j3_group_stats", sql(PANEL_M, body=f"""SELECT date, stockid, f_qty,
{rr('avg(f_qty) OVER (PARTITION BY date)', 'mean')}, count(*) OVER (PARTITION BY date) AS n_stocks FROM panel"""))
def j3(spark, sf):
    p = panel_m(spark, sf)
    out = J.attach_group_stats(p, ["date"], [F.avg("f_qty").alias("mean"), F.count(F.lit(1)).alias("n_stocks")])
    return rounded(out.select("date", "stockid", "f_qty", "mean", "n_stocks"), "mean")


@query("j4_membership", sql(PANEL_M, body="""SELECT date, stockid, f_qty FROM panel WHERE stockid IN
(SELECT stockid FROM panel GROUP BY stockid HAVING count(*) >= 82)"""))
def j4(spark, sf):
    p = panel_m(spark, sf)
    busy = p.groupBy("stockid").agg(F.count(F.lit(1)).alias("k")).where("k >= 82")
    return R.filter_members(p, busy, ["stockid"]).select("date", "stockid", "f_qty")


@query("j5_fold_assignment", sql(PANEL_M, FOLD_SQL, body="""SELECT fold, part, date, stockid, f_qty
FROM panel JOIN dx USING (date) JOIN sp ON idx BETWEEN a AND b"""))
def j5(spark, sf):
    p = stage(panel_m(spark, sf))
    index = stage(date_index(p))
    return assign_folds(p, rolling_folds(index, **FOLD_ARGS), index).select("fold", "part", "date", "stockid", "f_qty")


@query("v1_duplicate_keys", """SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS n_dup_keys,
CAST(sum(n - 1) AS BIGINT) AS n_surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_shipdate, l_suppkey)""")
def v1(spark, sf):
    return J.duplicate_report(table(spark, sf, "lineitem"), ["l_shipdate", "l_suppkey"])


@query("v2_clean_checks", sql(PANEL_M, LAB, GAPS, body="""SELECT count(*) AS n_rows,
count(*) FILTER (date IS NULL) AS date_missing, count(*) FILTER (f_disc IS NULL) AS f_disc_missing,
count(*) FILTER (f_tax IS NULL) AS f_tax_missing FROM gaps"""))
def v2(spark, sf):
    return J.missing_report(with_gaps(spark, sf), ["f_disc", "f_tax"])


@query("v3_disjoint_blocks", sql(PANEL_M, LAB, PRED, body="""SELECT 'future_all' AS part, count(*) AS n FROM pred WHERE part = 'future'"""))
def v3(spark, sf):
    from panelyard.operators.evaluate import future_table

    return future_table(predictions(spark, sf)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("v4_sequence_check", sql(PANEL_M, LAB, body="SELECT count(*) AS n FROM lab WHERE y IS NOT NULL"))
def v4(spark, sf):
    rows = labelled(spark, sf).where("y is not null")
    return check_complete(rows, ["f_qty", "f_disc"]).agg(F.count(F.lit(1)).alias("n"))


@query("k1_canonical_order", sql(PANEL_M, body="SELECT date, stockid, f_qty FROM panel"))
def k1(spark, sf):
    return canonical_order(panel_m(spark, sf).select("date", "stockid", "f_qty"))
