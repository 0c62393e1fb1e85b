"""Panels derived from the given tables, in Spark and as SQL, and the query register.

Averages are exact integer sums divided once, so equal inputs give equal doubles
in every engine and ties stay ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators.folds import date_index
from panelyard.operators.label import forward_return
from panelyard.plans.skew import attach
from panelyard.plans.stage import stage, stage_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[r6(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")


def _panel(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.groupBy("date", "stockid").agg(
        (_cents("l_extendedprice") / (n * F.lit(100.0))).alias("px"), F.sum("l_quantity").alias("f_qty"),
        (_cents("l_discount") / (n * F.lit(100.0))).alias("f_disc"),
        (_cents("l_tax") / (n * F.lit(100.0))).alias("f_tax"), n.alias("n"))


def panel(spark: SparkSession, sf: str, unit: str = "month") -> DataFrame:
    """Supplier panel by month or week of shipping."""
    rows = table(spark, sf, "lineitem").withColumns({
        "date": F.trunc(F.col("l_shipdate").cast("date"), unit), "stockid": F.col("l_suppkey")})
    return _panel(rows)


def panel_m(spark, sf):
    return panel(spark, sf, "month")


def panel_w(spark, sf):
    return panel(spark, sf, "week")


def panel_n(spark: SparkSession, sf: str) -> DataFrame:
    """Nation panel: 25 stocks at any scale, for wide matrices."""
    li = table(spark, sf, "lineitem").withColumn("date", F.trunc(F.col("l_shipdate").cast("date"), "month"))
    su = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                             F.col("s_nationkey").cast("long").alias("stockid"))
    return _panel(li.join(su, "l_suppkey"))


def panel_e(spark: SparkSession, sf: str) -> DataFrame:
    """User panel by day of events, with gaps and short histories."""
    kind = F.col("event_type")
    n = F.count("value")
    rows = table(spark, sf, "events").withColumns({"date": F.col("ts").cast("date"), "stockid": F.col("user_id")})
    return rows.groupBy("date", "stockid").agg(
        (_cents("value") / F.nullif(n * F.lit(100.0), F.lit(0.0))).alias("px"),
        *[F.count_if(kind == k).alias(f"f_{k}") for k in ("view", "click", "error", "signup", "purchase")],
        F.count(F.lit(1)).alias("n"))


def labelled(spark, sf, unit="month"):
    return forward_return(panel(spark, sf, unit), "px")


def saved_labels(spark, sf):
    """The labelled panel written once: operators that take several passes start from a saved panel."""
    return stage(labelled(spark, sf), "labels")


def with_gaps(spark, sf):
    """Monthly panel whose factors are missing for thinly traded cells."""
    p = labelled(spark, sf)
    return stage(p.withColumns({"f_disc": F.when(F.col("n") >= 3, F.col("f_disc")),
                                "f_tax": F.when(F.col("n") >= 2, F.col("f_tax"))}), "gaps")


def predictions(spark, sf):
    """Prediction table from the monthly panel: 60 % train, 20 % test, rest future, folds of ten dates."""
    rows = saved_labels(spark, sf).where("y is not null")
    index = date_index(rows)
    n = index.count()
    parts = index.select(
        "date", (F.col("idx") / 10).cast("long").alias("fold"),
        F.when(F.col("idx") * 10 < n * 6, "train").when(F.col("idx") * 10 < n * 8, "test")
        .otherwise("future").alias("part"))
    return attach(rows, parts, ["date"], "inner").select("date", "stockid", F.col("y").alias("y_true"),
                                           F.col("f_qty").alias("y_pred"), "part", "fold")


def class_predictions(spark, sf):
    """Binary predictions: toxicity label against document length, in two parts."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    part = F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train")
    return rows.select("doc_id", F.col("toxic").alias("y_true"), (F.col("n_chars") / F.lit(1000.0)).alias("y_pred"),
                       part.alias("part"))


def saved(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Write a derived table to the shared stage folder; returns its path and scan."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.parquet(path)


staged = stage

# --- the same panels as SQL ----------------------------------------------------


def _panel_sql(date: str, stock: str, source: str) -> str:
    return f"""SELECT {date} AS date, {stock} AS stockid,
 CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/(count(*)*1e2) AS px,
 sum(l_quantity) AS f_qty,
 CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/(count(*)*1e2) AS f_disc,
 CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS DOUBLE)/(count(*)*1e2) AS f_tax,
 count(*) AS n FROM {source} GROUP BY 1, 2"""


PANEL_M = "panel AS (" + _panel_sql("CAST(date_trunc('month', l_shipdate) AS DATE)", "l_suppkey", "lineitem") + ")"
PANEL_W = "panel AS (" + _panel_sql("CAST(date_trunc('week', l_shipdate) AS DATE)", "l_suppkey", "lineitem") + ")"
PANEL_N = "panel AS (" + _panel_sql("CAST(date_trunc('month', l_shipdate) AS DATE)", "CAST(s_nationkey AS BIGINT)",
                                    "lineitem JOIN supplier ON l_suppkey = s_suppkey") + ")"
PANEL_E = """panel AS (SELECT CAST(ts AS DATE) AS date, user_id AS stockid,
 CAST(sum(CAST(round(value*100) AS BIGINT)) AS DOUBLE)/nullif(count(value)*1e2, 0) AS px,
 count(*) FILTER (event_type = 'view') AS f_view, count(*) FILTER (event_type = 'click') AS f_click,
 count(*) FILTER (event_type = 'error') AS f_error, count(*) FILTER (event_type = 'signup') AS f_signup,
 count(*) FILTER (event_type = 'purchase') AS f_purchase, count(*) AS n FROM events GROUP BY 1, 2)"""
LAB = """lab AS (SELECT *, lead(px, 2) OVER ws / nullif(lead(px, 1) OVER ws, 0) - 1 AS y FROM panel
 WINDOW ws AS (PARTITION BY stockid ORDER BY date))"""
GAPS = """gaps AS (SELECT * REPLACE (CASE WHEN n >= 3 THEN f_disc END AS f_disc,
 CASE WHEN n >= 2 THEN f_tax END AS f_tax) FROM lab)"""
PRED = """idx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS nd
 FROM (SELECT DISTINCT date FROM lab WHERE y IS NOT NULL)),
pred AS (SELECT l.date, stockid, y AS y_true, f_qty AS y_pred,
 CASE WHEN idx*10 < nd*6 THEN 'train' WHEN idx*10 < nd*8 THEN 'test' ELSE 'future' END AS part,
 CAST(idx // 10 AS BIGINT) AS fold FROM lab l JOIN idx USING (date) WHERE y IS NOT NULL)"""
CLS = """cls AS (SELECT doc_id, toxic AS y_true, n_chars/1e3 AS y_pred,
 CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS part FROM labels JOIN documents USING (doc_id))"""


def ic_sql(source: str, keys: str, y: str = "y_true", p: str = "y_pred", name: str = "ic") -> str:
    """CTEs giving ``{name}(keys, ic, n)`` by doubled average ranks, whose sums are exact integers."""
    def spread(a: str, b: str) -> str:
        return f"CAST(count(*)*sum({a}*{b}) - sum({a})*sum({b}) AS DOUBLE)"

    return f"""{name}_r AS (SELECT {keys},
 2*rank() OVER (PARTITION BY {keys} ORDER BY {y}) + count(*) OVER (PARTITION BY {keys}, {y}) - 1 AS ry,
 2*rank() OVER (PARTITION BY {keys} ORDER BY {p}) + count(*) OVER (PARTITION BY {keys}, {p}) - 1 AS rp
 FROM {source} WHERE {y} IS NOT NULL AND {p} IS NOT NULL),
{name} AS (SELECT {keys}, {spread('ry', 'rp')}/(sqrt({spread('ry', 'ry')})*sqrt({spread('rp', 'rp')})) AS ic, count(*) AS n
 FROM {name}_r GROUP BY {keys} HAVING min(ry) < max(ry) AND min(rp) < max(rp))"""


def bucket_sql(r: str, n: str, q: int) -> str:
    return f"CASE WHEN {n} < {q} THEN {q // 2} ELSE greatest((({r}-1)*{q} + {n}-2)//({n}-1) - 1, 0) END"


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def rr(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"
