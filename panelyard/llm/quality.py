"""Quality: document classifier evidence combined with host and path posteriors by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import byte_rows, tidied
from panelyard.llm.toxicity import labelled_rows
from panelyard.plans.skew import attach
from panelyard.plans.stage import stage

#: class of each byte: 1 upper, 2 lower, 3 digit, 4 punctuation, 5 white space, 6 line end, 0 other
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 4
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 5, 6


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows on which the document classifier is fitted."""

    sample: int = 40_000
    penalty: float = 1.0
    threshold: float = 0.5


def features(data: bytes) -> list[float]:
    """Measures of a whole text, all zero without words."""
    words = data.split()
    if not words:
        return [0.0] * 9
    n = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=7)
    size, count = len(data), len(words)
    lines = data.split(b"\n")
    distinct = len(set(words))
    solid = size - n[5] - n[6]
    return [np.log(count), np.log(distinct) / np.log(count + 1), distinct / count, n[1] / solid, n[4] / solid, n[3] / solid,
            min(solid / count, 50.0) / 10, len(set(lines)) / len(lines), len(lines) / count]


def _expand(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x**2, x[:, :1] * x[:, 1:]], axis=1)


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_expand(x) - self.centre) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -8, 8)


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Logistic regression by reweighted least squares on rows (text, label, digest), ``settings.sample`` at most."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in byte_rows(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *batch.columns[1:]], ["x", "label", "digest"])

    measured = rows.select("text", "label", "digest").mapInArrow(tidied(measure), "x array<double>, label int, digest string")
    found = measured.orderBy("digest").limit(settings.sample).select("x", "label").toArrow()
    y = found["label"].to_numpy().astype(float)
    if not len(y):
        return Model(np.zeros(26), np.ones(26), np.zeros(27))
    x = _expand(np.array(found["x"].to_pylist()))
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = np.column_stack([np.clip((x - centre) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, settings.penalty), 1e-3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -15, 15)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Model(centre, scale, w)


def evidence(model: Model):
    """Column function text -> log odds of good quality by the document alone."""
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = np.array([features(t) for t in byte_rows(column)]).reshape(-1, 9)
            yield pa.array(model.logit(x), pa.float64())

    return score


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def site_posteriors(rows: DataFrame, least_strength: float = 2.0, most_strength: float = 200.0) -> DataFrame:
    """One row per (host, path): sums of the evidence and the priors it is shrunk to.

    Beta priors by moments: the rate of a host varies around the global rate,
    and the rate of a path around its host's, by more than documents alone
    explain; the excess gives the prior's strength (in documents). Sites of few
    documents keep close to the prior. All sums are grouped and combined before
    the shuffle, so a host with a third of all rows is as cheap as others.
    """
    paths = stage(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("good").alias("good_host"))

    def strength(n: Column, good: Column, base: Column) -> Column:
        """Method of moments for the strength of a beta prior, from groups of at least two documents."""
        used = n >= 2
        gap = F.sum(F.when(used, n * (good / n - base) ** 2))
        noise = F.sum(F.when(used, base * (1 - base)))
        room = F.sum(F.when(used, (n - 1) * base * (1 - base)))
        between = F.coalesce((gap - noise) / room, F.lit(0.0))  # 1 / (strength + 1)
        return F.when(between <= 1 / (most_strength + 1), F.lit(most_strength)).otherwise(
            F.greatest(1 / between - 1, F.lit(least_strength)))

    n, good = hosts.agg(F.sum("n_host"), F.sum("good_host")).first()
    rate = min(max((good or 0.0) / n, 1e-3), 1 - 1e-3) if n else 0.5
    host = hosts.agg(strength(F.col("n_host"), F.col("good_host"), F.lit(rate)).alias("s")).first()["s"] or most_strength
    sites = attach(paths, hosts, ["host"]).withColumn("base", F.least(F.greatest(
        (host * rate + F.col("good_host")) / (host + F.col("n_host")), F.lit(1e-3)), F.lit(1 - 1e-3)))
    path = sites.agg(strength(F.col("n"), F.col("good"), F.col("base")).alias("s")).first()["s"] or most_strength
    return sites.drop("base").withColumns({"rate": F.lit(rate), "host_strength": F.lit(float(host)), "path_strength": F.lit(float(path))})


def combine(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Add p_host, p_path, score to rows (host, path, logit, p): each without the document's own evidence."""
    rows = attach(rows, sites, ["host", "path"])
    host = (F.col("host_strength") * F.col("rate") + F.col("good_host") - F.col("p")) / (F.col("host_strength") + F.col("n_host") - 1)
    rows = rows.withColumn("p_host", F.least(F.greatest(host, F.lit(1e-3)), F.lit(1 - 1e-3)))
    path = (F.col("path_strength") * F.col("p_host") + F.col("good") - F.col("p")) / (F.col("path_strength") + F.col("n") - 1)
    rows = rows.withColumn("p_path", F.least(F.greatest(path, F.lit(1e-3)), F.lit(1 - 1e-3)))
    shift = F.log(F.col("p_path") / (1 - F.col("p_path"))) - F.log(F.col("rate") / (1 - F.col("rate")))
    return rows.withColumn("score", _sigmoid(F.col("logit") + shift)).drop(
        "n", "good", "n_host", "good_host", "rate", "host_strength", "path_strength")


def _site(docs: DataFrame, host: str, path: str, model: Model) -> DataFrame:
    rows = docs.withColumns({"host": F.coalesce(F.col(host).cast("string"), F.lit("")),
                             "path": F.coalesce(F.col(path).cast("string"), F.lit("")), "logit": evidence(model)("text")})
    return rows.withColumn("p", _sigmoid(F.col("logit")))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """doc_id, host, path, p_doc, p_host, p_path, score, kept of every row of ``docs``.

    ``path`` is a level below ``host``: a folder of the site, here the language
    section. A null host or path is a site of its own, named by the empty string;
    null and empty texts are measured as a text without words; repeated rows are
    judged alike; without labels the evidence is even and everything is kept; an
    empty table gives no rows. Other columns are left out.
    """
    model = fit(labelled_rows(docs, labels, "quality", F.lit(True)), settings)
    rows = stage(_site(docs, host, path, model).select("doc_id", "host", "path", "logit", "p"), "evidence")
    rows = combine(rows, site_posteriors(rows))
    return rows.select("doc_id", "host", "path", F.col("p").alias("p_doc"), "p_host", "p_path", "score",
                       (F.col("score") >= settings.threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """Rows of ``docs`` that :func:`judge` keeps, with the columns of ``docs``."""
    model = fit(labelled_rows(docs, labels, "quality", F.lit(True)), settings)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).alias("h"), F.col(path).alias("q"), "text")
    rows = _site(whole, "h", "q", model)
    sites = site_posteriors(rows.select("host", "path", "p"))
    return combine(rows.drop("h", "q", "text"), sites).where(F.col("score") >= settings.threshold).select("row.*")
