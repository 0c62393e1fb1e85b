"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import fold, give_back, ship, texts, tidied
from panelyard.plans.skew import attach


SLICE = 1 << 20


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows of each class on which the linear weights are fitted.

    The log-count ratios use every labelled row.
    """

    orders: tuple[int, ...] = (3, 4, 5, 6, 7)
    bits: int = 20
    sample: int = 2500
    least_docs: int = 3
    rounds: int = 150
    errors: float = 3.0
    penalty: float = 1e-4


@dataclass(frozen=True)
class Model:
    """One weight per n-gram bucket, at most 2**bits of them, and the intercept."""

    weights: np.ndarray
    intercept: float
    settings: Settings


def buckets(text: str, settings: Settings) -> np.ndarray:
    """Distinct hashed character n-grams of the lower-cased whole text, spaces at both ends."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    found = []
    h = chars * np.uint32(2654435761)
    for n in range(2, max(settings.orders) + 1):
        if len(chars) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + chars[n - 1:] * np.uint32(2246822519)
        if n in settings.orders:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(3266489917 + 2 * n)
            found.append((x ^ (x >> np.uint32(13))) >> np.uint32(32 - settings.bits))
    if not found:
        return np.zeros(0, np.int64)
    every = np.concatenate(found)
    owner = _owner(settings.bits)  # the last place that wrote a bucket stands for it
    places = np.arange(len(every), dtype=np.int32)
    owner[every] = places
    return every[owner[every] == places].astype(np.int64)


_OWNERS: dict[int, np.ndarray] = {}


def _owner(bits: int) -> np.ndarray:
    if bits not in _OWNERS:
        _OWNERS[bits] = np.zeros(1 << bits, np.int32)
    return _OWNERS[bits]


def _counts(rows: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents of each class with each bucket, over all labelled rows; 2**bits rows at most come back."""
    size = 1 << settings.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size + 1), np.int64)
        for batch in batches:
            for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen[label, buckets(text, settings)] += 1
                seen[label, size] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["bucket", "clean", "toxic"])

    parts = rows.select("text", "label").mapInArrow(tidied(count), "bucket long, clean long, toxic long")
    total = parts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, size + 1))
    at = total["bucket"].to_numpy()
    seen[0, at], seen[1, at] = total["clean"].to_numpy(), total["toxic"].to_numpy()
    return seen[0, :size], seen[1, :size], int(seen[0, size]), int(seen[1, size])


def _sample(rows: DataFrame, settings: Settings, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, sizes and, row after row, places in ``active`` of the buckets of the rows of each class that come first by a digest.

    A fixed sample of ``settings.sample`` rows per class at most. Digests alone are
    sorted; texts stay where they are, and only active buckets come back.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.flatnonzero(np.isin(active, buckets(t, settings))).astype("<i4").tobytes() for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(packed, pa.binary())], ["label", "digest", "buckets"])

    labels, sizes, places = [], [], []
    for k in (0, 1):
        own = rows.where(F.col("label") == k)
        last = own.select("digest").orderBy("digest").limit(settings.sample).agg(F.max("digest")).first()[0]
        some = own.where(F.col("digest") <= F.lit(last)).select("text", "label", "digest")
        some = some.mapInArrow(tidied(pack), "label int, digest string, buckets binary").orderBy("digest", "buckets").limit(settings.sample)
        for r in some.select("label", "buckets").toLocalIterator():
            labels.append(r[0])
            sizes.append(len(r[1]) // 4)
            places.append(np.frombuffer(r[1], "<i4"))
    return np.array(labels, float), np.array(sizes, np.int64), np.concatenate([*places, np.zeros(0, "<i4")])


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learn) -> DataFrame:
    """text, label (0 or 1), digest of the documents to learn from; rows with a null id or label teach nothing."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.max(F.col(label).cast("int")).alias("label"))
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & learn)
    rows = attach(rows, known, ["doc_id"], "inner")
    return rows.select("text", "label", F.md5(F.concat(F.lit("sample:"), F.col("doc_id").cast("string"))).alias("digest"))


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on rows (text, label, digest). With only one class the model answers that class's rate."""
    clean, toxic, n_clean, n_toxic = _counts(rows, settings)
    prior = np.log((n_toxic + 0.5) / (n_clean + 0.5))
    if not n_clean or not n_toxic:
        return Model(np.zeros(1 << settings.bits, np.float32), float(prior), settings)
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    ratio[clean + toxic < settings.least_docs] = 0.0
    # what the counts leave open is taken off: some standard errors of the ratio, towards 0
    error = np.sqrt(1 / (toxic + 1) + 1 / (clean + 1))
    ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - settings.errors * error, 0)
    active = np.flatnonzero(ratio)
    y, sizes, col = _sample(rows, settings, active)
    scale = ratio[active]
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    weight = 0.5 / share[y.astype(int)]
    ends = np.cumsum(sizes)
    # rows in slices of bounded size, so that no array is as long as the sample but the places themselves
    cuts = np.unique(np.searchsorted(ends, np.arange(0, len(col) + SLICE, SLICE), "right").clip(0, len(y)))
    cuts = np.unique(np.append(cuts, [0, len(y)]))
    w, b = np.full(len(active), 0.05), 0.0
    m, v = np.zeros(len(active) + 1), np.zeros(len(active) + 1)
    for step in range(1, settings.rounds + 1):  # full-batch Adam on the weighted logistic loss
        grad, slope = settings.penalty * w, 0.0
        pull = scale * w
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = col[ends[i] - sizes[i]:ends[j - 1]]
            row = np.repeat(np.arange(j - i), sizes[i:j])
            z = np.bincount(row, pull[at], j - i) + b
            g = weight[i:j] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i:j]) / len(y)
            grad += scale * np.bincount(at, g[row], len(active))
            slope += g.sum()
        grad = np.append(grad, slope)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(1 << settings.bits, np.float32)
    weights[active] = w * ratio[active]
    return Model(weights, float(b), settings)


def scorer(model: Model):
    """Column function text -> score in 0 to 1; null and empty texts get the intercept's."""
    shared = model

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            z = np.array([shared.weights[buckets(t, shared.settings)].sum(dtype=np.float64) for t in texts(column)]) + shared.intercept
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), pa.float64())
        give_back()

    return score


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id modulo 3 is 1. A null id is not held out (and has no label)."""
    return F.coalesce(fold(doc_id, 3) == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text).

    Null ids are scored too; repeated rows score alike; without labelled rows of
    both classes the score is the same for all; an empty table gives no rows.
    Other columns are left out, so their names cannot clash.
    """
    model = fit(labelled_rows(docs, labels, "toxic", ~held_out()), settings)
    rows = docs.select("doc_id", held_out().alias("held_out"), scorer(model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """Rows of ``docs``, all columns, with a score below ``threshold``."""
    model = fit(labelled_rows(docs, labels, "toxic", ~held_out()), settings)
    return docs.where(scorer(model)("text") < threshold)
