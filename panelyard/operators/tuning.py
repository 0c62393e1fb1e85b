"""When and how parameters are searched, and which step's model is kept."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date as Date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH_CHARS = 10  # fixed value: length of a parameter hash


def stable_hash(params: dict) -> str:
    """Short hash of a parameter set, independent of key order."""
    text = json.dumps(params, sort_keys=True, ensure_ascii=False)
    return hashlib.md5(text.encode()).hexdigest()[:HASH_CHARS]


def hash_column(json_column):
    """The same hash for a column that already holds sorted JSON text."""
    return F.substring(F.md5(json_column), 1, HASH_CHARS)


def random_candidates(space: dict[str, Sequence | dict], trials: int = 20, seed: int = 42) -> list[dict]:
    """Seeded draws, one value per parameter and trial, the same on every machine.

    A parameter is a list of values, or a range: ``{"type": "float", "low", "high"}``
    or ``"int"``, with ``log`` for draws even in the logarithm or ``step`` for
    values low, low + step, ... (both bounds included), or
    ``{"type": "categorical", "choices"}``.
    """
    draw = random.Random(seed)
    return [{k: _draw(k, v, draw) for k, v in space.items()} for _ in range(trials)]


def _draw(name: str, spec: Sequence | dict, draw: random.Random):
    if not isinstance(spec, dict):
        return draw.choice(list(spec))
    kind = spec.get("type")
    if kind == "categorical":
        return draw.choice(list(spec["choices"]))
    if kind not in ("float", "int"):
        raise ValueError(f"{name}: unknown type {kind}")
    low, high, log, step = spec["low"], spec["high"], spec.get("log", False), spec.get("step")
    whole = kind == "int"
    if high < low or (log and low <= 0) or (step is not None and step <= 0):
        raise ValueError(f"{name}: no range from {low} to {high}")
    if log and step not in (None, 1):
        raise ValueError(f"{name}: a logarithmic range has no step")
    if log:
        # whole numbers: each has the share of the half units around it
        edge = 0.5 if whole else 0.0
        value = math.exp(draw.uniform(math.log(low - edge), math.log(high + edge)))
    elif step is not None or whole:
        step = step or 1
        value = low + step * draw.randint(0, int((high - low) / step + 1e-9))
    else:
        value = draw.uniform(low, high)
    if whole:
        return min(max(round(value), low), high)
    return min(max(float(f"{value:.12g}"), float(low)), float(high))  # the last bits of exp and log differ between machines


@dataclass
class Search:
    best: dict
    score: float
    scores: list[float]


def search(score: Callable[[dict], float], candidates: Sequence[dict], *, parallel: int = 4) -> Search:
    """Score every candidate, several Spark jobs at a time; the first best wins."""
    if not candidates:
        raise ValueError("no candidates to search")
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        scores = list(pool.map(score, candidates))
    at = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return Search(dict(candidates[at]), scores[at], scores)


@dataclass(frozen=True)
class Schedule:
    """Tune every ``every`` steps from step ``start`` on; ``every`` <= 0 means never."""

    every: int = 0
    start: int = 0

    def due(self, step: int) -> bool:
        return self.every > 0 and step >= self.start and (step - self.start) % self.every == 0


def every_k_steps(k: int = 4, offset: int = 0) -> Schedule:
    return Schedule(k, offset % k if k > 0 else 0)


def warmup_then_every_k(warmup: int = 10, k: int = 4) -> Schedule:
    return Schedule(k, warmup)


NEVER = Schedule()


def days_due(anchor: Date, last: Date | None, *, every_days: int = 5, first: bool = True) -> bool:
    """Tune when enough calendar days passed since the last tuning."""
    if last is None:
        return first
    return every_days > 0 and (anchor - last).days >= every_days


def gate_allows(current: float, best: float, min_improve: float = 0.002) -> bool:
    """New parameters must beat the current score by ``min_improve``."""
    return best >= current + min_improve


def choose_step(history: DataFrame, strategy: str = "last", *, last_n: int = 5, score: str = "valid_score") -> DataFrame:
    """The history row whose model is kept: the last, the best, or the best of the last n.

    Of equal scores the earlier step wins. A history has one row per step.
    """
    rows = history
    if strategy == "best_valid_last_n":
        w = Window.orderBy(F.col("step_id").desc())
        rows = history.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= last_n).drop("__r")
    if strategy == "last":
        key = F.struct("step_id")
    elif strategy in ("best_valid", "best_valid_last_n"):
        key = F.struct(F.col(score), -F.col("step_id"))
        rows = rows.where(F.col(score).isNotNull())
    else:
        raise KeyError(f"unknown strategy {strategy}")
    return rows.agg(F.max_by(F.struct(*history.columns), key).alias("r")).where("r is not null").select("r.*")


def history_summary(history: DataFrame, keys: Sequence[str] = (),
                    parts: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """Mean and last score per part, and the number of steps."""
    cols = [f"{p}_score" for p in parts]
    return history.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"),
        *[F.avg(c).alias(f"mean_{c}") for c in cols],
        *[F.max_by(c, "step_id").alias(f"last_{c}") for c in cols])
