"""Fit/transform cleaning with saved state.

``PanelCleaner.fit`` learns which columns stay and the global statistics;
``PanelCleanerModel.transform`` applies exactly the fitted settings to any later
slice. Per-date statistics are always taken from the data at hand.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.operators import cross_section as X
from panelyard.operators import reshape as R
from panelyard.operators.joins import validate_clean, validate_long
from panelyard.operators.rolling import forward_fill
from panelyard.plans.stage import stage
from panelyard.schema import DATE, LABEL, MASK_SUFFIX, RAW_SUFFIX, STOCK, infer_features

FILLS = ("zero", "mean", "median", "ffill_then_zero", "ffill_all", "none")


@dataclass
class CleanSettings:
    """How to clean. ``policy``: strict (nothing missing afterwards) or tree_friendly."""

    policy: str = "strict"
    fill: str = "zero"
    fill_for_tree: bool = False
    ffill_limit: int = 5
    max_col_missing: float = 1.0
    max_row_missing: float = 1.0
    fit_until: str | None = None
    masks: bool = False
    winsorize: str | None = None  # None, "date" or "global"
    lower: float = 0.01
    upper: float = 0.99
    zscore: str | None = None  # None, "date" or "global"
    method: str = "standard"  # or "robust"
    ddof: int = 0
    clip: float | None = None
    eps: float = 1e-12
    scaled: bool = False
    date: str = DATE
    stock: str = STOCK
    label: str = LABEL

    def check(self) -> None:
        if self.policy not in ("strict", "tree_friendly"):
            raise ValueError(f"unknown policy {self.policy}")
        if self.fill not in FILLS:
            raise ValueError(f"unknown fill {self.fill}")
        if self.policy == "strict" and self.fill in ("ffill_all", "none"):
            raise ValueError("the strict policy needs a fill that leaves nothing missing")
        for by in (self.winsorize, self.zscore):
            if by not in (None, "date", "global"):
                raise ValueError(f"statistics are by 'date' or 'global', not {by}")
        if self.method not in ("standard", "robust"):
            raise ValueError(f"unknown z-score method {self.method}")

    @property
    def active_fill(self) -> str:
        return self.fill if self.policy == "strict" or self.fill_for_tree else "none"


@dataclass
class PanelCleaner:
    settings: CleanSettings = field(default_factory=CleanSettings)

    def fit(self, df: DataFrame, features: Sequence[str] | None = None) -> "PanelCleanerModel":
        return self.fit_transform(df, features)[0]

    def fit_transform(self, df: DataFrame, features: Sequence[str] | None = None
                      ) -> tuple["PanelCleanerModel", DataFrame]:
        """Learn on labelled rows; returns the model and the cleaned fit data.

        Each statistic is one pass over ``df`` that repeats only projections and
        broadcasts, so pass a saved panel; it is not copied here.
        """
        s = self.settings
        s.check()
        validate_long(df, keys=[s.date, s.stock])
        rows = R.basic_fix(df, date=s.date)
        if s.label in rows.columns:
            rows = rows.where(F.col(s.label).isNotNull())
        base = list(features) if features else infer_features(rows, date=s.date, stock=s.stock, label=s.label)
        rows, dropped = R.drop_sparse_columns(rows, base, s.max_col_missing, fit_until=s.fit_until, date=s.date)
        base = [c for c in base if c not in dropped]
        rows = R.drop_sparse_rows(rows, base, s.max_row_missing)
        model = PanelCleanerModel(s, base, dropped, {})
        # each global statistic is learnt on the output of the step before it
        rows = model._project(rows)
        model._learn_fill(rows)
        filled = model._fill(rows)
        if s.active_fill.startswith("ffill") and (s.winsorize or s.zscore):
            filled = stage(filled, "clean-filled")  # later passes need not repeat the history windows
        if s.winsorize == "global":
            q = X.column_quantiles(filled, base, [s.lower, s.upper])
            model.stats["lo"] = {c: v[0] for c, v in q.items()}
            model.stats["hi"] = {c: v[1] for c, v in q.items()}
        bounded = model._winsorize(filled)
        if s.zscore == "global":
            model._learn_zscore(bounded)
        return model, model._finish(model._zscore(bounded))


@dataclass
class PanelCleanerModel:
    settings: CleanSettings
    base: list[str]
    dropped: list[str]
    stats: dict[str, dict[str, float | None]]

    # --- learning -------------------------------------------------------------

    def _learn_fill(self, df: DataFrame) -> None:
        fill = self.settings.active_fill
        if fill == "mean":
            self.stats["fill"] = X.column_means(df, self.base)
        elif fill == "median":
            self.stats["fill"] = X.column_medians(df, self.base)

    def _learn_zscore(self, df: DataFrame) -> None:
        s = self.settings
        if s.method == "standard":
            self.stats["mu"] = X.column_means(df, self.base)
            self.stats["sd"] = X.column_std(df, self.base, s.ddof)
        else:
            self.stats["mu"] = X.column_medians(df, self.base)
            self.stats["sd"] = X.column_mad(df, self.base, self.stats["mu"])

    # --- steps ----------------------------------------------------------------

    def _keep(self, df: DataFrame) -> list[str]:
        s = self.settings
        return [c for c in (s.date, s.stock, s.label, s.label + RAW_SUFFIX) if c in df.columns]

    def _project(self, df: DataFrame) -> DataFrame:
        rows = R.align_features(df, self.base, self._keep(df))
        return R.add_missing_masks(rows, self.base) if self.settings.masks else rows

    def _fill(self, df: DataFrame) -> DataFrame:
        s = self.settings
        fill = s.active_fill
        if fill == "zero":
            return X.fill_values(df, dict.fromkeys(self.base, 0.0))
        if fill in ("mean", "median"):
            return X.fill_values(df, self.stats["fill"])
        if fill in ("ffill_then_zero", "ffill_all"):
            zero = fill == "ffill_then_zero"
            return forward_fill(df, self.base, limit=s.ffill_limit if zero else None, zero_rest=zero,
                                date=s.date, stock=s.stock)
        return df

    def _winsorize(self, df: DataFrame) -> DataFrame:
        s = self.settings
        if s.winsorize == "date":
            return X.winsorize_by_date(df, self.base, lower=s.lower, upper=s.upper, date=s.date)
        if s.winsorize == "global":
            lo, hi = self.stats["lo"], self.stats["hi"]
            return X.winsorize_global(df, {c: (lo[c], hi[c]) for c in self.base})
        return df

    def _zscore(self, df: DataFrame) -> DataFrame:
        s = self.settings
        robust = s.method == "robust"
        if s.zscore == "date":
            if robust:
                return X.robust_zscore_by_date(df, self.base, eps=s.eps, scaled=s.scaled, clip=s.clip, date=s.date)
            return X.zscore_by_date(df, self.base, ddof=s.ddof, clip=s.clip, date=s.date)
        if s.zscore == "global":
            scale = X.ROBUST_SCALE if robust and s.scaled else 1.0
            return X.zscore_global(df, self.stats["mu"], self.stats["sd"], clip=s.clip,
                                   eps=s.eps if robust else 0.0, scale=scale)
        return df

    def _finish(self, df: DataFrame) -> DataFrame:
        """Fixed column order: keys, label, features, masks."""
        masks = [c + MASK_SUFFIX for c in self.base] if self.settings.masks else []
        return df.select(*self._keep(df), *self.base, *masks)

    # --- use ------------------------------------------------------------------

    def transform(self, df: DataFrame, *, validate: bool = False) -> DataFrame:
        """Apply the fitted cleaning: no row is dropped, absent features are added."""
        s = self.settings
        rows = self._project(R.basic_fix(df, date=s.date))
        out = self._finish(self._zscore(self._winsorize(self._fill(rows))))
        return validate_clean(out, self.base, strict=s.policy == "strict", date=s.date) if validate else out

    def state(self) -> dict:
        return {"settings": asdict(self.settings), "base": self.base, "dropped": self.dropped, "stats": self.stats}

    def state_table(self, spark: SparkSession) -> DataFrame:
        """Learnt statistics as ``(stat, col, value)``, one row per column and statistic."""
        rows = [(k, c, v) for k, cols in self.stats.items() for c, v in cols.items()]
        return spark.createDataFrame(rows, "stat string, col string, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        """State as one JSON text file, readable from any node."""
        spark.createDataFrame([(json.dumps(self.state()),)], "value string").coalesce(1).write.mode(
            "overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PanelCleanerModel":
        raw = json.loads(spark.read.text(path).first()[0])
        return PanelCleanerModel(CleanSettings(**raw["settings"]), raw["base"], raw["dropped"], raw["stats"])
