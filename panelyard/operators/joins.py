"""Key joins of panel parts and panel validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.plans.skew import attach, union_all
from panelyard.schema import DATE, STOCK, require_columns

JOIN_KINDS = ("inner", "left", "right", "outer")


def merge_parts(parts: Sequence[DataFrame], *, how: str = "inner", keys: Sequence[str] = (DATE, STOCK)) -> DataFrame:
    """Join column chunks on the key; of a column held twice the first part wins.

    Inner, left and right joins use the same keys, so each part is shuffled once and
    the running result keeps its partitioning. A full join does not keep it, so
    outer parts are put under each other instead and grouped once.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"how must be one of {JOIN_KINDS}")
    if how == "outer" and len(parts) > 1:
        return _outer_merge(parts, list(keys))
    out = parts[0]
    for part in parts[1:]:
        fresh = [c for c in part.columns if c not in out.columns]
        out = out.join(part.select(*keys, *fresh), list(keys), how)
    return out


def _outer_merge(parts: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """Full join of all parts by one shuffle: each part's columns are one struct, and a key gathers the structs.

    As in a join, a key held twice by a part gives two rows, and a missing key meets no other.
    """
    tagged, columns = [], []
    for i, part in enumerate(parts):
        fresh = [c for c in part.columns if c not in keys and c not in [x for own in columns for x in own]]
        columns.append(fresh)
        # the mark keeps a part's row apart from its absence, also when the part adds no column
        tagged.append(part.select(*keys, F.struct(F.lit(True).alias("__here"), *fresh).alias(f"__p{i}")))
    rows = union_all(tagged)
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    merged = rows.where(known).groupBy(*keys).agg(*[F.collect_list(f"__p{i}").alias(f"__p{i}") for i in range(len(parts))])
    for i in range(len(parts)):
        merged = merged.withColumn(f"__p{i}", F.explode_outer(f"__p{i}"))
    # a row without a whole key has the struct of its own part only
    merged = merged.unionByName(rows.where(~known))
    return merged.select(*keys, *[F.col(f"__p{i}")[c].alias(c) for i, own in enumerate(columns) for c in own])


def join_label(df: DataFrame, labels: DataFrame, *, keys: Sequence[str] = (DATE, STOCK)) -> DataFrame:
    return df.join(labels, list(keys), "left")


def attach_group_stats(df: DataFrame, group: Sequence[str], stats: Sequence) -> DataFrame:
    """Put a per-group aggregate back on each row.

    The aggregate is combined map-side and comes back through a measured join,
    so the panel itself is not shuffled and a crowded group stays spread out.
    """
    return attach(df, df.groupBy(*group).agg(*stats), group)


def duplicate_count(df: DataFrame, keys: Sequence[str] = (DATE, STOCK)) -> int:
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]


def validate_long(df: DataFrame, *, required: Sequence[str] = (), keys: Sequence[str] = (DATE, STOCK)) -> DataFrame:
    """Required columns present and the key unique, else an error with the count.

    A unique key also bounds every per-stock window by the number of dates.
    """
    require_columns(df, [*keys, *required])
    extra = duplicate_count(df, keys)
    if extra:
        raise ValueError(f"duplicate {tuple(keys)} rows: {extra}")
    return df


def duplicate_report(df: DataFrame, keys: Sequence[str] = (DATE, STOCK)) -> DataFrame:
    """One row: distinct keys, keys held more than once, surplus rows."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_dup_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus"))


def missing_report(df: DataFrame, columns: Sequence[str], *, date: str = DATE) -> DataFrame:
    """One row of missing counts: the date and each listed column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(date).isNull()).alias(f"{date}_missing"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in columns])


def validate_clean(df: DataFrame, features: Sequence[str], *, strict: bool, date: str = DATE) -> DataFrame:
    """No missing date; under the strict policy no missing feature either."""
    row = missing_report(df, features if strict else [], date=date).first().asDict()
    bad = {k: v for k, v in row.items() if k != "n_rows" and v}
    if bad:
        raise ValueError(f"missing values after cleaning: {bad}")
    return df


def validate_disjoint(df: DataFrame, keys: Sequence[str] = (DATE, STOCK)) -> DataFrame:
    """Stitched blocks must not repeat a key."""
    extra = duplicate_count(df, keys)
    if extra:
        raise ValueError(f"overlapping blocks: {extra} repeated keys")
    return df
