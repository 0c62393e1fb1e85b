"""Skew-safe building blocks shared by the operators.

Two bounds keep every task and every broadcast small:

* ``rows_per_task`` - a group above it (one crowded date, one factor, the whole
  table) is never ranked, sorted or collected in one task. At most
  ``MAX_HOT_GROUPS`` groups can be above the limit, because the limit is never
  lower than ``total rows / MAX_HOT_GROUPS``.
* ``BROADCAST_BYTES`` - a side is broadcast only after its rows and bytes were
  counted; beyond the bound the join is a salted shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.plans.stage import stage

ROWS_PER_TASK = 4_000_000
MAX_HOT_GROUPS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
SKETCH_ACCURACY = 10_000
SKETCH_CUTS = 128
WIDE_QUANTILE_COLUMNS = 64


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.panelyard.rowsPerTask", str(ROWS_PER_TASK)))


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.panelyard.broadcastBytes", str(BROADCAST_BYTES)))


# --- size-checked joins -------------------------------------------------------


def _value_bytes(kind: T.DataType, c: Column) -> int | Column:
    """Bytes of one value in memory: a number where all values of the type are alike, else a column."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        inner = [_value_bytes(f.dataType, c[f.name]) for f in kind.fields]
        return reduce(lambda a, b: a + b, inner, 16)
    if isinstance(kind, T.ArrayType):
        return _items_bytes(kind.elementType, c)
    if isinstance(kind, T.MapType):
        return _items_bytes(kind.keyType, F.map_keys(c)) + _items_bytes(kind.valueType, F.map_values(c))
    if isinstance(kind, T.DecimalType):
        return 24
    if isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType) or isinstance(kind, T.NullType):
        return 8
    raise TypeError(f"size of {kind.simpleString()} cannot be measured")


def _items_bytes(kind: T.DataType, c: Column) -> Column:
    each = _value_bytes(kind, c[0])
    if isinstance(each, int):
        return F.coalesce(F.size(c), F.lit(0)) * each + 24
    total = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + _value_bytes(kind, x))
    return F.coalesce(total, F.lit(0)) + 24


def measured_bytes(df: DataFrame) -> int:
    """In-memory size of a small staged table: fixed widths plus counted lengths, at every depth of its columns."""
    fixed, counted = 16, []
    for f in df.schema.fields:
        each = _value_bytes(f.dataType, F.col(f"`{f.name}`"))
        if isinstance(each, int):
            fixed += each
        else:
            counted.append(F.sum(each))
    row = df.agg(F.count(F.lit(1)), *counted).first()
    return row[0] * fixed + sum(v or 0 for v in row[1:])


def salted_join(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Shuffle join that spreads each key of ``df`` over ``SALTS`` tasks.

    ``how`` is one of inner, left, left_semi, left_anti: the kinds in which
    repeating the right side per salt cannot repeat a result row. The salt
    is a digest of the row, not a random number, so a repeated task deals its
    rows as before, whatever their order; rows equal in every column stay together.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not support how={how}")
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    left = df.withColumn("__salt", salt)
    right = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def attach(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table that is expected to be small, after measuring it.

    The table is staged first, so that measuring does not compute it twice.
    """
    small = stage(table, "attach")
    if measured_bytes(small) <= broadcast_bytes(df.sparkSession):
        return df.join(F.broadcast(small), list(on), how)
    return salted_join(df, small, on, how)


def attach_one_row(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Add driver-side scalars (one aggregate row) as literal columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


# --- hot groups ---------------------------------------------------------------


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group: one aggregate over the group columns alone."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def split_hot(df: DataFrame, group: Sequence[str], width: int = 1) -> tuple[DataFrame, DataFrame | None, int]:
    """Divide rows into ordinary groups and groups too large for one task.

    Returns ``(cold, hot, limit)``; ``hot`` is ``None`` when every group fits,
    which costs one aggregate over the group columns alone (combined map-side).
    ``width`` is the number of cells a row adds to the state of its group.
    """
    spark = df.sparkSession
    least = max(1, rows_per_task(spark) // width)
    if not group:
        n = df.count()
        if n <= least:
            return df, None, least
        return df.limit(0), stage(df, "hot"), max(least, n // MAX_HOT_GROUPS)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    total, largest = sizes.agg(F.sum("__n"), F.max("__n")).first()
    limit = max(least, (total or 0) // MAX_HOT_GROUPS)
    if (largest or 0) <= limit:
        return df, None, limit
    # at most MAX_HOT_GROUPS rows: each stands for more than total / MAX_HOT_GROUPS rows
    hot = F.broadcast(stage(sizes.where(F.col("__n") > limit).select(*group), "hot"))
    # hot rows are read in several passes: written once, in as many files as they need
    rows = stage(df.join(hot, list(group), "left_semi"), "hot")
    return df.join(hot, list(group), "left_anti"), rows, limit


def in_order(df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Range-sort rows and write them with ``__pid`` and 1-based ``__pos`` per group.

    Range partitioning splits a hot group by its order key; the position comes
    from the row number inside each partition plus the row counts of earlier
    partitions, so no task ever sees a whole hot group.
    """
    parts = max(2, -(-df.count() // max(limit, 1)))
    keys = [F.col(c) for c in group] + list(order)
    rows = stage(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__seq", F.monotonically_increasing_id()),
        "ordered",
    )
    # one row per (partition, group): at most parts + number of hot groups
    runs = rows.groupBy("__pid", *group).agg(F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    return (
        rows.join(F.broadcast(runs), ["__pid", *group])
        .withColumn("__pos", F.col("__before") + F.col("__seq") - F.col("__first") + 1)
        .drop("__seq", "__first", "__before")
    )


# --- ranks --------------------------------------------------------------------

RANK_METHODS = ("average", "min", "max", "first", "dense")
NA_OPTIONS = ("keep", "top", "bottom")


def add_ranks(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    out: str,
    *,
    method: str = "average",
    tie_break: Sequence[str] = (),
    pct: bool = False,
    na_option: str = "keep",
    count_out: str | None = None,
) -> DataFrame:
    """Rank ``value`` inside each group; rows without a value get a NULL rank.

    ``na_option`` shifts the others (``top``) and sets the divisor of ``pct``
    (non-null rows for ``keep``, all rows otherwise, distinct values for dense).
    ``count_out`` names a column for the number of non-null values of the group.
    """
    if method not in RANK_METHODS:
        raise ValueError(f"unknown rank method {method}")
    if na_option not in NA_OPTIONS:
        raise ValueError(f"unknown na_option {na_option}")
    if method == "first" and not tie_break:
        raise ValueError("method='first' needs a tie_break to be deterministic")
    cold, hot, limit = split_hot(df, group)
    ranked = _rank_by_window(cold, group, value, method, tie_break)
    if hot is not None:
        ranked = ranked.unionByName(_rank_by_range(hot, group, value, method, tie_break, limit))
    v = F.col(value)
    rank = F.col("__rank").cast("double")
    missing = F.col("__rows") - F.col("__valid")
    if na_option == "top":
        # the missing rows share the first place; for dense they count as one value
        lead = F.least(missing, F.lit(1)) if method == "dense" else missing
        rank = rank + lead
    if pct:
        if method == "dense":
            extra = F.lit(0) if na_option == "keep" else F.least(missing, F.lit(1))
            rank = rank / (F.col("__distinct") + extra)
        else:
            rank = rank / (F.col("__valid") if na_option == "keep" else F.col("__rows"))
    extra_cols = [F.col("__valid").alias(count_out)] if count_out else []
    return ranked.select(*df.columns, F.when(v.isNotNull(), rank).alias(out), *extra_cols)


def average_ranks(df: DataFrame, group: Sequence[str], outs: dict[str, str], *, small: bool = False) -> DataFrame:
    """Average ranks of several complete columns: one split, one exchange for all of them.

    ``small`` says that the caller has already bounded the group size.
    """
    cold, hot, limit = (df, None, 0) if small else split_hot(df, group)
    base = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))

    def rank(v):
        w = base.orderBy(v)
        return F.rank().over(w) + (F.count(v).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2

    ranked = cold.withColumns({o: rank(v) for v, o in outs.items()})
    if hot is None:
        return ranked
    for v, o in outs.items():
        hot = _rank_by_range(hot, group, v, "average", (), limit).select(*hot.columns, F.col("__rank").alias(o))
    return ranked.unionByName(hot)


def _rank_by_window(df, group, value, method, tie_break):
    v = F.col(value)
    base = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ordered = base.orderBy(v.asc_nulls_last(), *[F.col(c) for c in tie_break if method == "first"])
    peers = F.count(v).over(ordered.rangeBetween(Window.currentRow, Window.currentRow)) if method != "first" else None
    rank = {
        "average": lambda: F.rank().over(ordered) + (peers - 1) / 2,
        "min": lambda: F.rank().over(ordered),
        "max": lambda: F.rank().over(ordered) + peers - 1,
        "first": lambda: F.row_number().over(ordered),
        "dense": lambda: F.dense_rank().over(ordered),
    }[method]()
    out = df.withColumns({
        "__rank": rank.cast("double"),
        "__valid": F.count(v).over(base),
        "__rows": F.count(F.lit(1)).over(base),
    })
    distinct = F.lit(None).cast("long")
    if method == "dense":
        distinct = F.max(F.when(v.isNotNull(), F.col("__rank"))).over(base).cast("long")
    return out.withColumn("__distinct", distinct)


def _rank_by_range(df, group, value, method, tie_break, limit):
    """Ranks of hot groups. ``first`` sorts by a unique key; the others rank the
    distinct values, so that equal values, however many, are one row until the end."""
    v = F.col(value)
    valid = df.where(v.isNotNull())
    if method == "first":
        ranked = in_order(valid, group, [v, *[F.col(c) for c in tie_break]], limit)
        ranked = ranked.select(*df.columns, F.col("__pos").cast("double").alias("__rank"))
    else:
        ranked = _rank_by_distinct(valid, group, value, method, limit)
    missing = df.where(v.isNull()).withColumn("__rank", F.lit(None).cast("double"))
    out = ranked.unionByName(missing)
    sizes = df.groupBy(*group).agg(F.count(v).alias("__valid"), F.count(F.lit(1)).alias("__rows"))
    if method == "dense":
        top = ranked.groupBy(*group).agg(F.max("__rank").cast("long").alias("__distinct"))
        sizes = sizes.join(top, list(group), "left") if group else attach_one_row(sizes, top.first().asDict())
    else:
        sizes = sizes.withColumn("__distinct", F.lit(None).cast("long"))
    if group:
        return attach(out, sizes, group)  # one row per hot group
    return attach_one_row(out, sizes.first().asDict())


def _rank_by_distinct(valid, group, value, method, limit):
    keys = [*group, value]
    counts = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"), F.lit(1).alias("__one"))
    parts = max(2, -(-valid.count() // max(limit, 1)))
    table = running_totals(counts, group, value, {"__m": "__hi", "__one": "__dense"}, parts=parts)
    hi, m = F.col("__hi"), F.col("__m")
    rank = {"average": hi - (m - 1) / 2, "min": hi - m + 1, "max": hi, "dense": F.col("__dense")}[method]
    table = stage(table.select(*keys, "__m", rank.cast("double").alias("__rank")), "ranks")
    # a value above the limit stands for more than ``limit`` rows, so such values are
    # few and their side is broadcast; every other key fits a task of the shuffle join
    heavy, light = table.where(m > limit).drop("__m"), table.where(m <= limit).drop("__m")
    if heavy.isEmpty():
        return valid.join(light, keys)
    few = F.broadcast(heavy)
    return valid.join(few, keys).unionByName(valid.join(few, keys, "left_anti").join(light, keys))


# --- exact quantiles ----------------------------------------------------------


def quantile_table(df: DataFrame, group: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per group, an array per column.

    Ordinary groups use the exact ``percentile`` aggregate. Hot groups (or the
    whole table) are narrowed by sketches and exact counts, round after round, to
    brackets that one task may see, so no state holds a whole group.
    """
    group, cols, probs = list(group), list(cols), [float(p) for p in probs]
    data = df.select(*group, *[F.col(c).cast("double").alias(c) for c in cols])
    # the percentile state holds every distinct value of a group, for each column
    cold, hot, _ = split_hot(data, group, len(cols) if len(cols) <= WIDE_QUANTILE_COLUMNS else 1)
    if hot is None:
        return _percentiles(cold, group, cols, probs)
    long = _melt(hot, group, cols)
    found = _to_wide(_select_quantiles(long, [*group, "__col"], probs), group, cols)
    return found if not group else _percentiles(cold, group, cols, probs).unionByName(found)


def _melt(df, group, cols):
    return df.unpivot(list(group), list(cols), "__col", "__v").where(F.col("__v").isNotNull())


def _to_wide(long, group, cols):
    """One row per group from rows (group, column, quantiles); the map holds one entry per column."""
    packed = F.map_from_entries(F.collect_list(F.struct("__col", "__q"))).alias("__map")
    return long.groupBy(*group).agg(packed).select(
        *group, *[F.try_element_at("__map", F.lit(c)).alias(c) for c in cols])


def _percentiles(df, group, cols, probs):
    ps = F.array(*[F.lit(p) for p in probs])
    if len(cols) <= WIDE_QUANTILE_COLUMNS:
        return df.groupBy(*group).agg(*[F.percentile(c, ps).alias(c) for c in cols])
    # many columns: group by (group, column) so that the work spreads over more tasks
    long = _melt(df, group, cols).groupBy(*group, "__col").agg(F.percentile("__v", ps).alias("__q"))
    return _to_wide(long, group, cols)


def _select_quantiles(long: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Exact order statistics of large groups without moving the groups.

    Each wanted position starts with the whole group as its bracket. A mergeable
    sketch inside the bracket proposes three values; counting the rows before,
    between and at them is exact and tells in which part the position lies, so the
    part becomes the next bracket, however far off the sketch is. The middle value
    is one of the bracket's, so every round leaves something out. Once a bracket
    holds one value or as few rows as a task may see, its values are counted.
    """
    limit = rows_per_task(long.sparkSession)
    ranks = [f(p) for p in probs for f in (_low_rank, _high_rank)]
    whole = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), _cuts(F.col("__v")).alias("__c"))
    start = [F.struct(
        rank.alias("k"), F.col("__min").alias("lo"), F.col("__max").alias("hi"), F.lit(0).cast("long").alias("below"),
        F.col("__n").alias("inside"), F.col("__c").alias("cuts")) for rank in ranks]
    # one row per hot group: bounded by MAX_HOT_GROUPS times the column count
    state = stage(whole.select(*keys, "__n", F.array(*start).alias("__b")), "brackets")
    while not state.where(F.exists("__b", lambda b: _open(b, limit))).isEmpty():
        narrow = stage(_narrowed(long, state, keys, len(ranks), limit), "brackets")
        rows = attach_brackets(long, narrow.where(F.exists("__b", lambda b: _open(b, limit))), keys)
        again = [_cuts(F.when(_open(b, limit) & F.col("__v").between(b["lo"], b["hi"]), F.col("__v"))) for b in _each(len(ranks))]
        cuts = rows.groupBy(*keys).agg(F.array(*again).alias("__again"))
        new = F.transform("__b", lambda b, i: b.withField("cuts", F.coalesce(F.col("__again")[i], b["cuts"])))
        state = stage(narrow.join(cuts, keys, "left").select(*keys, "__n", new.alias("__b")), "brackets")
    return _pick(long, state, keys, probs, ranks)


def _low_rank(p: float) -> Column:
    return F.floor((F.col("__n") - 1) * F.lit(p))


def _high_rank(p: float) -> Column:
    return F.ceil((F.col("__n") - 1) * F.lit(p))


def _cuts(v: Column) -> Column:
    return F.percentile_approx(v, [i / SKETCH_CUTS for i in range(SKETCH_CUTS + 1)], SKETCH_ACCURACY)


def _each(n: int) -> list[Column]:
    return [F.col("__b")[i] for i in range(n)]


def _open(b: Column, limit: int) -> Column:
    return (b["inside"] > limit) & (b["lo"] < b["hi"])


def _narrowed(long: DataFrame, state: DataFrame, keys: list[str], n: int, limit: int) -> DataFrame:
    """Brackets cut down to the part that holds their position: counts alone decide, combined map-side."""
    at = F.transform("__b", lambda b: F.floor((b["k"] - b["below"]) / b["inside"] * SKETCH_CUTS).cast("int"))
    proposed = F.zip_with("__b", at, lambda b, g: F.struct(
        *[b[f] for f in ("k", "lo", "hi", "below", "inside", "cuts")],
        b["cuts"][F.greatest(g - 1, F.lit(0))].alias("x"), b["cuts"][g].alias("y"),
        b["cuts"][F.least(g + 2, F.lit(SKETCH_CUTS))].alias("z")))
    state = state.select(*keys, "__n", proposed.alias("__b"))
    v = F.col("__v")
    counted = []
    for i, b in enumerate(_each(n)):
        inside = _open(b, limit) & v.between(b["lo"], b["hi"])
        parts = [v < b["x"], (v >= b["x"]) & (v < b["y"]), v == b["y"], (v > b["y"]) & (v <= b["z"]), v > b["z"]]
        counted.append(F.array(*[
            F.struct(F.count_if(inside & part).alias("n"), F.min(F.when(inside & part, v)).alias("lo"),
                     F.max(F.when(inside & part, v)).alias("hi")) for part in parts]).alias(f"__p{i}"))
    counts = attach_brackets(long, state, keys).groupBy(*keys).agg(*counted)
    out = []
    for i, b in enumerate(_each(n)):
        parts, chosen, before = F.col(f"__p{i}"), None, b["below"]
        for j in range(5):
            part = F.struct(b["k"].alias("k"), parts[j]["lo"].alias("lo"), parts[j]["hi"].alias("hi"), before.alias("below"),
                            parts[j]["n"].alias("inside"), b["cuts"].alias("cuts"))
            here = b["k"] < before + parts[j]["n"]
            chosen = F.when(here, part) if chosen is None else chosen.when(here, part)
            before = before + parts[j]["n"]
        kept = F.struct(*[b[f].alias(f) for f in ("k", "lo", "hi", "below", "inside", "cuts")])
        out.append(F.when(_open(b, limit), chosen).otherwise(kept))
    return state.join(counts, keys).select(*keys, "__n", F.array(*out).alias("__b"))


def _pick(long: DataFrame, state: DataFrame, keys: list[str], probs: list[float], ranks: list[Column]) -> DataFrame:
    """Values at the positions of closed brackets, interpolated; a bracket's rows are within the bound of a task."""
    numbered = F.transform("__b", lambda b, i: F.struct(i.alias("t"), *[b[f] for f in ("k", "lo", "hi", "below")]))
    state = state.select(*keys, "__n", numbered.alias("__b"))
    alone = state.select(*keys, F.explode("__b").alias("b")).where("b.lo = b.hi").select(
        *keys, F.col("b.t").alias("__t"), F.col("b.lo").alias("__x"))
    hit = F.filter("__b", lambda b: (b["lo"] < b["hi"]) & F.col("__v").between(b["lo"], b["hi"]))
    inside = attach_brackets(long, state, keys).select(*keys, "__v", F.explode(hit).alias("b"))
    bracket = [*keys, "__t"]
    counts = inside.groupBy(*keys, F.col("b.t").alias("__t"), "__v").agg(
        F.count(F.lit(1)).alias("__m"), F.first(F.col("b.k") - F.col("b.below")).alias("__at"))
    end = F.sum("__m").over(Window.partitionBy(*bracket).orderBy("__v"))  # at most the rows of a closed bracket
    found = counts.withColumn("__end", end).where((F.col("__end") > F.col("__at")) & (F.col("__end") - F.col("__m") <= F.col("__at")))
    found = alone.unionByName(found.select(*bracket, F.col("__v").alias("__x")))
    x = found.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("__t") == t, F.col("__x"))) for t in range(len(ranks))]).alias("__x"))
    x = x.join(state.select(*keys, "__n"), keys)
    values = []
    for i, p in enumerate(probs):
        at = (F.col("__n") - 1) * F.lit(p)
        lo_w, hi_w = F.floor(at) + 1 - at, at - F.floor(at)
        lo, hi = F.col("__x")[2 * i], F.col("__x")[2 * i + 1]
        # the weighted form of Spark's percentile; a whole position takes the value itself
        values.append(F.when(hi_w == 0, lo).otherwise(lo * lo_w + hi * hi_w))
    return x.select(*keys, F.array(*values).alias("__q"))


def attach_brackets(long, brackets, keys):
    if measured_bytes(brackets) * 4 <= broadcast_bytes(long.sparkSession):
        return long.join(F.broadcast(brackets), keys)
    return salted_join(long, brackets, keys, "inner")


# --- running totals -----------------------------------------------------------


def running_totals(
    df: DataFrame, group: Sequence[str], order: str, sums: dict[str, str], *, descending: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Prefix sums along ``order`` (unique per group) in two levels.

    Rows are range-partitioned and staged; each partition is summed locally and
    shifted by the totals of earlier partitions (one small row per partition).
    Without ``parts`` there are as many partitions as the counted rows need.
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    if parts is None:
        df = stage(df, "prefix")
        parts = max(2, -(-df.count() // rows_per_task(df.sparkSession)))
    rows = stage(
        df.repartitionByRange(parts, *[F.col(c) for c in group], key).withColumn("__pid", F.spark_partition_id()),
        "prefix")
    totals = rows.groupBy("__pid", *group).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__pid", *group, *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__before_{c}") for c in sums])
    local = Window.partitionBy("__pid", *group).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    joined = attach(rows, totals, ["__pid", *group], "inner")  # partitions + groups rows
    return joined.select(*df.columns, *[
        (F.sum(c).over(local) + F.col(f"__before_{c}")).alias(o) for c, o in sums.items()])


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order``. The maximum is combined map-side,
    so a key with very many copies never gathers in one task."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(newest).select(*keys, "__row.*").select(*df.columns)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
