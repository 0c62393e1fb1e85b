"""Shards that all have the mixture of the corpus: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.plans.skew import attach
from panelyard.plans.stage import stage

BUCKET_ROWS = 20_000


def _positions(rows: DataFrame, group: list[str], at: Column, order: list[Column], name: str) -> DataFrame:
    """Add the 1-based position ``name`` of each row in its group and the group's size ``name_n``.

    ``at`` in [0, 1) grows with ``order`` and is spread evenly, so a group is cut
    into as many equal buckets of it as its size needs: no task sees a whole
    group. Positions are ranks inside buckets plus the counts of earlier buckets.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__size"))
    rows = attach(rows, sizes, group)
    buckets = F.ceil(F.col("__size") / BUCKET_ROWS)
    rows = rows.withColumn("__bucket", F.least(F.floor(at * buckets), buckets - 1).cast("long"))
    counts = rows.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # one row per bucket: the input's rows divided by BUCKET_ROWS, plus one per group
    blocks = counts.withColumn("__block", F.floor(F.col("__bucket") / 1024))
    totals = blocks.groupBy(*group, "__block").agg(F.sum("__n").alias("__total"))

    def earlier(keys: list[str], by: str):
        return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)

    totals = totals.withColumn("__before", F.coalesce(F.sum("__total").over(earlier(group, "__block")), F.lit(0)))
    blocks = blocks.join(totals, [*group, "__block"])
    start = F.col("__before") + F.coalesce(F.sum("__n").over(earlier([*group, "__block"], "__bucket")), F.lit(0))
    starts = blocks.select(*group, "__bucket", start.alias("__start"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order)
    rows = rows.withColumn("__in", F.row_number().over(inside))
    rows = attach(rows, starts, [*group, "__bucket"])
    return (rows.withColumn(name, F.col("__start") + F.col("__in")).withColumn(f"{name}_n", F.col("__size"))
            .drop("__size", "__bucket", "__in", "__start"))


def interleave(rows: DataFrame, source: str, key: Column, shards: int, seed: int = 0) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0) to narrow rows.

    Rows of a source are shuffled by a seeded digest of ``key`` and ranked; all
    rows are then ordered by the fractional rank (2 rank - 1) / (2 size) and cut
    into ``shards`` equal pieces. Row counts of shards differ by one at most, and
    each shard's share of a source is the corpus share to within about one row.
    Rows of equal key and source are interchangeable and take neighbouring ranks
    in any order; a null source is a source of its own; no rows give no rows.
    Give each row a key of its own where it can, null keys too: the key spreads
    the rows over tasks. The frame is written once per pass, as narrow as it
    comes, so join wide columns afterwards. Columns named ``shard`` and ``slot``
    are replaced; names that start with ``__`` are used inside.
    """
    rows = rows.drop("shard", "slot")
    rows = rows.withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    rows = stage(rows.withColumn("__digest", digest), "shuffled")
    at = F.conv(F.substring("__digest", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = _positions(rows, ["__source"], at, [F.col("__digest")], "__rank")
    fraction = (2.0 * F.col("__rank") - 1.0) / (2.0 * F.col("__rank_n"))
    rows = stage(rows.withColumn("__fraction", fraction).drop("__rank_n"), "ranked")
    order = [F.col("__fraction"), F.col("__source"), F.col("__rank")]
    rows = _positions(rows.withColumn("__all", F.lit(0)), ["__all"], F.col("__fraction"), order, "__place")
    place = F.col("__place") - 1
    rows = rows.withColumn("shard", F.expr(f"(__place - 1) * {shards} div __place_n"))
    # first place of a shard: the smallest p with p * shards div total = shard
    begin = F.expr(f"(shard * __place_n + {shards - 1}) div {shards}")
    return (rows.withColumn("slot", place - begin).withColumn("shard", F.col("shard").cast("int"))
            .drop("__source", "__digest", "__rank", "__fraction", "__all", "__place", "__place_n"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """One narrow row per document: doc_id, size, text_crc32, law ``rows``, shard, slot, grown_shard (null).

    Size is the UTF-8 length of the text (null: 0) plus 8. The shuffle key is
    the id together with the text's checksum; documents without id are keyed by
    a number fixed when the narrow rows are written.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = stage(rows.withColumn("__row", F.monotonically_increasing_id()), "narrow")
    name = F.when(F.col("doc_id").isNull(), F.concat(F.lit("row "), F.col("__row"))).otherwise(F.col("doc_id").cast("string"))
    placed = interleave(rows, "source", F.concat_ws(":", name, F.col("text_crc32")), shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")
