"""Exact top-k inner products, pruned by segment means and deviations from coarse to fine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import ship
from panelyard.plans.stage import stage

BLOCK = 2048
BLOCK_BYTES = 1 << 21
RUN_BYTES = 1 << 25
EXACT_FLOATS = 1 << 53


def levels(dim: int) -> list[int]:
    """Segments per level: 1, 4, 16, ... and last segments of two components, as far as the dimension divides."""
    steps = [s for s in (4 ** k for k in range(16)) if dim and dim % s == 0 and 2 * s < dim]
    return steps + ([dim // 2] if dim > 1 and dim % 2 == 0 else [])


def arrangement(q: np.ndarray) -> np.ndarray:
    """Order of the components by their sums over the queries: segments of alike components tell more.

    Any order leaves an inner product as it is, if both sides take the same one.
    """
    return np.argsort(q.sum(axis=0), kind="stable")


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row."""
    parts = x.reshape(len(x), segments, -1).astype(np.float64)
    return parts.mean(axis=2), parts.std(axis=2)


def bound(q: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """Upper bound of every inner product from segment statistics.

    In a segment of ``length`` components the product is length * (mean * mean +
    covariance), and the covariance is at most the product of deviations; the
    same statistics bound the distance from below. One unit covers rounding.
    """
    high = length * (q[0] @ x[0].T + q[1] @ x[1].T)
    return high + 1e-9 * np.abs(high) + 1.0


def exact_scores(q: np.ndarray, x: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, exact integer product) of the pairs marked in ``alive``.

    Many survivors are cut out of one product of matrices, which is exact in
    doubles while every sum stays under 2**53; few, or larger ones, are
    multiplied pair by pair in integers.
    """
    row, col = np.nonzero(alive)
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if 32 * len(row) > alive.size and largest < EXACT_FLOATS:
        return row, col, (q.astype(np.float64) @ x.T.astype(np.float64))[row, col].astype(np.int64)
    exact = np.empty(len(row), np.int64)
    for at in range(0, len(row), 1 << 16):
        span = slice(at, at + (1 << 16))
        exact[span] = np.einsum("ij,ij->i", q[row[span]], x[col[span]])
    return row, col, exact


def best_of_block(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, step: int = 1024,
                  survivors: dict[int, int] | None = None):
    """(query, id, score) of the k best rows of ``x`` for each query, none with a score under ``least``.

    Rows come in slices; each level drops the pairs whose bound is under the
    query's k-th best score so far, and the survivors get exact integer scores.
    A level that dropped less than an eighth of a slice's pairs is left out for
    the next seven slices; this changes the work, not the result. ``survivors``
    counts the pairs that are left after each level (0: those that came in).
    """
    dim = q.shape[1]
    steps, order = levels(dim), arrangement(q)
    stats = [segment_statistics(q[:, order], s) for s in steps]
    score = np.full((len(q), k), np.iinfo(np.int64).min)
    name = np.full((len(q), k), np.iinfo(np.int64).max)
    least = least.copy()
    idle = dict.fromkeys(steps, 0)
    for low in range(0, len(ids), step):
        part, names = x[low:low + step], ids[low:low + step]
        alive = q_ids[:, None] != names[None, :]
        count = int(alive.sum())
        if survivors is not None:
            survivors[0] = survivors.get(0, 0) + count
        arranged = part[:, order]
        for s, of_q in zip(steps, stats, strict=True):
            if idle[s]:
                idle[s] -= 1
            else:
                alive &= bound(of_q, segment_statistics(arranged, s), dim // s) >= least[:, None]
                left = int(alive.sum())
                idle[s] = 7 if 8 * (count - left) < count else 0
                count = left
            if survivors is not None:
                survivors[s] = survivors.get(s, 0) + count
            if not count:
                break
        row, col, exact = exact_scores(q, part, alive)
        keep = exact >= least[row]
        row, col, exact = row[keep], col[keep], exact[keep]
        if not len(row):
            continue
        # merge with the best so far: by query, falling score, rising id
        have = np.repeat(np.arange(len(q)), k)
        rows, names_, scores = np.append(have, row), np.append(name.ravel(), names[col]), np.append(score.ravel(), exact)
        place = np.lexsort((names_, -np.maximum(scores, -(1 << 62)), rows))
        rows = rows[place]
        top = place[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
        name, score = names_[top].reshape(len(q), k), scores[top].reshape(len(q), k)
        least = np.maximum(least, score[:, -1])
    row, col = np.nonzero(score > np.iinfo(np.int64).min)
    return row, name[row, col], score[row, col]


def _usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, integer vector, dim: one row per id, the smallest vector of an id that repeats."""
    whole = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(good, whole).alias("v"))
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.size("v").alias("dim"))


def _blocks(rows: DataFrame, block: int) -> tuple[DataFrame, dict[int, int]]:
    """dim, block, ids, vectors: rows packed into blocks of about ``block`` rows or ``BLOCK_BYTES``, as bytes; and blocks per dimension."""
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {d: -(-n // max(1, min(block, BLOCK_BYTES // (8 * max(d, 1))))) for d, n in sizes.items()}
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), _per_dim(counts)))

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = table["v"].combine_chunks().flatten().to_numpy()
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()],
                         "ids": [table["id"].to_numpy().astype("<i8").tobytes()], "vectors": [flat.astype("<i8").tobytes()]},
                        schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())]))

    return rows.groupBy("dim", "block").applyInArrow(pack, "dim int, block long, ids binary, vectors binary"), counts


def _per_dim(values: dict[int, int]) -> Column:
    """The value of a row's dimension, 1 where there is none."""
    if not values:
        return F.lit(1).cast("long")
    found = F.create_map(*[F.lit(x) for d, n in values.items() for x in (d, n)])
    return F.coalesce(F.element_at(found, F.col("dim")).cast("long"), F.lit(1).cast("long"))


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of some blocks of one dimension."""
    dim = table["dim"][0].as_py()
    ids = np.frombuffer(b"".join(table["ids"].to_pylist()), "<i8")
    return ids, np.frombuffer(b"".join(table["vectors"].to_pylist()), "<i8").reshape(len(ids), dim)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64, block: int = BLOCK, run_bytes: int = RUN_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each query, ties to smaller ids.

    Components become floor(scale * x). Both sides are packed into blocks of
    bounded size; every query block meets every block of rows of its dimension.
    Blocks of rows are dealt to runs of about ``run_bytes``, and one task takes
    one query block through one run and carries its k best along: queries x runs
    x k rows come out. A first pass over one block of rows per query block gives
    each query a score it can surely reach k times, so that the second pass only
    keeps rows at or above it. Vectors that are null or hold null or non-finite
    components, and null ids, take no part; a repeated id stands once, with its
    smallest vector; vectors of different dimensions are not compared, empty ones
    score 0; a query with fewer rows gets all; empty tables give no rows. Other
    columns are left out.
    """
    ship(vectors.sparkSession)
    made, row_blocks = _blocks(_usable(vectors, id_col, vector_col, scale), block)
    rows = stage(made, "rows")
    made, query_blocks = _blocks(_usable(queries, id_col, vector_col, scale), block)
    asked = stage(made, "asked").withColumnRenamed("block", "q_block")
    lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def first(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        least = []
        if left.num_rows and right.num_rows:
            (q_ids, q), (ids, x) = _unpacked(left), _unpacked(right)
            row, _, score = best_of_block(q_ids, q, np.full(len(q), lowest), ids, x, k)
            last = np.full(len(q), highest)
            np.minimum.at(last, row, score)
            least.append(np.where(np.bincount(row, minlength=len(q)) == k, last, lowest).astype("<i8").tobytes())
        return pa.table({"dim": [key[0].as_py()] * len(least), "q_block": [key[1].as_py()] * len(least), "least": least},
                        schema=pa.schema([("dim", pa.int32()), ("q_block", pa.int64()), ("least", pa.binary())]))

    def second(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            (q_ids, q), (ids, x) = _unpacked(left), _unpacked(right)
            row, name, score = best_of_block(q_ids, q, np.frombuffer(left["least"][0].as_py(), "<i8"), ids, x, k)
            found = [q_ids[row], name, score]
        return pa.table(found, names=["query_id", "vec_id", "score"])

    meet = ["dim", "q_block"]
    q_blocks = F.explode(F.sequence(F.lit(0).cast("long"), _per_dim(query_blocks) - 1)).alias("q_block")
    per_run = {d: max(1, run_bytes // (8 * max(d, 1) * block)) for d in row_blocks}
    runs = {d: -(-n // per_run[d]) for d, n in row_blocks.items()}
    seeds = rows.groupBy("dim").agg(F.min("block").alias("block"))
    seed = rows.join(F.broadcast(seeds), ["dim", "block"]).select("dim", "ids", "vectors", q_blocks)  # one block per dimension
    least = asked.groupBy(*meet).cogroup(seed.groupBy(*meet)).applyInArrow(first, "dim int, q_block long, least binary")
    ready = asked.join(stage(least, "least"), meet)
    ready = ready.select("*", F.explode(F.sequence(F.lit(0).cast("long"), _per_dim(runs) - 1)).alias("run"))
    dealt = rows.select("dim", "ids", "vectors", F.pmod(F.col("block"), _per_dim(runs)).alias("run"), q_blocks)
    found = ready.groupBy(*meet, "run").cogroup(dealt.groupBy(*meet, "run")).applyInArrow(
        second, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
