"""Ranked lexical search: item bundles with sparse accumulators pass through the owners of their terms."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import byte_rows, ship
from panelyard.plans.skew import attach
from panelyard.plans.stage import stage

#: letters A-Z in lower case; every byte that is not a letter, a digit or part of a character from U+0080 on is a gap
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
UNIT = 1_000_000_000
BUNDLES = "block int, item int, rows binary, scores binary, top binary"


@dataclass(frozen=True)
class Settings:
    """``owners`` stages of terms, rare ones first, each with about ``growth`` times the postings of the one before.

    ``block_docs`` documents share a cogroup; ``item_terms`` different terms, at
    most, are looked for in one pass, further items take further passes.
    """

    owners: int = 4
    growth: int = 4
    block_docs: int = 8192
    item_terms: int = 1_000_000


def terms_of(data: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order, A-Z in lower case."""
    return data.translate(_LETTERS).split()


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins and ends among the flattened values."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[:1]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Item:
    item_id: int | None
    terms: frozenset[bytes]


def _items(items: DataFrame, settings: Settings) -> Iterator[list[Item]]:
    """Items in passes of at most ``item_terms`` different terms (one item alone may have more)."""
    held, seen = [], set()
    for row in items.select("item_id", "text").toLocalIterator():
        item = Item(row[0], frozenset(terms_of((row[1] or "").encode())))
        if held and len(seen | item.terms) > settings.item_terms:
            yield held
            held, seen = [], set()
        held.append(item)
        seen |= item.terms
    if held:
        yield held


def _occurrences(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """row, doc_id, n (terms with repeats) and the looked-for terms (numbers) and tfs of every document that has any term; written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            kept, sizes, terms, times = [], [], [], []
            for k, data in enumerate(byte_rows(batch.column(1))):
                words = terms_of(data)
                if words:
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    kept.append(k)
                    sizes.append(len(words))
                    terms.append(list(found))
                    times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "occurrences")


@dataclass(frozen=True)
class Plan:
    """What every stage knows: the terms' owners and weights, and each item's terms and open maximum by stage.

    Arrays have an entry per looked-for term or per item, never per document.
    """

    weights: np.ndarray
    owner: np.ndarray
    items: list[np.ndarray]
    open: np.ndarray


def _plan(found: DataFrame, items: list[Item], vocabulary: dict[bytes, int], settings: Settings) -> tuple[Plan, DataFrame]:
    """The plan, and (row, block, term, c) lists per document: c is what a term adds to the score of every item that has it."""
    n_docs, total = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect():
        df[term] = n
    weights = np.array([weight(n_docs, n) for n in df.tolist()], np.int64)
    # rare terms first; an owner's postings grow by a factor, so that the early ones cost little and settle much
    order = np.argsort(df, kind="stable")
    share = np.cumsum(df[order]) / max(int(df.sum()), 1)
    limits = [settings.growth ** -k for k in range(settings.owners - 1, 0, -1)]
    owner = np.zeros(len(df), np.int64)
    owner[order] = np.searchsorted(limits, share)
    # whole numbers all along: div rounds down
    length = F.expr(f"100 - 50 + (50 * n * {n_docs}L) div {total or 1}L")
    blocks = max(1, -(-n_docs // settings.block_docs))
    lists = found.select("row", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), length.alias("m"), "terms", "tfs")

    def add_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, tfs = batch.column(3), batch.column(4)
            term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            m = np.repeat(batch.column(2).to_numpy(), np.diff(_offsets(terms)))
            c = weights[term] * (UNIT * tf // (1000 * tf + 20 * m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), terms, pa.ListArray.from_arrays(pa.array(_offsets(terms)), pa.array(c))],
                ["row", "block", "terms", "c"])

    postings = stage(lists.mapInArrow(add_weights, "row long, block int, terms array<int>, c array<long>"), "postings")
    most = np.zeros(len(df), np.int64)
    pairs = postings.select(F.explode(F.arrays_zip("terms", "c")).alias("p"))
    for term, c in pairs.groupBy("p.terms").agg(F.max("p.c")).collect():
        most[term] = c
    numbers = [np.array(sorted(vocabulary[t] for t in item.terms), np.int64) for item in items]
    open_ = np.array([[most[t[owner[t] > s]].sum() for t in numbers] for s in range(settings.owners)], np.int64).reshape(
        settings.owners, len(items))
    return Plan(weights, owner, numbers, open_), postings


def _add(plan: Plan, level: int, least: np.ndarray, k: int):
    """One stage in one block: add what the owner's terms give to the accumulators of every item.

    An accumulator goes on only if, with the most that later terms can add, it may
    reach ``least``, the item's k-th best so far. One that was dropped and comes
    again starts at 0 and stays below: it could not have reached it with all.
    """
    def stage_of(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        held = {r["item"]: (np.frombuffer(r["rows"], np.int64), np.frombuffer(r["scores"], np.int64)) for r in bundles.to_pylist()}
        docs = postings["row"].to_numpy()
        terms = postings["terms"].combine_chunks()
        counts = np.diff(_offsets(terms))
        everyone = np.unique(np.concatenate([docs, *[r for r, _ in held.values()]]))
        place = np.repeat(np.searchsorted(everyone, docs), counts)
        term, c = terms.flatten().to_numpy(), postings["c"].combine_chunks().flatten().to_numpy()
        order = np.argsort(term, kind="stable")
        term, place, c = term[order], place[order], c[order]
        block = (bundles if bundles.num_rows else postings)["block"][0].as_py()
        score, out = np.zeros(len(everyone), np.int64), []
        for item, own in enumerate(plan.items):
            mine = own[plan.owner[own] == level]
            score[:] = 0
            if item in held:
                rows, sums = held[item]
                score[np.searchsorted(everyone, rows)] = sums
            for a, b in zip(np.searchsorted(term, mine).tolist(), np.searchsorted(term, mine, "right").tolist(), strict=True):
                score[place[a:b]] += c[a:b]  # a document is once in a term's list
            keep = np.flatnonzero((score > 0) & (score + plan.open[level, item] >= least[item]))
            if len(keep):
                sums = score[keep]
                top = np.sort(sums)[-k:]
                out.append((block, item, everyone[keep].tobytes(), sums.tobytes(), top.tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["block", "item", "rows", "scores", "top"])

    return stage_of


def _kth_best(bundles: DataFrame, n_items: int, k: int) -> np.ndarray:
    """Each item's k-th best partial score over all blocks, 1 if it has fewer; scores only grow, so it bounds the last one."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [np.frombuffer(t, np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), [len(t) for t in tops])),
                 pa.array(np.concatenate([*tops, np.zeros(0, np.int64)]))], ["item", "score"])

    scores = bundles.select("item", "top").mapInArrow(spread, "item int, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"))
    kth = scores.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    out = np.ones(n_items, np.int64)
    for item, n, least in kth.collect():  # one row per item of this pass
        if n == k:
            out[item] = least
    return out


def _unbundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(r, np.int64) for r in batch.column(1).to_pylist()]
        scores = [np.frombuffer(s, np.int64) for s in batch.column(2).to_pylist()]
        empty = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), [len(r) for r in rows])),
             pa.array(np.concatenate(rows + empty)), pa.array(np.concatenate(scores + empty))], ["item", "row", "score"])


def _search(docs: DataFrame, items: list[Item], k: int, settings: Settings) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*[item.terms for item in items])))}
    found = _occurrences(docs, vocabulary)
    plan, postings = _plan(found, items, vocabulary, settings)
    bundles = spark.createDataFrame([], BUNDLES)
    least = np.ones(len(items), np.int64)
    for level in range(settings.owners):
        own = _of_owner(postings, plan, level)
        bundles = stage(bundles.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_add(plan, level, least, k), BUNDLES), "bundles")
        least = _kth_best(bundles, len(items), k)
    # what may still be among the k best; rows of equal texts may be many, so ranks are cut in each task first
    scored = bundles.select("item", "rows", "scores").mapInArrow(_unbundle, "item int, row long, score long")
    limits = spark.createDataFrame([(i, item.item_id, int(x)) for i, (item, x) in enumerate(zip(items, least.tolist(), strict=True))],
                                   "item int, item_id long, least long")
    scored = attach(scored, limits, ["item"], "inner").where(F.col("score") >= F.col("least"))
    named = attach(found.select("row", "doc_id"), scored, ["row"], "inner")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _of_owner(postings: DataFrame, plan: Plan, level: int) -> DataFrame:
    """The postings of one owner's terms, a row per document that has any."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, c = batch.column(2), batch.column(3)
            term = terms.flatten().to_numpy()
            mine = plan.owner[term] == level
            sums = np.concatenate(([0], np.cumsum(mine)))
            offsets = sums[_offsets(terms)].astype(np.int32)
            some = pa.array(np.diff(offsets) > 0)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[mine])) for v in (term, c.flatten().to_numpy())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["row", "block", "terms", "c"]).filter(some)

    return postings.select("row", "block", "terms", "c").mapInArrow(pick, "row long, block int, terms array<int>, c array<long>")


def search(docs: DataFrame, items: DataFrame, k: int = 50, settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text) the ``k`` rows of ``docs`` (doc_id, text) that score highest.

    A score adds, over the item's different terms, the term's weight times its
    damped frequency in the document, in whole numbers. Only scores above 0 count;
    equal scores go by doc_id (null last), then by row. Null and empty texts have
    no terms: such documents are never found and count for nothing, such items
    have no rows. Null ids stay null; repeated documents are found each, repeated
    items answered each; empty tables give no rows. Texts are read whole, in one
    task each, however long. Other columns are left out.

    Terms are dealt to owners, rare terms first. An item's bundle, cut in blocks of
    documents, passes from owner to owner; each adds its terms' contributions to
    the document accumulators. An accumulator is left behind only when its
    document can no longer reach the item's k-th best score.
    """
    ship(docs.sparkSession)
    parts = [_search(docs, part, k, settings) for part in _items(items, settings)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)
